"""Language codes, label spellings, seed passages and labelled samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The languages that results may name. Others exist as classes to be rejected.
LANGS = ("en", "de", "fr", "es", "pt", "zh", "ja", "ko", "vi")
SAMPLE_ROWS = 4000

NAMES = {
    "en": "en eng english anglais englisch inglés inglês", "de": "de deu ger german deutsch allemand alemán alemão", "fr": "fr fra fre french français francais französisch francés francês",
    "es": "es spa spanish español espanol spanisch espagnol espanhol castilian castellano", "pt": "pt por portuguese português portugues portugiesisch portugais portugués",
    "zh": "zh zho chi chinese 中文 cn mandarin chinesisch chinois", "ja": "ja jpn japanese 日本語 jp japanisch japonais", "ko": "ko kor korean 한국어 kr koreanisch coréen",
    "vi": "vi vie vietnamese vietnamesisch vietnamien", "it": "it ita italian italiano italienisch", "nl": "nl nld dut dutch nederlands niederländisch", "ru": "ru rus russian русский", "el": "el ell gre greek ελληνικά", "la": "la lat latin",
}
BY_NAME = {n: k for k, v in NAMES.items() for n in [*v.split(), "tiếng" if k == "vi" else k]}
UNKNOWN = {"", "unknown", "und", "auto", "n/a", "na", "none", "null", "??", "?", "-", "xx", "zxx", "mul", "mis", "other", "undefined", "undetermined", "nan"}


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label however it is spelled; None where it says nothing.

    A spelling that is neither known nor one of the words for unknown is kept as it
    stands in lower case, so it counts as a language of its own.
    """
    if label is None:
        return None
    s = label.strip().lower()
    if s in UNKNOWN or not re.search(r"[^\W\d_]", s):
        return None
    head = re.split(r"[\s_\-(/,.;]+", s)[0]
    return BY_NAME.get(s) or BY_NAME.get(head) or s


def label_column(label: Column) -> Column:
    """``label_code`` as a column expression."""
    s = F.lower(F.trim(F.regexp_replace(label, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")))
    names = F.create_map(*[F.lit(x) for kv in sorted(BY_NAME.items()) for x in kv])
    known = F.coalesce(F.try_element_at(names, s), F.try_element_at(names, F.element_at(F.split(s, r"[\s_\-(/,.;]+"), 1)), s)
    return F.when(label.isNull() | s.isin(*sorted(UNKNOWN)) | ~s.rlike(r"\p{L}"), F.lit(None)).otherwise(known)


#: Passages of each language for tables without any labelled row.
SEEDS = {
    "en": "The clerk of the town wrote down what the people had told him. When the winter came, they found that nobody had paid for the bread. It was the first time that she had seen the house on the hill, and there was nothing she could do about it. Which of these letters were sent before the end of the year? We have received your request and will answer it as soon as possible. The minutes are kept by the office, together with the list of members.",
    "de": "Der Schreiber der Stadt hat aufgeschrieben, was ihm die Leute erzählt hatten. Als der Winter kam, fanden sie, dass niemand das Brot bezahlt hatte. Es war das erste Mal, dass sie das Haus auf dem Hügel sah, und sie konnte nichts dagegen tun. Welche dieser Briefe wurden vor dem Ende des Jahres geschickt? Wir haben Ihre Anfrage erhalten und werden sie so bald wie möglich beantworten. Das Protokoll wird im Amt zusammen mit der Liste der Mitglieder aufbewahrt.",
    "fr": "Le greffier de la ville a écrit ce que les gens lui avaient raconté. Quand l'hiver est venu, ils ont trouvé que personne n'avait payé le pain. C'était la première fois qu'elle voyait la maison sur la colline, et elle n'y pouvait rien. Lesquelles de ces lettres ont été envoyées avant la fin de l'année? Nous avons reçu votre demande et y répondrons dès que possible. Le procès-verbal est conservé au bureau avec la liste des membres.",
    "es": "El escribano de la ciudad apuntó lo que la gente le había contado. Cuando llegó el invierno, vieron que nadie había pagado el pan. Era la primera vez que ella veía la casa en la colina, y no podía hacer nada. ¿Cuáles de estas cartas se enviaron antes del final del año? Hemos recibido su solicitud y la contestaremos lo antes posible. El acta se guarda en la oficina junto con la lista de los miembros.",
    "pt": "O escrivão da cidade anotou o que as pessoas lhe tinham contado. Quando chegou o inverno, viram que ninguém tinha pago o pão. Era a primeira vez que ela via a casa na colina, e não podia fazer nada. Quais destas cartas foram enviadas antes do fim do ano? Recebemos o seu pedido e responderemos assim que for possível. A ata é guardada na repartição juntamente com a lista dos membros. Não há mais informações sobre a criança.",
    "zh": "城里的书记员写下了人们告诉他的事情。冬天来了，他们发现没有人付过面包钱。这是她第一次看到山上的房子，她对此无能为力。这些信中哪些是在年底之前寄出的？我们已经收到您的请求，会尽快答复。会议记录和成员名单一起保存在办公室里。档案员检查了这封信。",
    "ja": "町の書記は人々から聞いたことを書き留めた。冬が来ると、誰もパンの代金を払っていないことがわかった。彼女が丘の上の家を見たのは初めてで、どうすることもできなかった。これらの手紙のうち、年末までに送られたのはどれですか。ご依頼を受け取りましたので、できるだけ早くお答えします。議事録は会員名簿とともに事務所に保管されている。",
    "ko": "시의 서기는 사람들이 들려준 이야기를 적어 두었다. 겨울이 오자 아무도 빵값을 내지 않았다는 것을 알게 되었다. 그녀가 언덕 위의 집을 본 것은 처음이었고 아무것도 할 수 없었다. 이 편지들 가운데 연말 전에 보낸 것은 어느 것입니까? 요청을 받았으며 가능한 한 빨리 답변하겠습니다. 회의록은 회원 명단과 함께 사무실에 보관되어 있다.",
    "vi": "Người thư ký của thành phố đã ghi lại những gì mọi người kể cho ông. Khi mùa đông đến, họ thấy rằng không ai trả tiền bánh mì. Đó là lần đầu tiên cô nhìn thấy ngôi nhà trên đồi, và cô không thể làm gì được. Những bức thư nào đã được gửi trước cuối năm? Chúng tôi đã nhận được yêu cầu của bạn và sẽ trả lời sớm nhất có thể. Biên bản được lưu giữ tại văn phòng cùng với danh sách thành viên.",
    "it": "Il segretario della città ha scritto quello che la gente gli aveva raccontato. Quando arrivò l'inverno, videro che nessuno aveva pagato il pane. Era la prima volta che lei vedeva la casa sulla collina e non poteva farci niente. Quali di queste lettere sono state spedite prima della fine dell'anno? Il verbale è conservato nell'ufficio insieme alla lista dei soci.",
    "nl": "De schrijver van de stad heeft opgeschreven wat de mensen hem hadden verteld. Toen de winter kwam, vonden zij dat niemand het brood had betaald. Het was de eerste keer dat zij het huis op de heuvel zag, en zij kon er niets aan doen. Welke van deze brieven zijn voor het einde van het jaar verstuurd? De notulen worden op het kantoor bewaard, samen met de lijst van leden.",
    "ru": "Городской писарь записал то, что рассказали ему люди. Когда пришла зима, они увидели, что никто не заплатил за хлеб. Она впервые увидела дом на холме и ничего не могла сделать. Какие из этих писем были отправлены до конца года? Протокол хранится в конторе вместе со списком членов.",
    "el": "Ο γραμματέας της πόλης έγραψε όσα του είχαν πει οι άνθρωποι. Όταν ήρθε ο χειμώνας, είδαν ότι κανείς δεν είχε πληρώσει το ψωμί. Ήταν η πρώτη φορά που έβλεπε το σπίτι στον λόφο και δεν μπορούσε να κάνει τίποτα. Τα πρακτικά φυλάσσονται στο γραφείο μαζί με τον κατάλογο των μελών.",
    "la": "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Massa ligula purus nunc augue vitae felis nibh nulla lectus tortor sapien ornare arcu quam mauris velit orci. Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani. In nomine domini amen, anno incarnationis eiusdem.",
}


def labelled_sample(documents: DataFrame, text: str = "text", lang: str = "lang", n: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(code, passage) rows for fitting: the seeds and at most n labelled texts.

    Labels may be wrong; learners drop rows that contradict their first model.
    """
    rows = C.sample_rows(documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text), [lang, text], n).collect()
    out = [(k, s) for k, v in SEEDS.items() for s in C.SENT_END.split(v) if s.strip()]
    for code, t in rows:
        k = label_code(code)
        if k in SEEDS:
            out += [(k, s) for s in C.sentences(t)[:12] if len(s) >= (8 if k in ("zh", "ja", "ko") else 25)]
    return sorted(set(out))
