"""Template residue, filler, error pages and script notices (problem 6).

Method: labelled residue passages are held in an inverted index. The windows of a text
(lines, sentences, markup and JSON values, and each template field as a window of its
own) retrieve the passages that share terms with them; the TF-IDF containment of the
window in the passage decides: the share of the window's weight that the passage covers,
``COVERED`` or more, with rare shared terms of ``LEAST_MASS`` or more. Passages of kind
``none`` merely tell of such things; a window that one of them covers as well is no match.

The terms of a template field are the style of its brackets and its inner words; a style
that only templates have weighs much (``STYLE_HARD``), single square brackets, which
editors use as well, hardly anything (``STYLE_SOFT``), so that there the words decide.
The workbench's own error lines are such fields too, their head is the style.
Rarity is counted over all texts, by the number of texts with a word.

Cases: null, empty and blank texts match nothing; very long texts are scanned
whole; repeated rows give one result; ties go to the residue kind that comes first
in ``KINDS``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .exemplars import RESIDUE

KINDS = ("placeholder", "filler", "error_page", "script_notice", "none")
COVERED = 0.6
#: Least weight of the rare shared terms, in weights of a word that no text has.
LEAST_MASS = 1.1
RARE = 0.45
STYLE_HARD, STYLE_SOFT, INNER = 4.0, 0.3, 0.5
#: Words in fewer texts than one of so many weigh as much as unseen ones; so the table of counts stays small.
COUNTED = 20_000
#: Texts without any word that are added to the count, so that a word of one of few texts is still rare.
PRIOR_TEXTS = 500
#: The heads of the workbench's own error lines.
OWN_ERROR = re.compile(r"\[(Ollama Error|Translation Error|Error processing)\b([^\]\n]*)\]?")
SLOTS = re.compile(
    r"\{\{\s*[^{}\n]{1,60}?\s*\}\}|\$\{\s*[^{}\n]{1,60}?\s*\}|<%=?\s*[^%\n]{1,60}?\s*%>|<<\s*[\w .\-]{1,60}?\s*>>|\[\[\s*[\w .\-]{1,60}?\s*\]\]|@@\s*[\w .\-]{1,60}?\s*@@|%\(\w{1,40}\)[sd]"
    r"|(?<![\w%])%[A-Za-z_][\w]{1,40}%(?![\w%])|(?<![\w{])\{[A-Za-z_][\w.]{0,40}\}(?![\w}])|(?<!\w)__[A-Za-z][A-Za-z_]{1,40}__(?!\w)|(?<![\w$])\$[A-Z][A-Z_]{2,40}\$?(?!\w)"
    r"|\[(?:[^\W\d_]+(?:'[^\W\d_]+)?[ _\-]){1,6}[^\W\d_]+\]|\[[A-ZÀ-Þ_]{3,30}\]|<(?:insert|enter|your|hier|insérer|insertar|inserir)[^<>\n]{1,50}>",
)
TAG = re.compile(r"</?[A-Za-z!][^<>\n]{0,200}>")
#: Words, CJK characters, and numbers that may be status codes.
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|(?<![\d.,])[45]\d\d(?![\d.,]*\d)|[぀-ヿ㐀-鿿가-힯]")
JSON_STR = re.compile(r'"((?:[^"\\\n]|\\.)*)"')


def slot_terms(slot: str) -> list[str]:
    """The terms of a template field: the style of its brackets, then its inner words."""
    inner = re.sub(r"(?<=[a-zß-ÿ])(?=[A-Z])", " ", slot).replace("_", " ")
    words = ["·" + w for w in TOKEN.findall(inner.lower())]
    if slot[0] == "[" and slot[1] != "[":
        style = "[A B" if slot.upper() == slot and len(words) > 1 else "["
    else:
        style = re.match(r"[^\w\s]+|__|.", slot).group(0)
    return ["¤" + style, *words]


def windows(text: str | None) -> list[list[str]]:
    """Token lists of the passages of a text."""
    body = C.content(text)
    if not body.strip():
        return []
    out = []
    if "[" in body or "{" in body or "<" in body or "%" in body or "@@" in body or "__" in body or "$" in body:
        out = [["¤" + m.group(1), *("·" + w for w in TOKEN.findall(m.group(2).lower()))] for m in OWN_ERROR.finditer(body)]
        body = OWN_ERROR.sub(" ", body)
        out += [slot_terms(m.group(0)) for m in SLOTS.finditer(body)]
        body = SLOTS.sub(" ", body)
        if '"error"' in body or '"message"' in body:
            body = re.sub(r"^\s*\{.*\}\s*$", lambda m: "\n".join(JSON_STR.findall(m.group(0))), body, flags=re.S)
        body = TAG.sub("\n", body)
    for p in C.PARA.split(body):
        lines = [x for x in p.split("\n") if x.strip()]
        if not lines:
            continue
        whole = C.split_sentences(" ".join(lines))
        out += whole
        if len(lines) > 1:
            out += lines
    return [x for x in out if isinstance(x, list)] + [w for w in (TOKEN.findall(x.lower()) for x in out if isinstance(x, str)) if w]


class Index:
    """Inverted index of the labelled passages with TF-IDF weights."""

    def __init__(self, passages: list[tuple[str, str]], df: dict[str, int], n: int):
        """``df``: in how many of n texts a word stands."""
        self.docs = [(kind, frozenset(t for w in windows(text) for t in w)) for kind, text in passages]
        self.docs = [(k, t) for k, t in self.docs if t]
        #: The weight of unseen words is fixed, so that no bound moves with the number of texts.
        self.top = math.log(COUNTED)
        self.idf = {t: min(self.top, math.log((n + PRIOR_TEXTS) / (1 + c))) for t, c in df.items()}
        self.post = defaultdict(list)
        for i, (_, terms) in enumerate(self.docs):
            for x in terms:
                self.post[x].append(i)
        #: A window can only match by a passage's term that is at least this rare among texts.
        self.rare = {x for x in self.post if self.weight(x) > RARE * self.top or x[0] in "¤·"}

    def weight(self, term: str) -> float:
        if term[0] == "¤":
            return (STYLE_SOFT if term == "¤[" else STYLE_HARD) * self.top
        if term[0] == "·":
            return INNER * self.top
        return self.idf.get(term, self.top)

    def kind(self, terms: list[str]) -> str | None:
        """The kind of residue of a window, or None."""
        s = set(terms)
        if s.isdisjoint(self.rare):
            return None
        slot = terms[0][0] == "¤"
        mass = sum(map(self.weight, s))
        hits: Counter = Counter()
        rare: Counter = Counter()
        for x in s:
            if x in self.post:
                v = self.weight(x)
                for i in self.post[x]:
                    hits[i] += v
                    if x in self.rare:
                        rare[i] += v
        best: dict[str, float] = {}
        for i, got in hits.items():
            kind = self.docs[i][0]
            if got / mass >= COVERED and (slot or rare[i] >= LEAST_MASS * self.top):
                best[kind] = max(best.get(kind, 0.0), got / mass)
        if not best:
            return None
        top = max(best.values())
        if best.get("none", 0.0) >= top:
            return None
        return next(k for k in KINDS if best.get(k) == top)

    def kinds(self, text: str | None) -> set[str]:
        return {k for w in windows(text) if (k := self.kind(w))}

    def matches(self, text: str | None) -> bool:
        """Whether a text has any residue."""
        return any(self.kind(w) for w in windows(text))


def text_counts(results: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each word stands, and the number of texts; counted over all texts."""
    texts = C.fields(results).select("text")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+"))
    counts = C.cut(texts.select(F.explode(F.array_append(words, F.lit("¤"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    n = counts.where("word = '¤'").agg(F.sum("n")).first()[0] or 0
    #: At most as many words as ``COUNTED`` texts hold, however large the table is.
    rows = counts.where((F.col("word") != "¤") & (F.length("word") > 0) & (F.col("n") > n / COUNTED)).collect()
    return {r[0]: r[1] for r in rows}, n


def index_for(results: DataFrame) -> Index:
    return Index(RESIDUE, *text_counts(results))


def residue(results: DataFrame, cols: tuple[str, ...] = ("extracted_text", "translation")) -> DataFrame:
    """(job_id, file_index, fld, kind) of each text with residue."""
    model = results.sparkSession.sparkContext.broadcast(index_for(results))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index = model.value
        rows = [(j, f, c, k) for j, f, c, t in zip(pdf["job_id"], pdf["file_index"], pdf["fld"], pdf["text"]) for k in index.kinds(t)]
        return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "kind"])

    return C.map_texts(C.fields(results, cols), "job_id string, file_index int, fld string, kind string", run)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(C.table(spark, sf_dir, "results")).distinct()


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the non-null texts that hold no residue: what an export keeps."""
    r = C.table(spark, sf_dir, "results")
    keys = C.fields(r).select("job_id", "file_index", "fld").distinct()
    return keys.join(residue(r).select("job_id", "file_index", "fld").distinct(), ["job_id", "file_index", "fld"], "left_anti")


QUERIES = {"p6_found": found, "p6_clean": clean}
