"""Labelled exemplar passages: residue (problem 6) and refusals (problem 4) in five languages.

``RESIDUE`` holds (kind, passage); kind ``none`` marks passages that only tell of such
things. The passages were written for this module from the usual wording of web servers,
viewers, forms and assistants; they are notices of several sentences, and a window of a
text is compared with a whole passage. The heads of the workbench's own error lines (``[Ollama
Error:`` and the like) are fixed values.
"""

from __future__ import annotations


def _blocks(kind: str, text: str) -> list[tuple[str, str]]:
    return [(kind, " ".join(x.split())) for x in text.strip().split("\n\n") if x.strip()]


#: Fields of templates: bracket styles and the words that stand in them.
_PLACEHOLDER = """
{{ first_name last_name }}

{{ field }}

${ price total }

<< customer >>

[[ town ]]

%recipient%

%(item)s

<%= subject %>

@@ value @@

{value_name}

__FIELD__

$FIELD$

<insert text here>

[ENTER FULL NAME HERE]

[FIELD]

[your full name and address]

[first name last name surname]

[date day month year]

[insert enter add fill in here]

[amount sum total price number]

[city town street place country]

[company organisation title subject]

[recipient sender addressee signature]

[phone number email]

[Ihr Name Vorname Nachname hier einfügen]

[Datum Tag Monat Jahr eintragen ergänzen]

[Betrag Summe Preis Nummer einsetzen]

[Ort Stadt Straße Anschrift Adresse]

[Firma Titel Betreff Empfänger Absender Unterschrift]

[votre nom prénom à compléter ici]

[date jour mois année à insérer]

[montant somme prix numéro]

[ville lieu rue adresse]

[société titre objet destinataire expéditeur signature]

[su nombre apellido completar aquí]

[fecha día mes año insertar]

[importe cantidad precio número]

[ciudad lugar calle dirección]

[empresa título asunto destinatario remitente firma]

[o seu nome apelido preencher aqui]

[data dia mês ano inserir]

[valor montante preço número]

[cidade lugar rua endereço morada]

[empresa título assunto destinatário remetente assinatura]
"""

_FILLER = """
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum curabitur pretium tincidunt lacus nulla gravida orci a odio nullam varius turpis et commodo pharetra est eros bibendum elit nec luctus magna felis sollicitudin mauris integer in mauris eu nibh euismod gravida duis ac tellus et risus vulputate vehicula donec lobortis risus a elit etiam tempor ut ullamcorper ligula eu tempor congue eros est euismod turpis id tincidunt sapien risus a quam maecenas fermentum consequat mi donec fermentum pellentesque malesuada nulla a mi duis sapien sem aliquet nec commodo eget consequat quis neque aliquam faucibus elit ut dictum aliquet felis nisl adipiscing sapien sed malesuada diam lacus eget erat cras mollis scelerisque nunc nullam arcu aliquam consequat curabitur augue lorem dapibus quis laoreet et pretium ac nisi aenean magna nisl mollis quis molestie eu feugiat in orci in hac habitasse platea dictumst vestibulum ante ipsum primis faucibus orci luctus et ultrices posuere cubilia praesent phasellus proin sodales pulvinar tempor ornare lectus vitae velit nunc augue tortor purus nibh massa ligula viverra volutpat vivamus suspendisse potenti porttitor pellentesque nullam neque morbi leo justo interdum imperdiet hendrerit fringilla fusce efficitur egestas dignissim convallis condimentum blandit auctor accumsan ac

Your own text goes in here. This is only dummy text, sample text, filler text, a placeholder paragraph. Text will follow later, content to come, copy coming soon. Replace this paragraph, sentence or block with your own words or content. Type, enter, write, insert or paste your text or content here. Click to edit and add text. Heading goes here. Description goes here. To be written, to be added, to be completed.

Hier steht später Ihr eigener Text. Das ist nur Blindtext, ein Beispieltext, Fülltext, Mustertext oder Platzhalter. Text folgt noch, Inhalt folgt in Kürze, wird nachgereicht, wird noch ergänzt, wird später ersetzt. Diesen Absatz bitte durch eigenen Text oder Inhalt ersetzen. Geben Sie hier Ihren Text ein, fügen Sie hier Inhalt ein, schreiben Sie hier. Zum Bearbeiten klicken. Überschrift hier. Beschreibung hier.

Votre propre texte viendra ici. Ce n'est qu'un faux texte, un texte d'exemple, un texte provisoire, un texte de remplissage. Le texte suit, contenu à venir, bientôt disponible, à compléter plus tard. Remplacez ce paragraphe ou cette phrase par votre contenu, à remplacer. Saisissez, écrivez, insérez ou collez votre texte ici. Cliquez pour modifier. Titre ici. Description ici.

Aquí irá su propio texto. Esto es solo texto simulado, texto de ejemplo, texto de relleno, texto provisional, un párrafo de muestra. El texto sigue, contenido próximamente, se completará más tarde, será sustituido después. Sustituya este párrafo o esta frase por su contenido. Escriba, introduzca, inserte o pegue su texto aquí. Haga clic para editar. Título aquí. Descripción aquí.

Aqui virá o seu próprio texto. Isto é apenas texto fictício, texto de exemplo, texto de preenchimento, texto provisório, um parágrafo de amostra. O texto segue, conteúdo em breve, será completado mais tarde, será substituído depois. Substitua este parágrafo ou esta frase pelo seu conteúdo. Escreva, introduza, insira ou cole o seu texto aqui. Clique para editar. Título aqui. Descrição aqui.
"""

_ERROR = """
[Ollama Error: the call to the model server failed, timed out, was refused, was reset or was closed, connection to host and port could not be made, model name not found, not installed, try pulling it first, status code of the chat request, unexpected end of JSON input, invalid response body, bad value for the option or parameter, out of memory while loading the model weights, image or picture format not recognised, data ends early, file truncated, cannot identify or decode the image file, read timed out after seconds]

[Translation Error: the call to the model server failed, timed out, was refused, was reset or was closed, connection to host and port could not be made, model name not found, not installed, status code of the request, unexpected end of JSON input, invalid response, bad value for the option or parameter, out of memory, image or picture format not recognised, data ends early, read timed out after seconds]

[Error processing scan png jpg file: cannot identify image file, file truncated, out of memory while loading, model not found, broken data stream, no such file or directory, bad value for the option or parameter, read timed out, connection refused]

HTTP error status code: 400 bad request, 401 unauthorized, 403 forbidden, 404 not found, 405 method not allowed, 408 request timeout, 410 gone, 429 too many requests, 500 internal server error, 501 not implemented, 502 bad gateway, 503 service unavailable, 504 gateway timeout. nginx apache server at port.

Oops, sorry, an error occurred, something went wrong on our end or with your request. The page, file, document, record or resource you requested, were looking for or tried to open was not found, could not be found, could not be displayed, opened, loaded or shown, does not exist, is missing, has been moved, removed or deleted, or is no longer available. This site or address cannot be reached. The URL may be wrong, check the link. The server encountered an unexpected condition, is overloaded, busy, down for maintenance or temporarily unavailable. You do not have permission, you are not allowed to view this page, access is denied, please log in or sign in. Your session has timed out or expired, please sign in again. You have sent too many requests. Please try again later, in a few minutes, reload or refresh the page, go back, return to the home or start page. If the problem persists or continues, contact, notify or call support, the webmaster, system or site administrator. Error code, reference, request, incident or ticket number id. Failed to load the image, preview or viewer. No connection, connection lost, timed out or failed. Database error, query failed, fatal exception, stack trace.

Hoppla, leider ist ein Fehler aufgetreten, etwas ist schiefgelaufen. Die Seite, Datei, das Dokument, der Datensatz oder die Ressource, die Sie gesucht, aufgerufen oder angefordert haben, wurde nicht gefunden, konnte nicht gefunden, angezeigt, geöffnet oder geladen werden, existiert nicht, fehlt, wurde verschoben, entfernt oder gelöscht oder ist nicht mehr verfügbar oder nicht erreichbar. Diese Adresse ist ungültig, prüfen Sie den Link. Interner Fehler des Servers, Serverfehler, der Server ist überlastet, wird gewartet, der Dienst ist derzeit oder vorübergehend nicht verfügbar. Sie haben keine Berechtigung, der Zugriff oder Zugang ist verweigert, gesperrt oder verboten, bitte melden Sie sich an. Ihre Sitzung oder Anmeldung ist abgelaufen. Zu viele Anfragen. Bitte versuchen Sie es später, in einigen Minuten noch einmal oder erneut, laden Sie die Seite neu, zurück zur Startseite oder zur Übersicht. Wenn das Problem bestehen bleibt oder weiter besteht, wenden Sie sich an den Support, den Systemverwalter oder Administrator. Fehlercode, Referenz, Anfrage, Vorgang, Kennung Nummer. Bild oder Vorschau konnte nicht geladen werden. Keine Verbindung, Verbindung unterbrochen, Zeitüberschreitung.

Oups, désolé, une erreur est survenue ou s'est produite, un problème est apparu. La page, le fichier, le document ou la ressource que vous avez demandé ou cherchez est introuvable, n'a pas été trouvé, n'a pas pu être affiché, ouvert ou chargé, n'existe pas ou plus, est manquant, a été déplacé, retiré ou supprimé, ou n'est plus disponible ou accessible. Cette adresse est invalide, vérifiez le lien. Erreur interne du serveur, le serveur est surchargé ou en maintenance, le service est momentanément ou temporairement indisponible. Vous n'avez pas l'autorisation, l'accès est refusé ou interdit, veuillez vous connecter ou vous identifier. Votre session a expiré ou est terminée. Trop de requêtes ou de demandes. Veuillez réessayer plus tard ou dans quelques minutes, recharger ou actualiser la page, retour à l'accueil. Si le problème persiste ou continue, contactez ou prévenez le support, l'assistance, le webmestre ou l'administrateur du site. Code d'erreur, référence, requête, incident numéro. Impossible de charger l'image ou l'aperçu. Connexion perdue, délai dépassé.

Vaya, lo sentimos, ha ocurrido o se ha producido un error, algo ha salido mal. La página, el archivo, fichero, documento o recurso que ha solicitado, pedido o busca no se encuentra, no fue encontrado o encontrada, no se ha podido o no se pudo mostrar, abrir o cargar, no existe, falta, se ha movido, retirado o eliminado, o ya no está disponible. La dirección no es válida, compruebe el enlace. Error interno del servidor, el servidor está saturado o en mantenimiento, el servicio no está disponible temporalmente o por el momento. No tiene permiso, acceso denegado o prohibido, inicie sesión o identifíquese. Su sesión ha caducado, expirado o terminado. Demasiadas peticiones o solicitudes. Inténtelo de nuevo o vuelva a intentarlo más tarde o en unos minutos, recargue o actualice la página, volver al inicio o a la página principal. Si el problema continúa o persiste, contacte, avise o póngase en contacto con soporte o con el administrador del sitio. Código de error, referencia, solicitud, incidencia número. No se pudo cargar la imagen o la vista previa. Conexión perdida, tiempo de espera agotado.

Ups, lamentamos, ocorreu um erro, algo correu mal. A página, o ficheiro, arquivo, documento ou recurso que pediu, solicitou ou procura não foi encontrado ou encontrada, não pôde ser mostrado, aberto ou carregado, não existe, falta, foi movido, retirado ou eliminado, ou já não está disponível. O endereço não é válido, verifique a ligação. Erro interno do servidor, o servidor está sobrecarregado ou em manutenção, o serviço está temporariamente ou de momento indisponível. Não tem permissão, acesso negado, recusado ou proibido, inicie sessão ou identifique-se. A sua sessão expirou, caducou ou terminou. Demasiados pedidos ou solicitações. Tente novamente ou de novo mais tarde ou dentro de alguns minutos, recarregue ou atualize a página, voltar ao início ou à página inicial. Se o problema continuar ou persistir, contacte ou avise o suporte ou o administrador do sítio. Código de erro, referência, pedido, incidente número. Não foi possível carregar a imagem ou a pré-visualização. Ligação perdida, tempo esgotado.
"""

_SCRIPT = """
JavaScript, scripts or scripting and cookies are disabled, blocked, switched off or turned off in your browser, or not supported. Please enable, activate, allow, turn on or switch on JavaScript, scripts and cookies in the settings of your web browser to continue, view, read, display, see or use this page, site, document, viewer, app or application, then reload or refresh. This page, app, site or viewer needs, requires or only works with JavaScript enabled or active. Your browser does not support scripts or JavaScript, so the content, document or page cannot be shown, displayed or loaded. Checking your browser, verify that you are human and not a robot, scripts must be active. Use a modern or another browser, disable your ad blocker.

JavaScript, Skripte und Cookies sind in Ihrem Browser deaktiviert, gesperrt, blockiert, ausgeschaltet oder werden nicht unterstützt. Bitte aktivieren, erlauben oder schalten Sie JavaScript, Skripte und Cookies in den Einstellungen Ihres Webbrowsers ein, um fortzufahren und diese Seite, dieses Dokument oder die Anwendung anzuzeigen, anzusehen, zu lesen oder zu nutzen, und laden Sie neu. Diese Seite, Anwendung oder dieser Betrachter benötigt, braucht oder funktioniert nur mit JavaScript, aktiviertem oder eingeschaltetem. Ihr Browser unterstützt kein JavaScript und keine Skripte, der Inhalt kann nicht angezeigt oder dargestellt werden. Ihr Browser wird geprüft, bestätigen Sie, dass Sie kein Roboter sind, Skripte müssen aktiv sein. Verwenden Sie einen aktuellen Browser.

JavaScript, les scripts et les cookies sont désactivés, bloqués ou non pris en charge par ou dans votre navigateur. Veuillez activer, autoriser ou permettre JavaScript, les scripts et les cookies dans les réglages ou paramètres du navigateur pour continuer, afficher, voir, consulter, lire ou utiliser cette page, ce site, ce document ou l'application, puis rechargez. Cette page, ce site, ce lecteur ou cette visionneuse nécessite, exige ou fonctionne seulement avec JavaScript ou des scripts actifs, ne fonctionne pas sans. Votre navigateur ne prend pas en charge les scripts, le contenu ne peut pas être affiché. Vérification du navigateur, confirmez que vous n'êtes pas un robot. Utilisez un navigateur récent.

JavaScript, los scripts y las cookies están desactivados, bloqueados o no son compatibles en su navegador. Por favor active, habilite, permita o autorice JavaScript, los scripts y las cookies en los ajustes o la configuración del navegador para continuar, ver, mostrar, consultar, leer o usar esta página, sitio, documento o aplicación y recargue. Esta página, aplicación o visor necesita, requiere o solo funciona con JavaScript o scripts activos, activado o habilitado, que el navegador permita ejecutar. Su navegador no admite scripts, el contenido no se puede mostrar. Comprobando su navegador, confirme que no es un robot. Use un navegador moderno.

O JavaScript, os scripts e os cookies estão desativados, bloqueados ou não são suportados no seu navegador. Por favor ative, habilite, permita ou autorize o JavaScript, os scripts e os cookies nas definições ou configurações do navegador para continuar, ver, mostrar, consultar, ler ou usar esta página, sítio, documento ou aplicação e recarregue. Esta página, aplicação, leitor ou visualizador precisa, requer, exige ou só funciona com JavaScript ou scripts ativos ou ativado. O seu navegador não suporta scripts, o conteúdo não pode ser mostrado. A verificar o navegador, confirme que não é um robô. Use um navegador moderno.
"""

#: Passages that tell of errors, scripts or templates, or mark unreadable places.
_NONE = """
The handbook or guide explains on a page why the site once needed JavaScript and scripts and how readers used to turn them on, which is no longer needed.

Das Handbuch erklärt auf einer Seite, weshalb die Anwendung früher JavaScript brauchte, was heute nicht mehr nötig ist.

Le guide explique sur une page pourquoi le site avait autrefois besoin de JavaScript, ce qui n'est plus nécessaire.

El libro explica en una página por qué el sitio necesitaba antes JavaScript, cosa que ya no hace falta.

O livro explica numa página por que o sítio precisava antes de JavaScript, o que já não é preciso.

The archive's online catalogue reports not found when an old shelf number is typed, so the staff look it up in the printed index.

Der Katalog des Archivs meldet nicht gefunden, sobald jemand eine alte Nummer eingibt, darum nimmt das Personal die Kartei.

The log of the machine notes the internal error on some days and each time a plug or cable was loose.

Das Protokoll des Geräts vermerkt den Fehler an einigen Tagen, und jedes Mal war ein Stecker oder Kabel lose.

The printing house kept trays of dummy type and filled sample pages with meaningless Latin words.

The office or council denied access to the file, refused the request, and the record stays closed until that year.

[illegible] [unreadable] [sic] [torn] [blank] [damaged] [unclear] [stain] [crossed out] [margin note] [seal] [drawing]

[unleserlich] [unlesbar] [zerrissen] [leer] [beschädigt] [Siegel] [durchgestrichen] [Randnotiz]

[illisible] [déchiré] [taché] [sceau] [rayé] [ilegible] [roto] [sello] [ilegível] [rasgado] [selo]
"""

def _lines(block: str) -> list[str]:
    return [x.strip() for x in block.strip().split("\n") if x.strip()]


REFUSALS = _lines("""
I am sorry, but I am unable to translate what you sent me.
Sorry, I'm not able to do that translation for you.
I apologise, but I can't assist you with translating this.
I must respectfully decline this request.
I have to decline to translate this page because it may contain personal or private data.
As an AI language model, I can't help with this content.
As an artificial intelligence assistant I am not allowed to process this material.
I cannot provide a translation, since that would violate my guidelines and policies.
My guidelines do not permit me to fulfil or complete this request.
Unfortunately I cannot comply with your request.
I won't translate this text, it might be harmful or sensitive.
I don't feel comfortable translating this document.
If you like, I can help you with something else.
Please send me a different text instead, or try again with another page or document.
Let me know whether there is another way I may assist you.
Tut mir leid, aber ich bin nicht in der Lage, Ihren Text zu übersetzen.
Es tut mir leid, diese Übersetzung kann ich nicht liefern.
Entschuldigung, bei dieser Übersetzung kann ich Ihnen nicht helfen.
Ich muss die Bitte um eine Übersetzung dieser Seite leider ablehnen.
Als KI und Sprachmodell ist es mir nicht erlaubt, diesen Inhalt zu bearbeiten.
Eine Übersetzung kann ich nicht anbieten, da sie gegen meine Richtlinien und Regeln verstoßen würde.
Leider darf ich diese Anfrage nicht erfüllen, da sie private oder persönliche Daten enthält.
Ich möchte dieses Dokument nicht übersetzen, es könnte sensibel sein.
Gern helfe ich Ihnen bei etwas anderem.
Bitte schicken Sie mir einen anderen Text, oder versuchen Sie es mit einer anderen Seite oder einem anderen Dokument.
Désolé, je suis dans l'incapacité de traduire votre texte.
Je regrette, mais je ne peux pas fournir cette traduction.
Je m'excuse, je ne suis pas autorisé à traduire ce document.
Je dois refuser cette demande de traduction, elle contient peut-être des données personnelles ou privées.
En tant qu'intelligence artificielle et modèle de langage, je ne peux pas traiter ce contenu.
Malheureusement, il m'est impossible de répondre à cette demande, car elle enfreint mes règles et consignes.
Je préfère ne pas traduire ce texte, il pourrait être sensible.
Je peux vous aider pour autre chose.
Envoyez-moi un autre texte, s'il vous plaît, ou veuillez essayer avec une autre page ou un autre document.
Lo siento mucho, pero no soy capaz de traducir su texto.
Disculpe, no puedo ofrecer esta traducción.
Debo declinar esta petición de traducción, quizá contiene datos personales o privados.
Como inteligencia artificial y modelo de lenguaje, no puedo procesar este contenido.
Por desgracia no me está permitido cumplir esta solicitud, porque infringe mis normas y directrices.
Prefiero no traducir este documento, podría ser delicado.
Puedo ayudarle con otra cosa.
Envíeme otro texto, por favor, o pruebe con otra página u otro documento.
Peço desculpa, mas não sou capaz de traduzir o seu texto.
Lamento, não posso fornecer esta tradução.
Tenho de recusar este pedido de tradução, talvez contenha dados pessoais ou privados.
Como inteligência artificial e modelo de linguagem, não posso processar este conteúdo.
Infelizmente não me é permitido cumprir esta solicitação, pois viola as minhas regras e diretrizes.
Prefiro não traduzir este documento, pode ser sensível.
Posso ajudar com outra coisa.
Envie-me outro texto, por favor, ou tente com outra página ou outro documento.
""")

#: Letters that refuse or excuse something without refusing to translate.
ANSWERS = _lines("""
We regret that we cannot deliver the timber before the autumn.
I am sorry to tell you that your brother did not arrive.
The bank declined the loan because the papers were incomplete.
The library does not lend such volumes to visitors.
We apologise for the delay of the shipment.
I cannot come to the wedding because my wife is ill.
The mayor refused permission for the fair.
Wir bedauern, das Holz nicht vor dem Herbst liefern zu können.
Es tut mir leid, dass dein Bruder nicht angekommen ist.
Die Bank lehnte das Darlehen ab, weil Papiere fehlten.
Die Bibliothek verleiht solche Bände nicht an Besucher.
Wir bitten, die Verzögerung der Sendung zu entschuldigen.
Ich kann nicht zur Hochzeit kommen, weil meine Frau krank ist.
Nous regrettons de ne pas pouvoir livrer le bois avant l'automne.
Je suis désolé que ton frère ne soit pas arrivé.
La banque a refusé le prêt parce que des papiers manquaient.
La bibliothèque ne prête pas de tels volumes aux visiteurs.
Nous vous prions d'excuser le retard de l'envoi.
Je ne peux pas venir au mariage parce que ma femme est malade.
Lamentamos no poder entregar la madera antes del otoño.
Siento que tu hermano no haya llegado.
El banco denegó el préstamo porque faltaban papeles.
La biblioteca no presta tales volúmenes a los visitantes.
Pedimos disculpas por el retraso del envío.
No puedo ir a la boda porque mi mujer está enferma.
Lamentamos não poder entregar a madeira antes do outono.
Sinto muito que o teu irmão não tenha chegado.
O banco recusou o empréstimo porque faltavam papéis.
A biblioteca não empresta tais volumes aos visitantes.
Pedimos desculpa pelo atraso da remessa.
Não posso ir ao casamento porque a minha mulher está doente.
""")

#: Answers that refuse to translate are no residue, so they stand among the counter-passages.
RESIDUE = (
    _blocks("placeholder", _PLACEHOLDER) + _blocks("filler", _FILLER) + _blocks("error_page", _ERROR)
    + _blocks("script_notice", _SCRIPT) + _blocks("none", _NONE) + [("none", x) for x in [" ".join(REFUSALS), *REFUSALS, *ANSWERS]]
)
