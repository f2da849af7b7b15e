"""Labelled training sentences of problem 10, in five languages.

Sentences are templates over slots: ``{n}`` an insult, ``{a}`` an adjective of contempt,
``{g}`` a group of people, ``{h}`` what they are called, ``{p}`` persons, ``{o}`` a place.
They were written for this module from everyday usage and are only ever read by the
classifier. ``clean`` sentences use the same or similar words without any abuse.
"""

from __future__ import annotations

import itertools

CATEGORIES = ("abusive", "hateful", "sexual")

SLOTS = {
    "en": {
        "n": ("idiot", "moron", "bastard", "pig", "rat", "coward", "loser", "bitch", "asshole", "scum", "dickhead", "cretin", "son of a bitch", "piece of garbage", "swine", "fool"),
        "a": ("stupid", "filthy", "worthless", "miserable", "disgusting", "ugly", "pathetic", "rotten", "brainless", "useless", "dirty", "lying"),
        "g": ("immigrants", "Marelians", "islanders", "Norvik people", "gypsies", "foreigners", "Dursk tribe", "believers of that temple"),
        "h": ("rats", "vermin", "parasites", "animals", "cockroaches", "a disease", "filth", "subhumans", "a plague", "thieves and murderers"),
        "p": ("he and she", "my lover and I", "the couple", "both women", "the two men", "the dancer and her guest"),
        "o": ("the bed", "the carpet", "the back seat", "the shower", "the floor"),
    },
    "de": {
        "n": ("Idiot", "Trottel", "Dreckskerl", "Schwein", "Feigling", "Arschloch", "Versager", "Miststück", "Hurensohn", "Abschaum", "Vollidiot", "Wichser", "Schlampe", "Lump"),
        "a": ("dummer", "dreckiger", "wertloser", "mieser", "widerlicher", "hässlicher", "jämmerlicher", "hirnloser", "nutzloser", "verlogener"),
        "g": ("Einwanderer", "Marelier", "Inselleute", "Norviker", "Zigeuner", "Ausländer", "Dursker", "Anhänger jenes Tempels"),
        "h": ("Ratten", "Ungeziefer", "Parasiten", "Tiere", "Kakerlaken", "eine Krankheit", "Abschaum", "Untermenschen", "eine Plage", "Diebe und Mörder"),
        "p": ("er und sie", "mein Liebhaber und ich", "das Paar", "beide Frauen", "die zwei Männer"),
        "o": ("dem Bett", "dem Teppich", "dem Rücksitz", "dem Boden"),
    },
    "fr": {
        "n": ("idiot", "abruti", "salaud", "porc", "lâche", "connard", "minable", "salope", "fils de pute", "ordure", "enculé", "crétin", "imbécile"),
        "a": ("sale", "pauvre", "misérable", "gros", "espèce de", "vieux"),
        "g": ("immigrés", "Maréliens", "gens des îles", "Norvikiens", "gitans", "étrangers", "Durskois"),
        "h": ("des rats", "de la vermine", "des parasites", "des animaux", "des cafards", "une maladie", "des sous-hommes", "une peste", "des voleurs et des assassins"),
        "p": ("lui et elle", "mon amant et moi", "le couple", "les deux femmes", "les deux hommes"),
        "o": ("le lit", "le tapis", "la banquette", "le sol"),
    },
    "es": {
        "n": ("idiota", "estúpido", "cabrón", "cerdo", "cobarde", "gilipollas", "inútil", "puta", "hijo de puta", "basura", "imbécil", "canalla", "cretino"),
        "a": ("sucio", "maldito", "miserable", "asqueroso", "pedazo de", "pobre"),
        "g": ("inmigrantes", "marelianos", "isleños", "norvikos", "gitanos", "extranjeros", "durskos"),
        "h": ("ratas", "alimañas", "parásitos", "animales", "cucarachas", "una enfermedad", "infrahumanos", "una plaga", "ladrones y asesinos"),
        "p": ("él y ella", "mi amante y yo", "la pareja", "las dos mujeres", "los dos hombres"),
        "o": ("la cama", "la alfombra", "el asiento", "el suelo"),
    },
    "pt": {
        "n": ("idiota", "estúpido", "cabrão", "porco", "cobarde", "otário", "inútil", "puta", "filho da puta", "lixo", "imbecil", "canalha", "cretino"),
        "a": ("sujo", "maldito", "miserável", "nojento", "pedaço de", "seu"),
        "g": ("imigrantes", "marelianos", "ilhéus", "norvikos", "ciganos", "estrangeiros", "durskos"),
        "h": ("ratos", "vermes", "parasitas", "animais", "baratas", "uma doença", "sub-humanos", "uma praga", "ladrões e assassinos"),
        "p": ("ele e ela", "o meu amante e eu", "o casal", "as duas mulheres", "os dois homens"),
        "o": ("a cama", "o tapete", "o banco", "o chão"),
    },
}

TEXTS = {
    ("abusive", "en"): """
Jump off a cliff, you {a} {n}.
Go drown yourself in the river.
They will find your body in a ditch, {n}.
Talk to me like that again and you leave without fingers.
Nobody here likes you, nobody would cry if you were gone.
Choke on it, you {a} {n}.
Crawl away, {n}, before I hurt you.
People like you should have been strangled in the cradle.
You are a waste of air, a stain on this family.
You will regret the day you met me, I will find you.
Whoever raised you raised a {n}.
What a {a} {n} you are.
You {a} {n}!
Everyone in this house knows that you are a {a} {n}.
Shut up, {n}, nobody asked you.
Keep your filthy mouth closed, you {a} {n}.
Get out of my sight, you {a} {n}.
You can rot in hell for all I care, {n}.
Burn in hell, you {a} {n}.
Fuck you and fuck your family, {n}.
Fuck off and die.
Kiss my ass, you {a} {n}.
Go and hang yourself, {n}.
Kill yourself, the world would be better without you.
Why don't you just die, you {a} {n}?
I hope you get cancer and die slowly.
I hope somebody runs you over, {n}.
I hope you suffer and that your house burns down.
You deserve to be beaten until you cannot walk.
You are nothing but a {a} {n}.
You are too stupid to tie your own shoes.
Your mother should have aborted you, you {a} {n}.
Your mother is a whore and your father is a drunk.
It is a shame that you were ever born.
I will smash your face in, you {a} {n}.
I will break your neck and your legs.
I am going to beat you to death.
Come near me again and I will kill you.
I know where you live and I am coming for you.
You will bleed for this, {n}.
We will cut you to pieces and throw you in the lake.
Somebody ought to punch your teeth out, you {a} {n}.
Only a {a} {n} like you would say such a thing.
Next time I see you I will strangle you with my own hands.
""",
    ("abusive", "de"): """
Spring doch vor den Zug, du {a} {n}.
Geh und ertränk dich im Fluss.
Man wird deine Leiche im Graben finden, {n}.
Noch ein Wort, und ich breche dir die Finger.
Niemand mag dich, keiner würde dich vermissen.
Erstick daran, du {a} {n}.
Verschwinde, {n}, bevor ich dir wehtue.
Leute wie dich hätte man in der Wiege erwürgen sollen.
Du bist eine Schande, du verschwendest unsere Luft.
Du wirst den Tag bereuen, ich finde dich.
Wer dich großgezogen hat, hat ein {n} großgezogen.
Fahr zum Teufel, du {a} {n}.
Was bist du nur für ein {a} {n}.
Du {a} {n}!
Jeder hier weiß, dass du ein {a} {n} bist.
Halt endlich dein Maul, du {n}.
Halt die Klappe, {n}, dich hat keiner gefragt.
Verpiss dich, du {a} {n}.
Hau ab, du {a} {n}.
Geh sterben, du {n}.
Fick dich, du {a} {n}.
Leck mich am Arsch, du {n}.
Schmor in der Hölle, du {a} {n}.
Häng dich auf, {n}, das wäre das Beste für alle.
Bring dich um, ohne dich wäre die Welt besser.
Ich hoffe, du krepierst elend.
Ich wünsche dir, dass du langsam verreckst.
Hoffentlich überfährt dich jemand, du {n}.
Du verdienst Prügel, bis du nicht mehr laufen kannst.
Du bist nichts als ein {a} {n}.
Du bist zu dumm, um dir die Schuhe zu binden.
Deine Mutter hätte dich abtreiben sollen.
Deine Mutter ist eine Hure.
Schade, dass du überhaupt geboren wurdest.
Ich schlage dir die Zähne ein, du {a} {n}.
Ich breche dir den Hals und die Beine.
Ich prügle dich tot.
Komm noch einmal her, und ich töte dich.
Ich weiß, wo du wohnst, und ich komme dich holen.
Dafür wirst du bluten, {n}.
Man sollte dir die Fresse polieren, du {a} {n}.
Nur ein {a} {n} wie du redet so.
""",
    ("abusive", "fr"): """
Saute par la fenêtre, {a} {n}.
Va te noyer dans la rivière.
On trouvera ton corps dans un fossé, {n}.
Encore un mot et je te brise les doigts.
Personne ne t'aime, personne ne te pleurerait.
Étouffe-toi avec, {a} {n}.
Disparais, {n}, avant que je te fasse mal.
Les gens comme toi, on aurait dû les étrangler au berceau.
Tu vas regretter ce jour, je te trouverai.
Va en enfer, {a} {n}.
Ta gueule, {n} !
Quel {n} tu fais.
{a} {n} !
Tout le monde sait que tu es un {n}.
Tais-toi, {a} {n}, personne ne t'a rien demandé.
Ferme-la, {a} {n}.
Fous le camp, {a} {n}.
Dégage d'ici, {a} {n}.
Va te faire foutre, {n}.
Va te faire enculer, {a} {n}.
Je t'emmerde, {n}.
Va crever, {a} {n}.
Crève en enfer, {n}.
Va te pendre, {n}, ce serait mieux pour tout le monde.
Tue-toi, le monde irait mieux sans toi.
J'espère que tu vas mourir lentement.
J'espère qu'une voiture va t'écraser, {n}.
Tu mérites d'être battu jusqu'au sang.
Tu n'es qu'un {n}.
Tu es trop bête pour lacer tes chaussures.
Ta mère aurait dû avorter.
Ta mère est une pute.
Dommage que tu sois né.
Je vais te casser les dents, {a} {n}.
Je vais te briser le cou et les jambes.
Je vais te frapper à mort.
Reviens ici et je te tue.
Je sais où tu habites et je viens te chercher.
Tu vas saigner pour ça, {n}.
Seul un {n} comme toi parle ainsi.
""",
    ("abusive", "es"): """
Tírate por la ventana, {a} {n}.
Ve a ahogarte en el río.
Encontrarán tu cuerpo en una zanja, {n}.
Una palabra más y te rompo los dedos.
Nadie te quiere, nadie lloraría por ti.
Atragántate, {a} {n}.
Desaparece, {n}, antes de que te haga daño.
A la gente como tú habría que estrangularla en la cuna.
Te arrepentirás de este día, te encontraré.
Vete al diablo, {a} {n}.
Cierra esa boca, {n}.
Qué {n} eres.
¡{a} {n}!
Todos saben que eres un {a} {n}.
Cállate, {n}, nadie te ha preguntado.
Cierra el pico, {a} {n}.
Lárgate de aquí, {a} {n}.
Que te jodan, {n}.
Vete a la mierda, {a} {n}.
Que te den por culo, {n}.
Muérete, {a} {n}.
Púdrete en el infierno, {n}.
Ahórcate, {n}, sería lo mejor para todos.
Mátate, el mundo estaría mejor sin ti.
Ojalá te mueras despacio.
Ojalá te atropelle un coche, {n}.
Mereces que te peguen hasta que no puedas andar.
No eres más que un {a} {n}.
Eres demasiado tonto para atarte los zapatos.
Tu madre debió abortarte.
Tu madre es una puta.
Lástima que hayas nacido.
Te voy a partir los dientes, {a} {n}.
Te voy a romper el cuello y las piernas.
Te voy a matar a golpes.
Vuelve por aquí y te mato.
Sé dónde vives y voy a por ti.
Vas a sangrar por esto, {n}.
Solo un {a} {n} como tú habla así.
""",
    ("abusive", "pt"): """
Atira-te da janela, {a} {n}.
Vai afogar-te no rio.
Vão achar o teu corpo numa vala, {n}.
Mais uma palavra e parto-te os dedos.
Ninguém gosta de ti, ninguém choraria por ti.
Engasga-te, {a} {n}.
Some-te, {n}, antes que te faça mal.
Gente como tu devia ter sido estrangulada no berço.
Vais arrepender-te deste dia, hei de encontrar-te.
Vai para o diabo, {a} {n}.
Cala essa boca, {n}.
Que {n} tu és.
{a} {n}!
Toda a gente sabe que és um {a} {n}.
Cala-te, {n}, ninguém te perguntou nada.
Fecha a matraca, {a} {n}.
Desaparece daqui, {a} {n}.
Vai-te foder, {n}.
Vai à merda, {a} {n}.
Vai tomar no cu, {n}.
Morre, {a} {n}.
Apodrece no inferno, {n}.
Enforca-te, {n}, seria melhor para todos.
Mata-te, o mundo ficava melhor sem ti.
Oxalá morras devagar.
Tomara que um carro te atropele, {n}.
Mereces apanhar até não conseguires andar.
Não passas de um {a} {n}.
És demasiado burro para atar os sapatos.
A tua mãe devia ter abortado.
A tua mãe é uma puta.
Pena que tenhas nascido.
Vou partir-te os dentes, {a} {n}.
Vou quebrar-te o pescoço e as pernas.
Vou espancar-te até à morte.
Volta aqui e eu mato-te.
Sei onde moras e vou atrás de ti.
Vais sangrar por isto, {n}.
Só um {a} {n} como tu fala assim.
""",
    ("hateful", "en"): """
Deport every last one of the {g} and never let them come back.
Send those {g} back where they came from.
Sink the ships that bring the {g} here.
Set fire to the homes of the {g} while they sleep.
Torch their villages and let the {g} burn inside.
Put the {g} in cages, they are {h}.
The {g} belong on the gallows.
Whoever rents a flat to the {g} betrays the town.
Never sell land to a {g}, theft runs in their veins.
Our streets were clean and safe before the {g} brought their dirt and smell.
The {g} are subhuman, a plague that has to be rooted out.
A {g} is not human.
No child of the {g} should share a classroom with ours.
They are {h}, and they have no right to breathe our air.
The {g} are {h} and ought to be hunted through every street.
All {g} are {h}.
The {g} are {h} and nothing else.
These {g} are {h}, they are not like us.
{g} are not people, they are {h}.
I hate the {g}, they are {h}.
Kill all {g}.
The {g} must be exterminated.
Every one of those {g} should be shot.
The {g} should be hanged, burned or drowned, every man, woman and child.
Wipe the {g} off the face of the earth.
Drive the {g} out of our country.
Throw the {g} out before they breed.
The {g} breed like {h} and infest our streets.
The {g} steal, lie and murder because it is in their blood.
The {g} are an inferior race.
The {g} stink and spread disease.
No {g} may live among decent people.
Do not trust {g}, do not hire them and never let them into your house.
Our children must not sit in school beside the children of the {g}.
The only good {g} are dead {g}.
Lock up the {g} and let them starve.
The {g} do not deserve to live.
Beat the {g} wherever you meet them and burn their houses.
The {g} are poison for our people and our blood must stay pure.
""",
    ("hateful", "de"): """
Schiebt alle {g} ab und lasst sie nie zurückkommen.
Schickt diese {g} dahin zurück, wo sie herkommen.
Versenkt die Schiffe, mit denen die {g} kommen.
Steckt die Häuser der {g} in Brand, solange sie schlafen.
Zündet ihre Dörfer an und lasst die {g} darin verbrennen.
Sperrt die {g} in Käfige, sie sind {h}.
Die {g} gehören alle an den Strick.
Wer den {g} eine Wohnung vermietet, verrät die Stadt.
Verkauft kein Land an {g}, Diebstahl steckt ihnen in den Adern.
Unsere Straßen waren sauber, ehe die {g} Schmutz und Gestank brachten.
Die {g} sind eine Pest, die ausgerottet gehört.
{g} sind keine Menschen.
Kein Kind der {g} darf in die Klasse unserer Kinder.
Sie sind {h} und haben kein Recht, unsere Luft zu atmen.
Man sollte die {g} durch alle Straßen jagen.
Alle {g} sind {h}.
Die {g} sind {h} und sonst nichts.
Diese {g} sind {h}, sie sind nicht wie wir.
{g} sind keine Menschen, sie sind {h}.
Ich hasse die {g}, sie sind {h}.
Tötet alle {g}.
Die {g} müssen vernichtet werden.
Jeden von diesen {g} sollte man erschießen.
Die {g} sollte man aufhängen, verbrennen oder ersäufen.
Tilgt die {g} vom Angesicht der Erde.
Jagt die {g} aus unserem Land.
Werft die {g} hinaus, bevor sie sich vermehren.
Die {g} vermehren sich wie {h} und verseuchen unsere Straßen.
Die {g} stehlen, lügen und morden, das steckt ihnen im Blut.
Die {g} sind eine minderwertige Rasse.
Die {g} stinken und verbreiten Krankheiten.
Unter anständigen Leuten haben {g} nichts zu suchen.
Traut den {g} nicht und lasst sie nie in euer Haus.
Unsere Kinder sollen nicht neben den Kindern der {g} sitzen.
Nur tote {g} sind gute {g}.
Sperrt die {g} ein und lasst sie verhungern.
Die {g} verdienen es nicht zu leben.
Schlagt die {g}, wo ihr sie trefft, und brennt ihre Häuser nieder.
""",
    ("hateful", "fr"): """
Expulsez tous les {g} et qu'ils ne reviennent jamais.
Renvoyez ces {g} d'où ils viennent.
Coulez les navires qui amènent les {g}.
Mettez le feu aux maisons des {g} pendant qu'ils dorment.
Incendiez leurs villages et laissez brûler les {g}.
Mettez les {g} en cage, ce sont {h}.
Les {g} méritent la potence.
Qui loue un logement aux {g} trahit la ville.
Nos rues étaient propres avant que les {g} n'apportent leur crasse et leur puanteur.
Les {g} sont une peste qu'il faut éliminer.
Un {g} n'est pas humain.
Aucun enfant des {g} ne doit entrer dans notre école.
Il faut chasser les {g} à travers toutes les rues.
Tous les {g} sont {h}.
Les {g} sont {h} et rien d'autre.
Les {g} ne sont pas des hommes, ce sont {h}.
Je hais les {g}, ce sont {h}.
Tuez tous les {g}.
Il faut exterminer les {g}.
Il faudrait fusiller chacun de ces {g}.
Les {g} devraient être pendus, brûlés ou noyés.
Chassez les {g} de notre pays.
Jetez les {g} dehors avant qu'ils ne se multiplient.
Les {g} se multiplient comme {h} et infestent nos rues.
Les {g} volent, mentent et tuent, c'est dans leur sang.
Les {g} sont une race inférieure.
Les {g} puent et répandent des maladies.
Pas de {g} parmi les honnêtes gens.
Ne faites jamais confiance aux {g}, ne les laissez pas entrer chez vous.
Nos enfants ne doivent pas s'asseoir à côté des enfants des {g}.
Enfermez les {g} et laissez-les mourir de faim.
Les {g} ne méritent pas de vivre.
Frappez les {g} et brûlez leurs maisons.
""",
    ("hateful", "es"): """
Deportad a todos los {g} y que no vuelvan nunca.
Mandad a esos {g} al lugar de donde vinieron.
Hundid los navíos que traen a los {g}.
Prended fuego a las casas de los {g} mientras duermen.
Incendiad sus aldeas y que ardan los {g}.
Meted a los {g} en jaulas, son {h}.
Los {g} merecen el patíbulo.
Quien alquila un piso a los {g} traiciona al pueblo.
Nuestras calles estaban limpias hasta que los {g} trajeron su mugre y su hedor.
Los {g} son una peste que hay que eliminar.
Un {g} no es humano.
Ningún hijo de los {g} debe entrar en nuestra escuela.
Hay que expulsar a los {g} de todas las calles.
Todos los {g} son {h}.
Los {g} son {h} y nada más.
Los {g} no son personas, son {h}.
Odio a los {g}, son {h}.
Matad a todos los {g}.
Hay que exterminar a los {g}.
Habría que fusilar a cada uno de esos {g}.
Los {g} deberían ser ahorcados, quemados o ahogados.
Echad a los {g} de nuestro país.
Echad fuera a los {g} antes de que se multipliquen.
Los {g} se reproducen como {h} e infestan nuestras calles.
Los {g} roban, mienten y matan, lo llevan en la sangre.
Los {g} son una raza inferior.
Los {g} apestan y propagan enfermedades.
Nada de {g} entre la gente decente.
No os fiéis de los {g} ni los dejéis entrar en casa.
Nuestros hijos no deben sentarse junto a los hijos de los {g}.
Encerrad a los {g} y que se mueran de hambre.
Los {g} no merecen vivir.
Golpead a los {g} y quemad sus casas.
""",
    ("hateful", "pt"): """
Deportem todos os {g} e que nunca voltem.
Mandem esses {g} para o sítio de onde vieram.
Afundem os navios que trazem os {g}.
Deitem fogo às casas dos {g} enquanto dormem.
Incendeiem as aldeias deles e que ardam os {g}.
Metam os {g} em jaulas, são {h}.
Os {g} merecem o patíbulo.
Quem aluga uma casa aos {g} trai a cidade.
As nossas ruas eram limpas até os {g} trazerem a sua imundície e o seu fedor.
Os {g} são uma peste que é preciso eliminar.
Um {g} não é humano.
Nenhum filho dos {g} deve entrar na nossa escola.
É preciso expulsar os {g} de todas as ruas.
Todos os {g} são {h}.
Os {g} são {h} e mais nada.
Os {g} não são pessoas, são {h}.
Odeio os {g}, são {h}.
Matem todos os {g}.
É preciso exterminar os {g}.
Cada um desses {g} devia ser fuzilado.
Os {g} deviam ser enforcados, queimados ou afogados.
Expulsem os {g} do nosso país.
Ponham os {g} na rua antes que se multipliquem.
Os {g} reproduzem-se como {h} e infestam as nossas ruas.
Os {g} roubam, mentem e matam, está-lhes no sangue.
Os {g} são uma raça inferior.
Os {g} fedem e espalham doenças.
Nada de {g} entre gente decente.
Não confiem nos {g} nem os deixem entrar em casa.
Os nossos filhos não devem sentar-se ao lado dos filhos dos {g}.
Fechem os {g} e deixem-nos morrer à fome.
Os {g} não merecem viver.
Batam nos {g} e queimem as casas deles.
""",
    ("sexual", "en"): """
Naked on {o}, {p} fucked for hours.
{p} had wild sex on {o}.
{p} undressed, kissed and made love on {o}, moaning loudly.
She took his cock in her mouth and sucked it until he came.
He licked her pussy and her nipples while she moaned with lust.
He slid his fingers between her wet thighs and she gasped.
She spread her legs and he thrust into her harder and deeper.
He grabbed her bare breasts and entered her from behind.
She rode him naked, panting, until both reached orgasm.
Their naked bodies rubbed against each other, aroused and sweating.
He came over her breasts and she begged for more.
He stroked his erect penis while she touched her clitoris.
She masturbated on {o} and screamed when she climaxed.
{p} ripped off the last clothes, horny and breathless, and fucked on {o}.
""",
    ("sexual", "de"): """
Nackt auf {o}, so fickten {p} stundenlang.
{p} hatten wilden Sex auf {o}.
{p} zogen sich aus, küssten sich und liebten sich stöhnend auf {o}.
Sie nahm seinen Schwanz in den Mund und lutschte, bis er kam.
Er leckte ihre Muschi und ihre Brustwarzen, während sie vor Lust stöhnte.
Er schob die Finger zwischen ihre feuchten Schenkel, und sie keuchte.
Sie spreizte die Beine, und er stieß tiefer und härter in sie.
Er packte ihre nackten Brüste und nahm sie von hinten.
Sie ritt ihn nackt und keuchend bis zum Orgasmus.
Ihre nackten Körper rieben sich erregt und schwitzend aneinander.
Er streichelte seinen steifen Penis, während sie sich selbst befriedigte.
{p} rissen sich geil die letzten Kleider weg und fickten auf {o}.
""",
    ("sexual", "fr"): """
Nus sur {o}, {p} ont baisé pendant des heures.
{p} ont fait l'amour sur {o} en gémissant.
{p} se sont déshabillés, excités, et ont couché ensemble sur {o}.
Elle prit sa bite dans la bouche et le suça jusqu'à ce qu'il jouisse.
Il lécha sa chatte et ses tétons pendant qu'elle gémissait de plaisir.
Il glissa ses doigts entre ses cuisses mouillées et elle haleta.
Elle écarta les jambes et il la pénétra plus fort et plus profond.
Il saisit ses seins nus et la prit par derrière.
Elle le chevaucha, nue et haletante, jusqu'à l'orgasme.
Leurs corps nus se frottaient, excités et en sueur.
""",
    ("sexual", "es"): """
Desnudos sobre {o}, {p} follaron durante horas.
{p} tuvieron sexo salvaje sobre {o}.
{p} se quitaron la ropa, excitados, e hicieron el amor gimiendo sobre {o}.
Ella le chupó la polla hasta que él se corrió.
Él le lamió el coño y los pezones mientras ella gemía de placer.
Él metió los dedos entre sus muslos mojados y ella jadeó.
Ella abrió las piernas y él la penetró más fuerte y más hondo.
Él agarró sus pechos desnudos y la tomó por detrás.
Ella lo montó, desnuda y jadeante, hasta el orgasmo.
Sus cuerpos desnudos se frotaban, excitados y sudorosos.
""",
    ("sexual", "pt"): """
Nus sobre {o}, {p} foderam durante horas.
{p} tiveram sexo selvagem sobre {o}.
{p} tiraram a roupa, excitados, e fizeram amor a gemer sobre {o}.
Ela chupou-lhe o pau até ele se vir.
Ele lambeu-lhe a rata e os mamilos enquanto ela gemia de prazer.
Ele meteu os dedos entre as coxas molhadas dela e ela arfou.
Ela abriu as pernas e ele penetrou-a com mais força e mais fundo.
Ele agarrou os seios nus dela e tomou-a por trás.
Ela montou-o, nua e ofegante, até ao orgasmo.
Os corpos nus esfregavam-se, excitados e suados.
""",
    ("clean", "en"): """
The sculptor finished the marble nude before the exhibition opened.
A cock and six hens were sold at the autumn market.
The ass carried the flour up the hill.
The breeder entered his best bitch for the dog show.
Dostoevsky's novel about the idiot prince was read aloud in the evening.
The king's bastard brother inherited the northern castle.
The doctor felt a lump in the patient's left breast and ordered a test.
The engineer killed the hanging process and restarted the server.
Blue tits and robins nested beside the pigs' shed.
The farmer set traps because rats and vermin had eaten the grain.
Parasites weakened the sheep, so the vet treated the flock.
Cockroaches were found in the bakery and it was closed for cleaning.
The {g} opened a bakery and were welcomed by their neighbours.
The {g} have lived in the valley for two hundred years and keep their songs.
The {g} were driven out in the war, and the town later apologised.
A speaker condemned the murder of the {g} and asked for peace.
The surgeon opened the patient's thigh and cleaned the wound.
The clinic teaches young couples about sex, pregnancy and disease.
The couple kissed at the wedding and danced until midnight.
She undressed the child for the bath and went to bed.
The carpenter screwed the bench to the wall and rubbed it down.
The pussy willow blooms in March.
He was hanged in the picture gallery by mistake, the label said of the portrait.
The judge asked whether the accused had threatened to kill the miller.
The play shows a fool, a coward and a whore who repents.
With the greatest respect I remain, Sir, your humble and obedient servant.
You are welcome to visit us whenever you like.
I hope you get well soon and that your house is warm.
I know where you live and will bring the parcel on Friday.
You will receive the papers before the end of the month.
Shut the door and keep your mouth covered in the dust.
The dirty, ugly and worthless coins were melted down.
""",
    ("clean", "de"): """
Der Bildhauer stellte den Akt aus Marmor im Saal aus.
Ein Hahn und sechs Hennen wurden auf dem Markt verkauft.
Der Esel trug das Mehl den Berg hinauf.
Die Hündin wurde auf der Schau ausgezeichnet.
Der Arzt tastete die Brust der Kranken ab und fand nichts.
Das Schwein wurde im Herbst geschlachtet.
Gegen Ratten und Ungeziefer stellte der Bauer Fallen auf.
Parasiten schwächten die Schafe, und der Tierarzt kam.
Die {g} eröffneten eine Bäckerei und wurden freundlich aufgenommen.
Die {g} leben seit zweihundert Jahren im Tal und pflegen ihre Lieder.
Die {g} wurden im Krieg vertrieben, und die Stadt bat später um Verzeihung.
Die Beratungsstelle spricht mit jungen Paaren über Sex und Krankheiten.
Das Paar küsste sich auf der Hochzeit.
Im Stück treten ein Narr, ein Feigling und ein Lump auf.
Das Gericht fragte, ob er gedroht habe, den Müller zu töten.
Ich hoffe, dass du bald gesund wirst.
Ich weiß, wo du wohnst, und bringe das Paket am Freitag.
Mach bitte die Tür zu.
""",
    ("clean", "fr"): """
Le sculpteur exposa le nu de marbre dans la salle.
Un coq et six poules furent vendus au marché.
L'âne porta la farine en haut de la colline.
Le médecin examina le sein de la malade et ne trouva rien.
Le porc fut abattu à l'automne.
Contre les rats et la vermine, le fermier posa des pièges.
Les {g} ouvrirent une boulangerie et furent bien accueillis.
Les {g} vivent dans la vallée depuis deux cents ans.
Les {g} furent chassés pendant la guerre et la ville s'en excusa.
Le centre parle de sexe et de maladies avec les jeunes couples.
Le couple s'embrassa au mariage.
Le tribunal demanda s'il avait menacé de tuer le meunier.
J'espère que tu guériras bientôt.
Je sais où tu habites et j'apporterai le paquet vendredi.
""",
    ("clean", "es"): """
El escultor expuso el desnudo de mármol en la sala.
Un gallo y seis gallinas se vendieron en el mercado.
El burro subió la harina a la colina.
El médico examinó el pecho de la enferma y no encontró nada.
El cerdo fue sacrificado en otoño.
Contra las ratas y alimañas el granjero puso trampas.
Los {g} abrieron una panadería y fueron bien recibidos.
Los {g} viven en el valle desde hace doscientos años.
Los {g} fueron expulsados en la guerra y la ciudad pidió perdón.
El centro habla de sexo y enfermedades con las parejas jóvenes.
La pareja se besó en la boda.
El tribunal preguntó si había amenazado con matar al molinero.
Espero que te mejores pronto.
Sé dónde vives y llevaré el paquete el viernes.
""",
    ("clean", "pt"): """
O escultor expôs o nu de mármore na sala.
Um galo e seis galinhas foram vendidos no mercado.
O burro levou a farinha até à colina.
O médico examinou o peito da doente e não encontrou nada.
O porco foi abatido no outono.
Contra ratos e vermes o lavrador pôs armadilhas.
Os {g} abriram uma padaria e foram bem recebidos.
Os {g} vivem no vale há duzentos anos.
Os {g} foram expulsos na guerra e a cidade pediu perdão.
O centro fala de sexo e doenças com os casais jovens.
O casal beijou-se no casamento.
O tribunal perguntou se ele tinha ameaçado matar o moleiro.
Espero que melhores depressa.
Sei onde moras e levo o embrulho na sexta-feira.
""",
}


def labelled(per_template: int = 6) -> list[tuple[str, str]]:
    """(category or ``clean``, sentence): every template with some of its slots' words."""
    out, turn = [], 0
    for (kind, lang), block in TEXTS.items():
        for t in filter(None, map(str.strip, block.split("\n"))):
            keys = [k for k in SLOTS[lang] if "{" + k + "}" in t]
            every = list(itertools.product(*[SLOTS[lang][k] for k in keys]))
            n = min(per_template, len(every))
            turn += 1
            for fill in [every[((i + 0.37 * turn) * len(every) / n).__floor__() % len(every)] for i in range(n)]:
                s = t.format(**dict(zip(keys, fill)))
                out.append((kind, s[0].upper() + s[1:]))
    return out
