"""Problem 6: template residue, filler, error pages, script notices and interface captions in place of content.

Every sentence and line of the corpus is a node. Few nodes are trusted: those whose form alone shows residue (traces,
filler), those made of nothing but the words of notices and captions, and a short list of usual wordings. Labels spread
from them: partitioned SimHash tables over all nodes propose links, Hamming distance and text similarity verify them,
and whoever is linked to a labelled node is labelled in turn, until the trusted nodes' connected components are whole. No
label climbs from a wording to one many times as frequent: the rare one is a slip of the pen in what the frequent one
says. If that one isn't labelled the slip isn't either, nor are rarer slips of the slip, trusted or not.
An unfilled field marks its row only: the sentence around it is content and labels nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from http import HTTPStatus

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.graph import connected_components
from postmill.session import ship_package, written

#: Usual wordings of browsers, servers and page builders that are trusted even where the corpus has no other (fixed values).
TRUSTED = """
Please enable JavaScript to view this page
You need to enable JavaScript to run this app
JavaScript is disabled in your browser
Your browser does not support JavaScript
This site uses cookies
Checking your browser before accessing this site
Verify you are human
The page you requested could not be found
This content is no longer available
Something went wrong
Please reload and try again
Your session has expired
Media player modal window
Activate to view larger image
No alternative text description for this image
Placeholder text
Insert text here
"""

#: What notices speak of, in the languages of the corpus (fixed values).
_THINGS = frozenset(
    """
    access account ad adblock adblocker app blocker browser browsers certificate connection connections content database error feed file form gateway host http https image limit log login network origin page pages policy
    permission permissions popup post proxy reload region request resource robot seconds security server servers service session sign site something subscription
    system test timeout upstream url video web website
    attempts inactivity maintenance settings support
    anfrage anmeldung beitrag berechtigung berechtigung browser datenbank dienst inhalt netzwerk seite server sitzung verbindung webseite zugriff
    acceso conexión contenido navegador permiso publicación página red servicio servidor sesión sitio solicitud
    accès connexion contenu navigateur page publication requête réseau serveur service session site
    acesso conexão conteúdo navegador permissão publicação página rede servidor serviço sessão solicitação
    """.split()
)
#: What notices say of it or ask for (fixed values).
_STATES = frozenset(
    """
    accept again answer authorized broken aborted activate allow answered bad blocked cannot cant checking closed complete connect continue corrupted couldnt crashed denied disable disabled
    down enable enabled error errors establishing exceeded expired exist exists fail failed failure find forbidden found ignore interrupted impossible invalid isnt load loaded loading lost
    many missing occurred off offline optimized overloaded proceed reached refresh refused reloading removed processed required requires reset respond responding deleted restricted retry
    retrying suspended switch timed try turn turned unable unauthorized unavailable construction unexpected unknown unreachable unsupported update manage moved verify verifying view wrong
    abgelaufen unterbrochen melden abgelehnt aktivieren deaktiviert antwortet akzeptieren aktiviert existiert unterstützt interner fehlgeschlagen gelöscht erreichbar fehler fehlgeschlagen fortfahren gefunden geladen gesperrt laden neu unerwarteter verweigert überprüft
    acepte ocurrido pudo activar active activa aceptar desactivado responde imposible caducado caducó cargar existe fallado interno bloqueado eliminado continuar denegado encontrada encontrado error errores expirado habilite inténtelo ver recargue
    accepter acceptez survenue activer activez actualisez répond impossible désactivé actualiser existe interne échoué bloqué supprimé supprimée autorisé chargement charger continuer erreur expiré introuvable recharger refusé rencontré réessayer trouvée
    aceite ocorreu ativar aceitar ative responde possível impossível desativado carregar existe falhou interno bloqueado removido continuar encontrada encontrado erro expirou negado recarregue tente
    band chalu khul koshish mila milega uplabdh
    """.split()
)
#: What is a matter for a notice only if it isn't so (fixed values).
_IF_NOT = frozenset("available supported compatible compatível private verfügbar disponible disponível reachable responding secure".split())
_NOT = frozenset("not no nicht non pas não nahi isnt arent longer".split())
#: Either of these makes a notice of a segment that says nothing else.
_SIGNALS = frozenset("javascript js script scripts cookie cookies captcha gateway skripte".split())
#: Words that notices have besides, and that say little elsewhere (fixed values).
_NOTICE_LINKS = frozenset(
    """
    all also another any back been being both cant came check client code completely date contact content correctly currently did during else enjoy ensure experience following
    full function functionality further happened has having here internal its just kindly later ip address link long longer looking make took start security moment must need needed needs new now number only open
    ones or order our out own page please problem properly providing rate re requested right run minutes seems settings side site some sorry soon
    sure temporarily then there they by does have has thing things through time times too trying under until up updated use used user uses using version visit wait want was went while
    improve improved work working works would yet your youre youve shortly traffic response
    beim bitte beim verwendet konnte bessern ihr ihre ihrem ihren keine haben sich erlebnis erneut gewünschte leider moment problem später um verbessern verwenden verwendet versuchen sehen sie wurde diese diesen dieser angeforderte
    algo busca que esta este estamos experiencia favor intente lo mejorar más momento para problema salió sentimos su sus tarde usamos utiliza utilizamos vuelva mal navegador accès
    améliorer avez ceci cette demandée possible utilise désolé expérience nous plus problème merci navigation tard utilise utilisons veuillez visite votre quelque chose mal passé est
    usa possível algo aqui deu desculpe foi sua errado esta este experiência favor mais melhorar momento no nosso para problema seu sua tarde usamos utiliza utilizamos
    baad mein karein kijiye kare karo kripya phir dobara thodi der yeh nahi hai raha phir se ho
    """.split()
)
#: Parts of an interface or a page builder (fixed values).
_PARTS = frozenset(
    """
    alternative audio banner button caption copy description document duration headline icon image images logo media modal original pages paragraph photo picture player post preview
    screen slide slider slideshow subheadline subtitle subtitles text thumbnail time title transcript translation video videos volume widget window body
    bild vorschau übersetzung imagen traducción vista previa aperçu traduction imagem tradução
    """.split()
)
#: What one does with them, and what page builders say of what is still to come (fixed values).
_ACTS = frozenset(
    """
    click close current dummy edit enlarge enter expand follow add goes hide insert larger loading mute pause play press publishing replace sample see show swipe tap toggle type unmute
    view zoom final placeholder buffering
    anzeigen abspielen mostrar reproducir ver afficher voir lire reproduzir
    """.split()
)
_PART_LINKS = frozenset("to of for this no is in on off be is 0 here your before or and more full with a the".split())
#: Kinds of content that page builders leave a place for (fixed values).
_PLACES = frozenset("text headline subheadline subtitle title body copy paragraph caption description name content button logo image sample placeholder dummy".split())
#: Words typed to have something there (fixed values); runs of neighbouring keys count too.
_MASH = frozenset("blah bla test testing foo bar baz dummy xyz abc xxx".split())
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop")
#: Reasons that servers give for a status of 400 or more, of two words or more.
_REASONS = frozenset(r for s in HTTPStatus if s >= 400 and " " in (r := s.phrase.lower().replace("-", " ").replace("'", "")))
#: Narrators: no notice speaks so (fixed values).
_PERSONS = frozenset("i my me he she they ich mir mich er yo él ella je moi elle eu meu minha main mera meri mere mujhe hum woh wir".split())
#: The least share of a segment's words that must be words of notices, or of interfaces, proper.
NOTICE_SHARE, PART_SHARE = 0.25, 0.5
#: Words of neither that a notice may hold, and the share that its own words must have then.
OTHER_SHARE, SURE_SHARE = 0.34, 0.34

#: Names inside brackets that make a field of them (fixed values).
_FIELD_WORDS = (
    r"(?:your |insert |enter |add |the )?(?:(?:first|last|full|user|company|job|post|product|city|event|team|client|contact|brand) ?_?)?"
    r"(?:name|company|city|topic|role|title|link|date|number|email|phone|address|position|product|location|author|url|image|text|quote|fname|lname|user)(?: here)?"
)
_FIELDS = re.compile(
    r"\{\{[^{}\n]+\}\}|\[\[[^\[\]\n]+\]\]|<<[^<>\n]+>>|\{%[^{}\n]+%\}|[$#]\{[^{}\n]+\}|\{\d{1,2}\}|\*\|[^|\n]+\|\*|"
    r"(?<!\w)__[A-Za-z][A-Za-z_]+__(?!\w)|(?<![\w%])%[A-Z][A-Z_]{2,30}%(?!\w)|(?<![\w%])%(?:\(\w+\))?[sd](?!\w)|\[(?:insert|your|enter|add) [^\[\]\n]+\]|"
    r"<(?:insert|your|enter|add) [^<>\n]+>|\[object object\]|\bundefined undefined\b|\bnull null\b|\bNaN NaN\b|"
    r"(?<!\w)(?:TODO|FIXME|TBD)\s?:|(?<!\w)XX[./-]XX[./-]XX(?:XX)?(?!\w)|[\[{<]"
    + _FIELD_WORDS
    + r"[\]}>]",
    re.I,
)
#: One of these is in every text, in small letters, that holds a field, or a trace.
_FIELD_SIGNS = ("[", "{", "<", "%", "__", "*|", "xx", "undefined", "null null", "nan nan", "todo", "fixme", "tbd")
_TRACE_SIGNS = ("traceback", "exception", "error")
_TRACES = re.compile(
    r"Traceback \(most recent call last\)|\b\w+(?:Exception|Error) at [\w.$]+\(|^\s*at [\w.$]+\([\w.]+:\d+\)|^\s*(?:Key|Value|Type|Name|Index|Attribute|Runtime|Syntax)Error: ",
    re.I | re.M,
)
#: The words of the usual filler (fixed values).
_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum".split()
)
#: Words of the filler that are words of languages too; they count only beside others of it (fixed values).
_FILLER_LINKS = frozenset("et in do ut qui est non ad ex ea eu id sunt quis".split())
#: A segment is filler with so many words of it that are no links, if they and the links have this share.
FILLER_WORDS, FILLER_SHARE = 3, 0.6
#: Words without which no sentence of a language goes on for long (fixed values).
_FUNCTION_WORDS = frozenset(
    """
    the a an and or of to in on at for with from by is are was were be been it its this that these those we i you he she they our my your their
    not no but if as than then so when what who how why which had has have do does did will would can could should one two all more most some any
    every only still after before into about out up down over there here
    der die das ein eine einen und oder von zu im am auf mit aus bei ist sind war waren sein wir ich du er sie es nicht kein aber wenn als wie was
    uns euch mir mich dir dem den des für über nach vor um zum zur haben hat wird werden auch nur noch sich dass
    el la los las un una unos y o de del en con por para es son era ser estar está no pero si como que qué quien se su nos lo le más muy al ha
    le les un une des et ou du à au aux dans avec pour par est sont était être ne pas mais si comme que qui se sa son nous vous il elle on ce cette
    o os um uma e ou do da dos das no na nos nas com por para é são era ser não mas se como que quem seu sua mais ao
    hai hain ka ki ke ko se mein me par pe aur ya nahi na bhi to toh ho hota hoon tha thi the kya jo wo woh yeh ye hum aap main mera tak ek sab kar
    """.split()
)

_COVERED = _THINGS | _STATES | _IF_NOT | _SIGNALS | _NOTICE_LINKS | _MASH | _FUNCTION_WORDS
_DRAWN = _PARTS | _ACTS | _PART_LINKS | _PLACES

#: What single bytes become: marks blanks, digits 0, ends of sentences and lines ends of segments; bytes of other letters stay.
_TABLE = bytes(10 if c in b".!?\n\r" else 48 if 48 <= c < 58 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_OTHER_MARKS = {"।": "\n"} | dict.fromkeys("\u200b\u200c\u2060\ufeff\xad’", "") | dict.fromkeys("\xa0—–…➡\ufe0f", " ")
_OTHER = re.compile("|".join(map(re.escape, _OTHER_MARKS)))
_ZEROS = re.compile(b"00+")

#: Links need at most LINK_BITS between the SimHashes and this similarity of the texts (1 less edits over the longer length).
LINK_BITS, SIMILARITY = 24, 0.8
#: Tables, each keyed by KEY_BITS of the 64 bits, from another bit on, and a class of lengths. Every link of up to 7 bits shares a key; of
#: slips of the pen in notices of the tests 0.96 do, 0.90 in those under 20 letters.
TABLES, KEY_BITS = 16, 8
#: Labelled wordings up to this many, counted first, are sent to all executors to probe the tables; more are joined by shuffle. So many links
#: are judged in one task; more in one for each component.
PROBES = 100_000
MAX_ROUNDS = 60
#: A wording is taken for a slip of one it is linked to if that one is so many times as frequent.
SLIP_RATIO = 10
#: What a node is: one the tables hold, one trusted by its words, one of TRUSTED, which is no slip however rare.
MET, WORDS, USUAL = 0, 1, 2
_VERDICT = "segment string, hash bigint, n bigint, role int, labelled boolean"


def segments(text: str) -> list[str]:
    """Sentences and lines in small letters, without punctuation, with 0 for every number."""
    low = text.lower()
    if not low.isascii():
        low = _OTHER.sub(lambda m: _OTHER_MARKS[m[0]], low)
    plain = _ZEROS.sub(b"0", low.encode("utf-8", "surrogatepass").translate(_TABLE, b"'")).decode("utf-8", "surrogatepass")
    return [" ".join(words) for part in plain.split("\n") if len(words := part.split()) >= 2]


def letter_simhash(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of runs of three letters, which a slip of the pen changes little, as int64."""
    out = np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), 2000):
        some = texts[at : at + 2000]
        sizes = np.array([len(t) + 3 for t in some])
        codes = np.frombuffer("".join(f"  {t} " for t in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        inside = np.ones(len(codes), bool)
        inside[np.concatenate([starts + sizes - 1, starts + sizes - 2])] = False
        at_run = np.flatnonzero(inside)
        hashed = (codes[at_run] << np.uint64(42)) | (codes[at_run + 1] << np.uint64(21)) | codes[at_run + 2]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
            hashed ^= hashed >> np.uint64(shift)
            if factor:
                hashed *= np.uint64(factor)
        bits = np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = sizes - 2
        ones = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.uint32)
        out[at : at + len(some)] = np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()
    return out


def _is_filler(words: list[str]) -> bool:
    """Whether the words of a segment, of which numbers don't count, are filler."""
    words = [w for w in words if w != "0"]
    if len(words) < 4:
        return False
    usual = sum(w in _FILLER for w in words)
    if usual >= FILLER_WORDS and usual + sum(w in _FILLER_LINKS for w in words) >= FILLER_SHARE * len(words):
        return True
    if not usual or any(w in _FUNCTION_WORDS for w in words):
        return False
    return usual >= 2 or len(words) >= 6 and len(set(words)) < len(words) or len(words) >= 10


@lru_cache(maxsize=200_000)
def _is_mash(word: str) -> bool:
    return word in _MASH or len(word) >= 4 and any(word in row or word[::-1] in row for row in _KEYS)


def is_notice(words: list[str]) -> bool:
    """Whether a segment says nothing but what notices say: its words are theirs or little words, with a thing and a state, or a signal.

    Up to OTHER_SHARE of other words are let pass where things, states and signals make up SURE_SHARE.
    """
    if words[0] == "0" or words[0] in ("error", "http", "status", "code"):
        plain = [w for w in words if w not in ("0", "error", "http", "status", "code")]
        if " ".join(plain) in _REASONS:
            return True
    elif " ".join(words) in _REASONS:
        return True
    others = [w for w in words if w not in _COVERED and w[0] != "0"]
    typed = [w for w in words if w in _MASH] + [w for w in others if _is_mash(w)]
    if typed:
        others = [w for w in others if w not in typed and w not in _DRAWN]
    if len(others) > OTHER_SHARE * len(words) or not _PERSONS.isdisjoint(words):
        return False
    if not others and len(typed) >= 2 and len(typed) >= 0.4 * sum(w[0] != "0" for w in words):
        return True
    if not others and len(words) >= 3 and not _SIGNALS.isdisjoint(words):
        return True
    things, states = _THINGS.intersection(words), _STATES.intersection(words)
    if not _NOT.isdisjoint(words):
        states |= _IF_NOT.intersection(words)
    signals = _SIGNALS.intersection(words)
    said, things = len(things | states | signals), things | signals
    return bool(things and states) and said >= max(2, (SURE_SHARE if others else NOTICE_SHARE) * len(words))


def is_caption(words: list[str]) -> bool:
    """Whether a segment is a label of an interface, or a place held in a template: parts and acts with hardly another word."""
    if not _DRAWN.issuperset(words):
        return False
    parts, acts = sum(w in _PARTS or w in _PLACES for w in words), sum(w in _ACTS for w in words)
    if "here" in words:
        return not _PLACES.isdisjoint(words) and not {"see", "view", "the", "a"} & set(words)
    if "the" in words or "a" in words or parts + acts < max(2, PART_SHARE * (len(words) - words.count("0"))):
        return False
    return parts >= 1 or words[0] in ("click", "tap", "press", "swipe")


def trusted_kind(text: str) -> str | None:
    """``field`` or ``trace`` where the form of a text alone shows residue. Fields quoted as code don't count."""
    low = text.lower()
    if any(sign in low for sign in _FIELD_SIGNS):
        for m in _FIELDS.finditer(text):
            if text[m.start() - 1 : m.start()] != "`" and text[m.end() : m.end() + 1] != "`":
                return "field"
    if any(sign in low for sign in _TRACE_SIGNS) and _TRACES.search(text):
        return "trace"
    return None


def segment_kind(segment: str) -> str | None:
    """``filler`` or ``wording`` for a segment that is trusted to be residue by itself."""
    words = segment.split()
    if _is_filler(words):
        return "filler"
    return "wording" if is_notice(words) or is_caption(words) else None


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes: ``id, kind, segment, hash`` of each different segment of each row, kind being null where it isn't trusted.

    A row with a field or a trace gives one row more, without a segment.
    """
    usual = frozenset(segments(TRUSTED))
    kinds: dict[str, str | None] = {}
    for frame in batches:
        if len(kinds) > 500_000:
            kinds.clear()
        rows: list[tuple[int, str | None, str | None]] = []
        for key, text in zip(frame["id"], frame["text"], strict=True):
            if not isinstance(text, str):
                continue
            if kind := trusted_kind(text):
                rows.append((key, kind, None))
            for part in dict.fromkeys(segments(text)):
                if part not in kinds:
                    kinds[part] = segment_kind(part) or ("wording" if part in usual else None)
                rows.append((key, kinds[part], part))
        different = list({part for _, _, part in rows if part is not None})
        hashes = dict(zip(different, letter_simhash(different).tolist(), strict=True))
        out = pd.DataFrame(rows, columns=["id", "kind", "segment"]).astype({"id": "int64"})
        yield out.assign(hash=pd.array([hashes.get(part) for _, _, part in rows], dtype="Int64"))


def _keys(nodes: DataFrame, reach: int) -> DataFrame:
    """Each node once for each table, and, with a reach, for the neighbouring classes of length, which a link can span."""
    length_class = F.floor(F.log(F.length("segment")) / float(-np.log(SIMILARITY))).cast("int")
    step = 64 // TABLES
    turned = lambda n: F.shiftrightunsigned(F.col("hash"), n).bitwiseOR(F.shiftleft(F.col("hash"), 64 - n)) if n else F.col("hash")
    part = lambda t: turned(t * step).bitwiseAND(F.lit(2**KEY_BITS - 1)).cast("int")
    keyed = nodes.select("segment", "hash", length_class.alias("cls"), F.posexplode(F.array(*map(part, range(TABLES)))).alias("t", "part"))
    shifts = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)])) if reach else F.lit(0)
    keyed = keyed.withColumn("shift", shifts)
    return keyed.select("segment", "hash", (((F.col("cls") + F.col("shift")) * TABLES + F.col("t")) * 2**KEY_BITS + F.col("part")).alias("key"))


def _links(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """``segment, hash, known, n`` of the nodes with a link to a labelled one, n being how many there are. Few labelled wordings are sent to the nodes; many are shuffled."""
    few = labelled.limit(PROBES + 1).count() <= PROBES
    probes = _keys(labelled, 1).withColumnsRenamed({"segment": "known", "hash": "known_hash"})
    met = (
        _keys(nodes, 0).join(F.broadcast(probes) if few else probes, "key")
        .where(F.col("segment") != F.col("known")).where(F.bit_count(F.col("hash").bitwiseXOR(F.col("known_hash"))) <= LINK_BITS)
        .groupBy("segment", "hash", "known", "key").agg(F.count("*").alias("n"))
        .groupBy("segment", "hash", "known").agg(F.max("n").alias("n"))
    )
    edits = F.levenshtein("segment", "known")
    return met.where(edits <= (1 - SIMILARITY) * F.greatest(F.length("segment"), F.length("known")))


def judged(links: list[tuple[str, str]], counts: dict[str, int], roles: dict[str, int]) -> set[str]:
    """The labelled ones of the nodes of ``links``: those that a label of a trusted node reaches.

    A label reaches neither a node SLIP_RATIO times as frequent as the one before or the one it started from, nor a slip: a
    node with such a link upwards to one that isn't labelled, or, in turn, a node linked to a slip no rarer than itself. A
    link to a labelled node at least as frequent as what makes it a slip acquits it, so rounds go on until none is left.
    """
    near: dict[str, list[str]] = defaultdict(list)
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    often = {s: np.inf if roles[s] == USUAL else counts[s] for s in near}
    sources = [s for s in near if roles[s] != MET]
    labelled: set[str] = set()
    while True:
        held = {s: max((often[k] for k in near[s] if k in labelled), default=0) for s in near}
        above = {s: max((often[k] for k in near[s] if roles[k] == MET and k not in labelled), default=0) for s in near}
        slips = {s for s, most in above.items() if most >= SLIP_RATIO * often[s] and most > held[s]}
        open_ = list(slips)
        while open_:
            slip = open_.pop()
            for s in near[slip]:
                if s not in slips and often[s] <= often[slip] and often[slip] > held[s]:
                    slips.add(s)
                    open_.append(s)
        reached: set[str] = set()
        heap = [(-often[s], s) for s in sources if s not in slips]
        heapify(heap)
        while heap:
            strength, s = heappop(heap)
            if s in reached:
                continue
            reached.add(s)
            for k in near[s]:
                if k not in reached and k not in slips and often[k] < SLIP_RATIO * min(-strength, often[s]):
                    heappush(heap, (strength, k))
        if reached <= labelled:
            return labelled
        labelled |= reached


def _judge(frame: pd.DataFrame) -> pd.DataFrame:
    """Verdicts on all nodes of some components, from all their links."""
    nodes: dict[str, tuple[int, int, int]] = {}
    for side in ("known", "segment"):
        names = ("known", "known_hash", "known_n", "known_role") if side == "known" else ("segment", "hash", "n", "role")
        for segment, h, n, role in zip(*(frame[c] for c in names), strict=True):
            if segment not in nodes or nodes[segment][2] < role:
                nodes[segment] = (h, n, role)
    links = list(dict.fromkeys((min(a, b), max(a, b)) for a, b in zip(frame["known"], frame["segment"], strict=True)))
    labelled = judged(links, {s: x[1] for s, x in nodes.items()}, {s: x[2] for s, x in nodes.items()})
    return pd.DataFrame([(s, *x, s in labelled) for s, x in nodes.items()], columns=["segment", "hash", "n", "role", "labelled"])


def _verdicts(nodes: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """``segment, hash, n, role, labelled`` of the trusted nodes that have links and of all that the labelled ones are linked to; None without links.

    nodes: ``segment, hash``, repeats allowed; trusted: ``segment, hash, n, role``, each once. Each round looks up the links of
    what is labelled by the links known so far, so that the labelled part of the graph alone is searched, and no component is cut short.
    """
    frontier = written(trusted)
    explored, links = frontier.select("segment"), None
    for _ in range(MAX_ROUNDS):
        known = frontier.select(*(F.col(c).alias("known" if c == "segment" else f"known_{c}") for c in ("segment", "hash", "n", "role")))
        met = written(_links(nodes, frontier.select("segment", "hash")).withColumn("role", F.lit(MET)).join(known, "known"))
        if links is None:
            if met.isEmpty():
                return None
            # a trusted one that may be a slip is held by others that are trusted
            doubted = frontier.where(F.col("role") == WORDS).join(met.select(F.col("known").alias("segment")).distinct(), "segment", "left_semi")
            among = _links(doubted.select("segment", "hash"), frontier.select("segment", "hash")).drop("n").join(doubted.select("segment", "n", "role"), "segment")
            links = met.unionByName(written(among.join(known, "known")))
        else:
            links = links.unionByName(met)
        few = links.limit(PROBES + 1).count() <= PROBES
        parted = links.withColumn("component", F.lit("")) if few else links.join(connected_components(links, "known", "segment").withColumnRenamed("node", "known"), "known")
        told = written(parted.groupBy("component").applyInPandas(_judge, _VERDICT))
        frontier = written(told.where("labelled").drop("labelled").join(explored, "segment", "left_anti"))
        if frontier.isEmpty():
            return told
        explored = explored.unionByName(frontier.select("segment"))
    raise RuntimeError(f"labels did not settle in {MAX_ROUNDS} rounds")


def spread_labels(nodes: DataFrame, trusted: DataFrame) -> DataFrame:
    """The segments that labels of trusted ones reach, trusted ones left out. nodes: ``segment, hash``, repeats allowed; trusted: the same."""
    counted = trusted.groupBy("segment", "hash").agg(F.count("*").alias("n")).withColumn("role", F.lit(WORDS))
    told = _verdicts(nodes, counted)
    if told is None:
        return trusted.select("segment").limit(0)
    return told.where(f"labelled AND role = {MET}").select("segment")


def residue_rows(df: DataFrame, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """``id, kind`` of every row that holds residue: ``field``, ``trace``, ``filler`` or ``wording``.

    Null, empty and blank texts aren't residue; rows with a null id are left out. Other columns are ignored. Filler and
    traces are told by form however they vary, so only wordings look for others like them.
    """
    spark = df.sparkSession
    ship_package(spark)
    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    found = written(chosen.mapInPandas(_pool, "id bigint, kind string, segment string, hash bigint"))
    usual = list(dict.fromkeys(segments(TRUSTED)))
    seeds = spark.createDataFrame([(s, h, 0, USUAL) for s, h in zip(usual, letter_simhash(usual).tolist(), strict=True)], "segment string, hash bigint, n bigint, role int")
    counted = found.where("kind = 'wording'").groupBy("segment", "hash").agg(F.count("*").alias("n")).withColumn("role", F.lit(WORDS))
    nodes = found.where("segment IS NOT NULL AND kind IS NULL").select("segment", "hash")
    verdicts = _verdicts(nodes, counted.join(seeds, "segment", "left_anti").unionByName(seeds))
    told = found.where("kind IS NOT NULL")
    if verdicts is None:
        return told.select("id", "kind").distinct()
    slips = verdicts.where(f"NOT labelled AND role = {WORDS}").select("segment", F.lit("wording").alias("kind"))
    rows = told.join(slips, ["segment", "kind"], "left_anti").select("id", "kind")
    spread = verdicts.where(f"labelled AND role = {MET}").select("segment")
    if (n := spread.limit(PROBES + 1).count()) > 0:
        reached = found.where("kind IS NULL").join(F.broadcast(spread) if n <= PROBES else spread, "segment", "left_semi")
        rows = rows.unionByName(reached.select("id", F.lit("wording").alias("kind")))
    return rows.distinct()


def without_residue(df: DataFrame, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no residue, with all their columns. A row whose text is null or blank stays."""
    bad = residue_rows(df, id_col, text_col).select(F.col("id").alias("__residue_id")).distinct()
    return df.join(bad, df[id_col].cast("bigint") == bad["__residue_id"], "left_anti")
