"""Problem 1: the language of each text and of each stretch of a mixed one.

Every language has unigram probabilities of pieces over a fixed public vocabulary. A word's probability in a
language sums over all its segmentations into pieces by a forward algorithm; words of a sentence add up, their
evidence being bounded. Piece probabilities are fitted by expectation maximisation on a bounded sample.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.bpe import read_vocabulary
from postmill.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LANGUAGES = ("English", "Hinglish", "German", "Spanish", "French", "Portuguese", "Hindi")
#: Usual names and codes of the languages, and what says that one isn't known (fixed values).
LABELS = {
    "english": "English", "en": "English", "eng": "English", "hinglish": "Hinglish", "hi-latn": "Hinglish", "hing": "Hinglish",
    "german": "German", "de": "German", "deu": "German", "ger": "German", "deutsch": "German",
    "spanish": "Spanish", "es": "Spanish", "spa": "Spanish", "español": "Spanish", "espanol": "Spanish",
    "french": "French", "fr": "French", "fra": "French", "fre": "French", "français": "French",
    "portuguese": "Portuguese", "pt": "Portuguese", "por": "Portuguese", "português": "Portuguese",
    "hindi": "Hindi", "hi": "Hindi", "hin": "Hindi",
}
UNKNOWN = ("", "-", "--", "?", "und", "unknown", "n/a", "na", "none", "null", "nil", "undefined", "undetermined", "zxx", "mul", "mis", "other", "xx")

#: Rows with a usable label that the fit takes, of each language, chosen by a hash of the id.
SAMPLE_ROWS = 250
#: The most evidence, in nats, that one word gives for one language over another.
WORD_BOUND = 4.0
#: The most that a word gives which the fit never met; names written small are such.
UNMET_BOUND = 1.0
#: Weight of the pooled piece probabilities in those of a language, in pieces.
POOLED = 60.0
#: A sentence speaks for the main language of its text from this many words and this margin in nats over the next one.
LEAST_WORDS, LEAST_MARGIN = 3, 3.0
#: Log odds for a sentence to be in the language that most of the text is in. For another one the margin alone decides; it is
#: SHOUT_MARGIN in a text without small letters, where names can't be told from words.
HOME, SHOUT_MARGIN = 2.0, 6.0

#: Sentences and words of each language to begin the fit with.
SEEDS = {
    "English": """the of and to a in is that it was for on are as with they at be this have from or had by but not what all were we when
        your can said there use an each which she do how their if will up other about out many then them these so some her would make like him
        into time has look two more write go see no way could people my than first been who its now find long down did get come made may over
        new take only little work know place year back give most very after our just think also around another came three word must because
        does part even well why asked went men read need different home us move try kind again off play always those both once
        We used to think this was easy until it was not. Nobody told me what the team had already done before the meeting.""",
    "Hinglish": """hai hain tha thi the ka ki ke ko se mein par pe aur ya nahi na bhi to toh ho hota hoti hote hoon hun kya kyun kaise kab kahan
        kaun jo jab tab agar lekin magar kyunki isliye yeh ye woh wo main hum aap tum mera meri mere hamara hamari aapka aapke unka unke uska
        iska apna apni apne ek do sab kuch bahut thoda zyada kam accha achha sahi galat karna karke karte karta kar raha rahi rahe gaya gayi gaye
        hua hui hue liya diya kiya bola bataya batao dekho dekhiye suno chahiye wala wale wali log logon ne saath bina baad pehle abhi aaj kal roz
        din saal mahine hafte baat kaam yaar bhai dosto shukriya tak itna jitna sirf mat rakho phir se
        Aaj main aapko batata hoon ki humne yeh kaam kaise kiya. Mujhe lagta tha ki yeh sirf ek baar hoga, lekin ab samajh aaya.""",
    "German": """der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird
        bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wir ich uns mir
        mich ihr euch wenn was kann schon hier alle gegen doch weil keine immer hätte würde unser unsere inzwischen wirklich jeder ohne sehr ganz
        Wir haben lange gebraucht, um das zu verstehen. Niemand sagt dir vorher, wie viel Geduld es verlangt. Vielen Dank an alle, die geholfen haben.""",
    "Spanish": """de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy
        sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos
        qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros es son era ser
        hemos han había hoy ayer gracias después años
        No se trata de ir rápido. Nadie te dice cuánta paciencia hace falta. Gracias a todos los que nos ayudaron desde el principio.""",
    "French": """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son s'il vous nous on mais comme
        ou si leur y dont tout aux cette ses été être fait sans cela très même aussi lui je c'est n'est d'une l'on ont ces elle bien où encore deux
        après avant moi nos notre votre quand chez depuis entre toutes tous ceux faut peut avait était aurait aujourd'hui merci
        Il ne s'agit pas d'aller vite. Personne ne vous dit combien de patience cela demande. Merci à toutes celles et ceux qui nous ont aidés.""",
    "Portuguese": """de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há
        nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa
        num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles nosso nossa hoje obrigado vocês todos
        Não se trata de velocidade. Ninguém avisa quanta paciência é preciso ter. Obrigado a todos que nos ajudaram desde o começo.""",
    "Hindi": """है हैं था थी थे का की के को से में पर और या नहीं न भी तो हो होता होती होते क्या क्यों कैसे कब कहाँ कौन जो जब तब अगर लेकिन क्योंकि इसलिए यह ये वह वे
        मैं हम आप तुम मेरा मेरी मेरे हमारा हमारी एक दो सब कुछ बहुत थोड़ा कम अच्छा करना करके करते कर रहा रही रहे गया गई गए हुआ हुई हुए लिया दिया किया ने साथ बिना बाद
        पहले अभी आज कल दिन साल महीने बात काम धन्यवाद तक लोग लोगों वाले चाहिए
        हमें यह समझने में बहुत समय लगा। कोई नहीं बताता कि इसमें कितना धैर्य चाहिए। शुरू से साथ देने वाले सभी लोगों को धन्यवाद।""",
}

_SENTENCES = re.compile(r"(?<=[.!?…।])\s+|[\n\r  ]+")
_WORDS = re.compile(
    r"(?:[#@]|https?:|www\.)\S*|\S+\s?@\s?\S+|[\w.+-]+\s?[\[(]\s?at\s?[\])]\s?[\w.-]+(?:\s+dot\s+[\w-]+)*|[\w.+-]+\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+|"
    r"[ऀ-ॿ]+|[^\W\d_]+",
    re.I,
)
_ADDRESS = re.compile(r"[@#\d_.+\[( ]")
#: Sums of probabilities under this are worked out again as logarithms, which don't run out of range.
_TINY = 1e-280
#: Words whose evidence a model keeps from one batch to the next.
_KEPT_WORDS = 150_000


def normal_label(label) -> F.Column:
    """The language a label names; the label itself, in small letters, if it names none of them; null if it says unknown."""
    plain = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    base = F.regexp_replace(plain, r"[-_](?!latn)[a-z]{2,4}$", "")
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    known = F.coalesce(F.try_element_at(named, plain), F.try_element_at(named, base), plain)
    return F.when(~plain.isin(*UNKNOWN), known)


_PLAIN_WORDS = re.compile(r"(?:#|https?:|www\.)\S*|[ऀ-ॿ]+|[^\W\d_]+")
_ADDRESS_SIGNS = re.compile(r"@|\bdot\b|[\[(]\s?at\s?[\])]", re.I)


def sentence_words(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of each sentence or line; words in small letters, without names, hashtags and addresses.

    A word with a capital that doesn't begin its sentence passes for a name, unless the whole text is in capitals.
    """
    shout = text == text.upper()
    found = _WORDS.findall if _ADDRESS_SIGNS.search(text) else _PLAIN_WORDS.findall
    linked = "www." in text or "http" in text or found == _WORDS.findall
    out = []
    at = 0
    for part in [*_SENTENCES.finditer(text), None]:
        end = part.start() if part else len(text)
        words: list[str] = []
        for w in found(text, at, end):
            if w[0] == "#" or linked and not w.isalpha() and (_ADDRESS.search(w) or w.startswith(("http", "www."))):
                continue
            if shout or not words or not w[0].isupper() or w == "I":
                words.append(w.lower())
        out.append((at, end, words))
        at = part.end() if part else end
    return out


@dataclass
class LanguageModel:
    """Pieces, their probabilities, one column for each language, and the words that the fit met."""

    pieces: dict[str, int]
    probabilities: np.ndarray
    met: frozenset[str] = frozenset()

    def __post_init__(self):
        self._longest = max(map(len, self.pieces), default=1)
        self._scores: dict[str, int] = {}
        self._rows: list[np.ndarray] = []
        self._floor = self.probabilities.min(axis=0)

    def log_probability(self, word: str) -> np.ndarray:
        """Logarithm of a word's probability in each language, over all its segmentations."""
        part = "▁" + word
        total = self._forward(part)[-1]
        return np.log(total) if total.min() > _TINY else self._log_forward(part)

    def _forward(self, part: str) -> np.ndarray:
        n, p, get = len(part), self.probabilities, self.pieces.get
        alpha = np.zeros((n + 1, len(LANGUAGES)))
        alpha[0] = 1.0
        for j in range(1, n + 1):
            for i in range(max(0, j - self._longest), j):
                k = get(part[i:j])
                if k is not None:
                    alpha[j] += alpha[i] * p[k]
                elif i == j - 1:
                    alpha[j] += alpha[i] * self._floor
        return alpha

    def _log_forward(self, part: str) -> np.ndarray:
        """The last row of ``_forward`` as logarithms, for long words; only as many rows are kept as a piece is long."""
        log, floor = np.log(self.probabilities), np.log(self._floor)
        rows = {0: np.zeros(len(LANGUAGES))}
        for j in range(1, len(part) + 1):
            terms = []
            for i in range(max(0, j - self._longest), j):
                k = self.pieces.get(part[i:j])
                if k is not None:
                    terms.append(rows[i] + log[k])
                elif i == j - 1:
                    terms.append(rows[i] + floor)
            rows[j] = np.logaddexp.reduce(terms, axis=0)
            rows.pop(j - self._longest, None)
        return rows[len(part)]

    def evidence(self, word: str) -> int:
        """Row number of a word's bounded evidence: log odds against its best language, no lower than the bound."""
        known = self._scores.get(word)
        if known is None:
            log = self.log_probability(word)
            known = self._scores[word] = len(self._rows)
            self._rows.append(np.maximum(log - log.max(), -(WORD_BOUND if word in self.met else UNMET_BOUND)))
        return known

    def sentence_scores(self, sentences: list[list[str]]) -> np.ndarray:
        """Summed evidence of each sentence, one column for each language. What is kept of earlier calls goes before row numbers are taken."""
        if len(self._rows) > _KEPT_WORDS:
            self._scores.clear()
            self._rows.clear()
        index = [self.evidence(w) for words in sentences for w in words]
        out = np.zeros((len(sentences), len(LANGUAGES)))
        if index:
            table = np.array(self._rows)[index]
            sizes = np.array([len(w) for w in sentences])
            filled = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)])[filled]
            out[filled] = np.add.reduceat(table, starts, axis=0)
        return out


def _expected(model: LanguageModel, words: Counter, language: int) -> np.ndarray:
    """Expected piece counts of a language's words, by forward and backward sums."""
    counts = np.zeros(len(model.pieces))
    p = model.probabilities[:, language]
    for word, n in words.items():
        part = "▁" + word
        size = len(part)
        edges = [(i, j, k) for j in range(1, size + 1) for i in range(max(0, j - model._longest), j) if (k := model.pieces.get(part[i:j])) is not None]
        alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
        alpha[0] = beta[size] = 1.0
        for i, j, k in edges:
            alpha[j] += alpha[i] * p[k]
        for i, j, k in reversed(edges):
            beta[i] += beta[j] * p[k]
        if min(alpha[size], beta[0]) > _TINY:
            for i, j, k in edges:
                counts[k] += n * alpha[i] * p[k] * beta[j] / alpha[size]
        else:
            _expected_of_long(edges, p, size, n, counts)
    return counts


def _expected_of_long(edges: list[tuple[int, int, int]], p: np.ndarray, size: int, n: int, counts: np.ndarray) -> None:
    """Adds the expected counts of a word whose sums are out of the range of numbers, by logarithms."""
    log = np.log(np.maximum(p, 1e-300))
    alpha, beta = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    alpha[0] = beta[size] = 0.0
    for i, j, k in edges:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + log[k])
    for i, j, k in reversed(edges):
        beta[i] = np.logaddexp(beta[i], beta[j] + log[k])
    if np.isfinite(alpha[size]):
        for i, j, k in edges:
            counts[k] += n * np.exp(alpha[i] + log[k] + beta[j] - alpha[size])


def _pieces_of(lines: bytes, corpus: set[str]) -> dict[str, int]:
    """The vocabulary's pieces that occur in the words of the corpus, a leading space being the start of a word; and all single characters."""
    fixed = set()
    for line in lines.splitlines():
        try:
            fixed.add(base64.b64decode(line.split()[0]).decode().replace(" ", "▁").lower())
        except (UnicodeDecodeError, IndexError):
            continue
    sizes = sorted({len(piece) for piece in fixed if piece[1:].isalpha()} | {1})
    kept = {c for word in corpus for c in "▁" + word}
    for word in corpus:
        part = "▁" + word
        kept |= {piece for size in sizes for i in range(len(part) - size + 1) if (piece := part[i : i + size]) in fixed}
    return {piece: k for k, piece in enumerate(sorted(kept))}


def _fit(pieces: dict[str, int], words: list[Counter], rounds: int = 2) -> LanguageModel:
    flat = np.full((len(pieces), len(LANGUAGES)), 1.0 / len(pieces))
    model = LanguageModel(pieces, flat)
    for _ in range(rounds):
        counts = np.stack([_expected(model, words[k], k) for k in range(len(LANGUAGES))], axis=1)
        pooled = (counts / np.maximum(counts.sum(axis=0), 1)).mean(axis=1) + 1e-7
        mixed = counts + POOLED * (pooled / pooled.sum())[:, None]
        model = LanguageModel(pieces, mixed / mixed.sum(axis=0), frozenset(w for c in words for w in c))
    return model


def fit_model(labelled: list[tuple[str, str | None]], vocabulary: str = VOCABULARY, rounds: int = 2) -> LanguageModel:
    """A model from ``(text, label)`` rows, which may be wrongly labelled, and the seeds.

    It begins with the seeds alone; each round then takes the sentences of the rows that it can tell apart, a
    sentence's label counting as one bounded word, and fits anew.
    """
    seeds = [Counter(w for _, _, words in sentence_words(SEEDS[k].lower()) for w in words) for k in LANGUAGES]
    sentences = [(words, label) for text, label in labelled if text for _, _, words in sentence_words(text) if len(words) >= LEAST_WORDS]
    pieces = _pieces_of(read_vocabulary(vocabulary), {w for c in seeds for w in c} | {w for words, _ in sentences for w in words})
    model = _fit(pieces, seeds)
    for _ in range(rounds):
        scores = model.sentence_scores([words for words, _ in sentences])
        words = [Counter({w: 3 * n for w, n in c.items()}) for c in seeds]
        for row, (these, label) in zip(scores, sentences, strict=True):
            if label in LANGUAGES:
                row[LANGUAGES.index(label)] += WORD_BOUND / 2
            best = np.sort(row)
            if best[-1] - best[-2] >= LEAST_MARGIN:
                words[int(row.argmax())].update(these)
        model = _fit(pieces, words)
    return model


def fit_on(df: DataFrame, id_col: str = "idx", text_col: str = "text", label_col: str = "language", vocabulary: str = VOCABULARY) -> LanguageModel:
    """``fit_model`` on at most SAMPLE_ROWS rows of each language, chosen by a hash of the id; the rows kept are cut before the shuffle."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    rows = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), normal_label(F.col(label_col)).alias("label"))
        .where(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(f"rank <= {SAMPLE_ROWS}")
        .orderBy("id")
        .select("text", "label")
        .collect()
    )
    return fit_model([(r.text, r.label) for r in rows], vocabulary)


def analyse(model: LanguageModel, texts: list[str | None]) -> list[list[tuple[int, int, str, float, bool]]]:
    """Of each text its segments ``(start, end, language, confidence, whole)``.

    Neighbouring sentences of one language are one segment; a sentence that tells too little joins the one before
    it, or the first that tells enough. whole says that at least one whole sentence of it speaks for the language.
    A text whose sentences all tell too little is judged as one sentence. No words give no segments.
    """
    parts = [sentence_words(t) if t else [] for t in texts]
    scores = model.sentence_scores([words for p in parts for _, _, words in p])
    counts = np.array([len(p) for p in parts])
    sizes = np.array([len(words) for p in parts for _, _, words in p])
    held = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    home = np.zeros(len(parts), int)
    if len(held):
        home[held] = np.add.reduceat(scores, starts[held], axis=0).argmax(axis=1)
    own = np.repeat(home, counts)
    scores[np.arange(len(scores)), own] += HOME * (sizes > 0)
    best = scores.argmax(axis=1)
    ranked = np.sort(scores, axis=1)
    margin = ranked[:, -1] - ranked[:, -2]
    sure = (1.0 / np.exp(scores - ranked[:, -1:]).sum(axis=1)).tolist()
    foreign = best != own
    shouted = np.repeat([bool(t) and t == t.upper() for t in texts], counts)
    speaks = (foreign | (sizes >= LEAST_WORDS)) & (margin >= np.where(foreign & shouted, SHOUT_MARGIN, LEAST_MARGIN))
    best, speaks, sizes = best.tolist(), speaks.tolist(), sizes.tolist()
    out: list[list[tuple[int, int, str, float, bool]]] = []
    for p, at, main in zip(parts, starts.tolist(), home.tolist(), strict=True):
        until = at + len(p)
        if not any(sizes[at:until]):
            out.append([])
            continue
        if not any(speaks[at:until]):
            total = scores[at:until].sum(axis=0)
            out.append([(p[0][0], p[-1][1], LANGUAGES[main], float(1 / np.exp(total - total.max()).sum()), True)])
            continue
        language = next(best[k] for k in range(at, until) if speaks[k])
        segments: list[list] = []
        for k, (start, end, _) in enumerate(p, at):
            if speaks[k]:
                language = best[k]
            if segments and segments[-1][2] == language:
                segments[-1][1] = end
            else:
                segments.append([start, end, language, 0.0, 0, False])
            last, n = segments[-1], max(sizes[k], 1)
            last[3] += (sure[k] if speaks[k] else 0.5) * n
            last[4] += n
            last[5] |= speaks[k]
        out.append([(a, z, LANGUAGES[k], w / n, whole) for a, z, k, w, n, whole in segments])
    return out


_SEGMENTS = "array<struct<start:int,stop:int,language:string,confidence:double,whole:boolean>>"


def segment_table(df: DataFrame, model: LanguageModel, id_col: str = "idx", text_col: str = "text") -> DataFrame:
    """``id, language, confidence, segments`` of every row; no language for null, empty and wordless texts.

    language is the one of most letters, confidence its segments' mean weighted by length. Positions count code
    points. Other columns of ``df`` are ignored.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.pieces, model.probabilities, model.met))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(*shared.value)
        for frame in frames:
            rows = []
            found = analyse(own, [t if isinstance(t, str) else None for t in frame["text"]])
            for key, segments in zip(frame["id"], found, strict=True):
                size: Counter = Counter()
                for a, z, name, _, _ in segments:
                    size[name] += z - a
                language = size.most_common(1)[0][0] if size else None
                sure = sum(c * (z - a) for a, z, name, c, _ in segments if name == language) / max(1, size[language]) if size else None
                rows.append((key, language, sure, [{"start": a, "stop": z, "language": k, "confidence": c, "whole": w} for a, z, k, c, w in segments]))
            yield pd.DataFrame(rows, columns=["id", "language", "confidence", "segments"])

    chosen = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInPandas(run, f"id bigint, language string, confidence double, segments {_SEGMENTS}")


def label_errors(df: DataFrame, model: LanguageModel, id_col: str = "idx", text_col: str = "text", label_col: str = "language") -> DataFrame:
    """``id, lang_name``: the languages of each text whose label is missing or wrong, or that is in several languages."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.pieces, model.probabilities, model.met))

    @F.pandas_udf("array<string>")
    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = LanguageModel(*shared.value)
        for texts in batches:
            found = analyse(own, [t if isinstance(t, str) else None for t in texts])
            yield pd.Series([sorted({s[2] for s in segments if s[4]}) for segments in found])

    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"), normal_label(F.col(label_col)).alias("label"), languages(F.col(text_col)).alias("spoken")
    )
    wrong = F.col("label").isNull() | ~F.array_contains("spoken", F.col("label")) | (F.size("spoken") > 1)
    return rows.where(wrong).select("id", F.explode("spoken").alias("lang_name"))
