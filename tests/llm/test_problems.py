"""Each problem's operator against brute force, round trips or planted cases, and on awkward rows."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.llm import bpe, canonical, language, mixing, mojibake, neardup, pii, queries, representative, residue, subjects, superminhash

POSTS = "idx bigint, text string, links string, id string"


def table(spark, texts):
    """Texts with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], POSTS)


# 1 language


@pytest.fixture(scope="module")
def model():
    return language.fit_model([])


CLEAR = {
    "English": "We used to think that this would be easy, but it took the whole team a long time to get there.",
    "Hinglish": "Mujhe lagta tha ki yeh kaam aasan hoga, lekin ab samajh aaya ki isme bahut mehnat hai.",
    "German": "Wir haben sehr lange gebraucht, um das wirklich zu verstehen, und es hat sich gelohnt.",
    "Spanish": "Nadie nos dijo cuánto tiempo hace falta para entender lo que de verdad es importante.",
    "French": "Il nous a fallu beaucoup de temps pour comprendre ce que cela voulait dire pour nous.",
    "Portuguese": "Ninguém nos disse quanto tempo é preciso para entender o que é mesmo importante para nós.",
    "Hindi": "हमें यह समझने में बहुत समय लगा कि सच में क्या ज़रूरी है और क्या नहीं है।",
}


def test_languages_and_segments(model):
    for name, text in CLEAR.items():
        assert {s[2] for s in language.analyse(model, [text])[0]} == {name}, name
    mixed = "\n".join([CLEAR["English"], CLEAR["German"], CLEAR["German"], CLEAR["Spanish"]])
    found = language.analyse(model, [mixed])[0]
    assert [s[2] for s in found] == ["English", "German", "Spanish"]
    assert all(0.5 < s[3] <= 1 for s in found) and mixed[found[1][0] :].startswith("Wir haben")
    assert language.analyse(model, ["", None, "🔥 #AI", "12 34"]) == [[], [], [], []]


def test_forward_sums_all_segmentations(model):
    def brute(part):
        if not part:
            return np.ones(len(language.LANGUAGES))
        total = np.zeros(len(language.LANGUAGES))
        for k in range(1, len(part) + 1):
            row = model.pieces.get(part[:k])
            p = model.probabilities[row] if row is not None else model._floor if k == 1 else None
            if p is not None:
                total = total + p * brute(part[k:])
        return total

    for word in ("team", "qq", "zeit"):
        assert np.allclose(model.log_probability(word), np.log(brute("▁" + word)))


def test_long_words_are_scored_whole(model):
    whole = "donaudampfschifffahrtsgesellschaft" * 2
    assert np.allclose(model._log_forward("▁" + whole), model.log_probability(whole))
    huge = "qzx" * 700
    assert np.isfinite(model.log_probability(huge)).all() and not np.allclose(model.log_probability(huge), model.log_probability(huge[:30]))
    fitted = language.fit_model([(f"und das ist {whole * 20} gewesen", "German")] * 3)
    assert whole * 20 in fitted.met


def test_a_batch_of_many_new_words(model):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576 % 26] for i in range(200_000)]
    own = language.LanguageModel(model.pieces, model.probabilities, model.met)
    batches = [[words[k : k + 20] for k in range(at, at + 100_000, 20)] for at in (0, 100_000)]
    together = own.sentence_scores(batches[0] + batches[1])
    apart = np.concatenate([language.LanguageModel(model.pieces, model.probabilities, model.met).sentence_scores(b) for b in batches])
    assert np.allclose(together, apart) and np.allclose(own.sentence_scores(batches[0]), apart[:5000])


#: Short sentences whose words are mostly none of the seeds.
SHORT = {
    "Spanish": ["Gracias a todos.", "Mañana será otro día.", "Vale la pena intentarlo.", "Nos vemos pronto, amigos."], "German": ["Danke an mein Team.", "Das hat sich gelohnt.", "Morgen geht es weiter.", "Wir freuen uns auf euch."],
    "French": ["Merci à toute l'équipe.", "On en reparle demain.", "C'était une belle journée.", "Bon courage à vous."], "Portuguese": ["Obrigado a toda a equipe.", "Amanhã tem mais.", "Valeu muito a pena.", "Foi um dia incrível."],
    "Hinglish": ["Kal phir milte hain.", "Bahut maza aaya yaar.", "Sabko dil se shukriya.", "Kaam abhi baaki hai."], "English": ["See you all tomorrow.", "That was worth it.", "Thanks for reading this.", "We will be back soon."],
}


def test_short_foreign_sentences(model):
    asked = [(host, name, s) for host in ("English", "German", "Spanish", "French") for name, some in SHORT.items() if name != host for s in some]
    found = language.analyse(model, [f"{CLEAR[host]} {CLEAR[host]} {s}" for host, _, s in asked])
    spoken = [{x[2] for x in segments if x[4]} for segments in found]
    assert sum(name in got for (_, name, _), got in zip(asked, spoken, strict=True)) >= 0.65 * len(asked)
    assert sum(len(got - {host, name}) for (host, name, _), got in zip(asked, spoken, strict=True)) <= 0.05 * len(asked)


def test_label_errors(spark, model):
    labels = [("English", "en", 0), ("English", " ENGLISH", 0), ("English", None, 1), ("English", "N/A", 1), ("German", "English", 1), ("German", "deu", 0), ("Hindi", "hi", 0)]
    rows = [(i, CLEAR[spoken], label) for i, (spoken, label, _) in enumerate(labels)] + [(50, CLEAR["English"] + "\n" + CLEAR["French"], "English"), (51, None, None), (52, "🔥", "")]
    found = language.label_errors(spark.createDataFrame(rows, "idx bigint, text string, language string"), model).collect()
    expected = {(i, spoken) for i, (spoken, _, wrong) in enumerate(labels) if wrong} | {(50, "English"), (50, "French")}
    assert {(r.id, r.lang_name) for r in found} == expected
    empty = spark.createDataFrame([], "idx bigint, text string, language string")
    assert language.label_errors(empty, language.fit_on(empty)).count() == 0
    long = language.segment_table(table(spark, [CLEAR["German"] * 2000, None]), model).orderBy("id").collect()
    assert [r.language for r in long] == ["German", None]


# 2 wrong encodings

CLEAN = "Être à l’heure, ça coûte – “naïveté” für 5 µm, ¿qué más? São Paulo, ÂGE, Ångström, 36º, 10 €…"


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850"])
def test_round_trip_of_wrong_encodings(codec):
    for text in ("Après le café, nous étions très heureux — merci à tous.", "Für die Prüfung hätte ich früher geübt.", "Niño, mañana será otro día"):
        wrong = "".join(ch if ch < "\x80" else "".join(bytes([b]).decode(codec, "replace") if codec != "cp1252" else mojibake_char(b) for b in ch.encode()) for ch in text)
        assert mojibake.is_damaged(wrong)
        assert mojibake.repair(wrong)[0] == text, (codec, mojibake.repair(wrong))


def mojibake_char(b):
    try:
        return bytes([b]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(b)


def test_clean_text_is_left_alone():
    for text in (CLEAN, CLEAN.upper(), "SÃO STYLE", "नमस्ते दोस्तों 🔥", "R&amp;D", "", "plain"):
        assert not mojibake.is_damaged(text) and mojibake.repair(text) == (text, [])
    assert mojibake.repair(None) == (None, [])
    assert mojibake.repair("caf&Atilde;&copy;")[0] == "café"
    twice = "café".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice)[0] == "café"
    assert mojibake.repair("lost � here")[1] == ["lost"]


def test_damaged_rows(spark):
    texts = ["cafÃ© au lait", None, "", "café", "x" * 100_000 + "Ã©", "cafÃ© au lait"]
    assert sorted(r.id for r in mojibake.damaged_ids(table(spark, texts)).collect()) == [0, 4, 5]
    done = {r.id: r.text for r in mojibake.repaired_table(table(spark, texts)).collect()}
    assert done[0] == "café au lait" and done[1] is None and done[2] == "" and len(done) == 6
    assert mojibake.damaged_ids(table(spark, [])).count() == 0


# 3 and 4 near-duplicates


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(len(words) * share)):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [words[k], "and"]])
    return words


def corpus():
    rng = random.Random(8)
    texts = []
    for g in range(40):
        base = [f"w{rng.randrange(60 if g % 4 == 0 else 900)}" for _ in range(rng.randrange(24, 70))]
        texts += [" ".join(edited(rng, base, rng.choice([0, 0.03, 0.08, 0.12]))) for _ in range(rng.randrange(1, 6))]
    return texts + [texts[0].upper(), None, "", "too short", texts[3], "same " * 40, "same " * 41]


def bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return Counter(zip(words, words[1:], strict=False)) if len(words) >= 25 else None


def test_pairs_against_brute_force(spark):
    texts = corpus()
    grams = {i: g for i, t in enumerate(texts) if t and (g := bigrams(t))}
    expected = {(a, b) for a in grams for b in grams if a < b and 2 * sum((grams[a] & grams[b]).values()) >= 0.75 * (sum(grams[a].values()) + sum(grams[b].values()))}
    members, links = neardup.duplicate_links(table(spark, texts), **queries.POST_COPIES)
    found = {(r.idx_a, r.idx_b) for r in neardup.all_pairs(members, links).collect()}
    assert len(expected) > 60 and found <= expected
    sure = {(a, b) for a, b in expected if 2 * sum((grams[a] & grams[b]).values()) >= 0.8 * (sum(grams[a].values()) + sum(grams[b].values()))}
    assert sure <= found and len(found) >= 0.98 * len(expected)
    groups = {r.id: r for r in neardup.groups_of(members, links).collect()}
    assert set(groups) == set(grams) and all(groups[a].group_id == groups[b].group_id for a, b in found)
    assert groups[1].rep <= 1 and neardup.near_duplicate_groups(table(spark, [])).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    elements = np.concatenate([np.sort(np.concatenate([shared, own[k]])) for k in range(2)])
    signature = superminhash.signatures(elements, np.repeat([0, 1], 400), 2)
    assert abs((signature[0] == signature[1]).mean() - 300 / 500) < 0.1
    alone = superminhash.signatures(elements[:400], np.zeros(400, int), 1)
    assert (alone[0] == signature[0]).all()


def test_bands_miss_few_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    pairs, met = 3000, 0
    for _ in range(3):  # 30 shared elements of 50: Jaccard 0.6, similarity 0.75
        shared, own = rng.integers(0, 2**63, (pairs // 3, 30), dtype=np.uint64), rng.integers(0, 2**63, (2, pairs // 3, 10), dtype=np.uint64)
        texts = [np.hstack([shared, own[k]]) for k in range(2)]
        keys = [superminhash.band_keys(superminhash.signatures(t.ravel(), np.repeat(np.arange(len(t)), 40), len(t))) for t in texts]
        met += int((keys[0] == keys[1]).any(axis=1).sum())
    assert met >= 0.995 * pairs


def test_hot_bands_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    sketches = rng.integers(0, 2**62, 4, dtype=np.int64)
    rows = [(int(key), i, int(sketches[i % 4]), int(sketches[i % 4])) for i in range(300) for key in (7, 1000 + i // 3, 5000 + i)]
    bands = spark.createDataFrame(rows, "key bigint, id bigint, s1 bigint, s2 bigint")
    plain = {(r.a, r.b) for r in neardup._met(bands, 0.75).collect()}
    dealt = neardup._met(bands, 0.75, hot_rows=20, hot_share=1).collect()
    assert len(plain) == len(dealt) > 10_000 and {(r.a, r.b) for r in dealt} == plain


def test_best_fields(spark):
    rows = [(1, "aa", 5, ["x", " ", "y", "x"]), (2, "aaa", None, None), (3, "bbb", 9, ["x", "y"]), (4, None, 9, ["z", None]), (5, "c", None, []), (6, "c", None, [])]
    posts = spark.createDataFrame(rows, "idx bigint, text string, engagement bigint, tags array<string>").withColumn("group_id", F.lit(0)).withColumn("field", F.lit("f"))
    groups = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)] + [(5, 5), (6, 5)], "id bigint, group_id bigint")
    found = {r.group_idx: tuple(r)[1:] for r in representative.best_fields(posts, groups).collect()}
    assert found == {1: (2, 3, 1), 5: (5, None, 5)}
    built = {r.group_idx: (r.text, r.engagement) for r in representative.consolidated(posts, groups).collect()}
    assert built == {1: ("aaa", 9), 5: ("c", None)}
    assert representative.best_fields(posts.where("idx < 0"), groups).count() == 0


def test_best_records_by_completeness_trust_and_recency(spark):
    rows = [
        (1, "aa", 5, ["x"], "English", 2, "import", "2024-01-02 00:00:00"), (2, "bb", 5, ["y"], "English", 2, "voyager", "2024-01-01 00:00:00"),
        (3, "cc", 5, ["z"], "English", 2, "voyager", "2024-01-03 00:00:00"), (4, "dd", None, ["w"], "English", 2, "voyager", "2024-01-09 00:00:00"),
        (5, "cc", 5, ["z"], "English", 2, "voyager", None), (6, "d", 1, [], None, None, None, None), (7, "d", 1, [], None, None, None, None),
    ]
    posts = spark.createDataFrame(rows + [(3, "cc", 5, ["z"], "English", 2, "voyager", "2024-01-03 00:00:00"), (2, None, 4, None, "", 0, "dom", None)],
        "idx bigint, text string, engagement bigint, tags array<string>, language string, line_count bigint, origin string, seen string")
    posts = posts.withColumn("processed_at", F.col("seen").cast("timestamp_ntz"))
    groups = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4, 5)] + [(6, 6), (7, 6)], "id bigint, group_id bigint")
    assert {r.group_idx: r.record_idx for r in representative.best_records(posts, groups).collect()} == {1: 3, 6: 6}
    built = {r.group_idx: (r.record_idx, r.text, r.engagement, r.tags) for r in representative.consolidated(posts, groups).collect()}
    assert built == {1: (3, "aa", 5, ["x"]), 6: (6, "d", 1, [])}
    fixed = {r.group_idx: tuple(r)[1:] for r in representative.best_fields(posts, groups).collect()}
    assert fixed == {1: (1, 1, 1), 6: (6, 6, 6)}
    assert representative.consolidated(posts.where("idx < 0"), groups).count() == 0


# 5 canonical values


def test_mapping(spark):
    refs = spark.createDataFrame([(1, "Software Engineering", ["Coding"]), (2, "Data Privacy", None), (3, "Football", ["Soccer"]), (4, "AI", []), (9, "Bookkeeping", [])], "canon_id bigint, canon_tag string, aliases array<string>")
    cases = {
        "software engineering": 1, "#SoftwareEngineering": 1, " Coding​": 1, "Engineering, Software": 1, "Softwar Enginering": 1, "Sfotware Enigneering": 1,
        "Software Engin…": 1, "Data Privcay 101": 2, "Frotball": 3, "Soccre": 3, "soccer tips": 3, "ai": 4, "Ai!": 4, "a1": 0, "Beekeeping": 0, "Origami": 0, "???": 0, "🔥": 0,
    }
    rows = [(7, list(cases) + ["AI", "", " ", None, "Coding​", "ai"]), (8, None), (9, []), (None, ["ai"])]
    frame = spark.createDataFrame(rows, "idx bigint, tags array<string>").withColumn("value", F.lit(1)).withColumn("canon_id", F.lit(2))
    found = {(r.id, r.value): r.canon_id for r in canonical.map_values(frame, refs).collect()}
    assert {v: found[7, v] for v in cases} == cases
    assert (7, "AI") not in found and found[None, "ai"] == 4
    assert "Origami" in {r.value for r in canonical.unmatched_values(frame, refs).collect()}
    assert canonical.map_values(frame.where("idx < 0"), refs).count() == 0


def test_segments_lose_no_error_within_the_bound(spark):
    rng = random.Random(1)
    names = ["Renewable Energy", "Molecular Biology", "Carbon Accounting", "Football", "Nursing"]
    refs = spark.createDataFrame([(k + 1, n, []) for k, n in enumerate(names)], "canon_id bigint, canon_tag string, aliases array<string>")
    typed = {}
    for k, name in enumerate(names):
        for _ in range(60):
            letters = list(name.replace(" ", "").lower())
            for _ in range(1 if len(letters) < canonical.TWO_ERRORS else 2):
                p = rng.randrange(len(letters) - 1)
                letters[p : p + 2] = rng.choice([[letters[p + 1], letters[p]], [letters[p]], [letters[p], "q", letters[p + 1]], ["q", letters[p + 1]]])
            typed["".join(letters)] = k + 1
    frame = spark.createDataFrame([(1, list(typed))], "idx bigint, tags array<string>")
    found = {r.value: r.canon_id for r in canonical.map_values(frame, refs).collect()}
    assert found == typed


# 6 residue


def test_residue(spark):
    good = [
        "A client still asks visitors to enable JavaScript for a plain price list, and I have opinions.", "We found `{{ user }}` in 12 sent mails once.",
        "Access denied was the title of my talk in Bonn, and yes, the projector failed.", "Our designer banned lorem ipsum two years ago and the mock-ups got better.",
        "[Hiring] We look for two calm people.", None, "", "  ", "The error rate went from 4% to 0.1% after that change.",
    ]
    bad = [
        "Please enable JavaScript to view this page.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE", "A good post.\nInternal Server Error\nRequest id: 9f", "404 - Page not found",
        "Dear {{first_name}}, thank you for the talk.", "Hi %FIRSTNAME%, hello.", "We met [insert link here] again.", "lorem ipsum dolor sit amet lorem ipsum dolor",
        "Please enable Javascrpt to view this page", 'Traceback (most recent call last):\n  File "a.py", line 3\nKeyError: 1', "Video player", "Error 503: bad gateway. The upstream server did not answer.",
    ]
    frame = table(spark, good + bad).withColumn("kind", F.lit("k")).withColumn("segment", F.lit("s"))
    found = {r.id for r in residue.residue_rows(frame).collect()}
    assert found == set(range(len(good), len(good) + len(bad)))
    assert residue.without_residue(frame).count() == len(good)
    assert residue.residue_rows(table(spark, [])).count() == 0


#: Notices and captions as browsers, servers and page builders word them; none stands in residue.TRUSTED.
USUAL = """
    Error establishing a database connection
    This site can't be reached
    Rate limit exceeded
    Accept all cookies
    Kindly switch on scripts in your web browser
    Your connection was interrupted
    The connection has timed out
    This page is under construction
    Web server is down
    Origin is unreachable
    The page you are looking for does not exist
    You must have JavaScript enabled to use this form
    Please allow cookies in your browser settings
    We have updated our cookie policy
    By using this site you accept our cookies
    Please sign in again to view this content
    Your account does not have access to this page
    Sorry, this post is no longer available
    This request has been blocked
    An error occurred while loading the page
    Failed to load resource
    The service is currently unavailable
    Video unavailable
    Image could not be loaded
    Loading video player
    Audio transcript
    Close caption window
    Enter a description here
    Your logo here
    Add your title here
    Ihr Browser unterstützt kein JavaScript
    Die angeforderte Seite konnte nicht geladen werden
    Sitzung abgelaufen
    Dieser Inhalt ist nicht verfügbar
    Zugriff verweigert
    La página que busca no existe
    Su sesión ha caducado
    Error interno del servidor
    Este contenido no está disponible
    La page demandée est introuvable
    Votre session a expiré
    Erreur interne du serveur
    A página não foi encontrada
    Sua sessão expirou
    Erro interno do servidor
    Page nahi mila
    Cookies must be enabled to log in
    This browser is no longer supported
    Scripts are blocked on this page
    Enable cookies and reload the page
    The server returned an invalid response
    The page has expired due to inactivity
    Unable to connect to the database
    Your request could not be processed
    Session timed out, please log in again
    You are not authorized to view this page
    The requested resource is not available
    This account has been suspended
    The file you requested was not found
    Too many login attempts
    Please complete the security check to access this site
    Our site is down for maintenance
    Sorry, we could not find that page
    The link is broken or the page was removed
    Content not loading? Refresh the page
    Please try again in a few minutes
    Video failed to load
    Show caption text
    Close this window
    Photo description
    Enter text here
    Subtitle goes here
    Sample headline here
    Tap to play video
    Press to zoom image
    JavaScript ist in Ihrem Browser deaktiviert
    Bitte laden Sie die Seite neu
    Der Server ist nicht erreichbar
    Diese Seite verwendet Cookies
    Fehler beim Laden der Seite
    Active las cookies en su navegador
    El servidor no responde
    La sesión ha expirado
    Utilizamos cookies en este sitio
    Activez JavaScript dans votre navigateur
    Le serveur ne répond pas
    Impossible de charger la page
    Ce site utilise des cookies
    Ative os cookies no seu navegador
    O servidor não responde
    Não foi possível carregar a página
    Este site usa cookies
    Please turn on JavaScript in your browser settings
    Third-party cookies are blocked
    Manage cookie preferences
    Your browser version is too old for this site
    The proxy server refused the connection
    This page has moved permanently
    Connection reset by the server
    The database is temporarily offline
    Your login has expired, please sign in again
    You need permission to access this file
    Page is loading, please wait
    The website encountered an unexpected error
    The feed could not be loaded
    This video has been removed
    This content was deleted by the author
    Request failed with status code 500
    Access is restricted to subscribers
    Unsupported browser version
    Our servers are overloaded, try again later
    Play audio
    Hide caption
    Expand image
    Type your text here
    Body text goes here
    Insert image here
    Edit this headline
    Loading player
    Ihre Sitzung ist abgelaufen
    Bitte akzeptieren Sie Cookies
    Der Inhalt konnte nicht gefunden werden
    Ha ocurrido un error en el servidor
    Acepte las cookies para continuar
    No se pudo cargar la página
    Une erreur est survenue sur le serveur
    Acceptez les cookies pour continuer
    Ocorreu um erro no servidor
    Aceite os cookies para continuar
    Server error aaya hai, baad mein koshish karein
    Please disable your ad blocker to continue
    Your browser blocked this script
    Cookies help us deliver our services
    The page took too long to respond
    Your IP address has been blocked
    This page cannot be displayed
    A network error occurred
    Could not connect to the server
    Your session was closed for security reasons
    Please log in to see this page
    You do not have access to this content
    Service is not responding
    The video player could not start
    Too many connections
    This site is temporarily unavailable
    The page is no longer available
    Post not available
    Content is blocked in your region
    Upload failed, please try again
    JavaScript seems to be turned off
    Pause video
    Image caption
    Your headline here
    Enter your title here
    Dummy text goes here
    Click to add text
    Show translation
    Bitte melden Sie sich an, um fortzufahren
    Die Verbindung wurde unterbrochen
    Sie haben keine Berechtigung für diese Seite
    Su navegador no es compatible
    Habilite las cookies para continuar
    Error al cargar el contenido
    Votre navigateur n'est pas compatible
    Vous n'avez pas accès à cette page
    Seu navegador não é compatível
    Habilite o JavaScript para continuar
    Page load nahi ho raha, phir se koshish karein
""".strip().splitlines()
TALK = """
    A client still asks visitors to enable JavaScript for a plain price list, and I have opinions
    Access denied was the title of my talk in Bonn
    The error rate went from 4% to 0.1% after that change
    We moved our site to a new host in May
    Our page now loads in two seconds
    I broke the server again and learned a lot
    See the video below
    More on this page soon
    Read our new post on error budgets
    We baked cookies for the whole team
    Your feedback made this post better
    The video of the talk is on our site now
    Nobody reads error messages, so we rewrote ours
    The page nobody opened was our pricing page
    Cookies and coffee at the booth
    You asked for more content, here it is
    Thank you for the many requests
    Link in the comments
    Our service desk closed 40 requests
    Try this: write one page a day
    We closed the session with a quiz
    This image changed how we work
    She found a better way to load the van
    Please share this post
""".strip().splitlines()


def test_usual_notices_are_trusted_by_what_they_are_made_of():
    told = [all(residue.segment_kind(p) for p in residue.segments(t)) for t in USUAL]
    assert len(told) > 150 and sum(told) >= 0.88 * len(told)
    assert not any(residue.segment_kind(p) for t in TALK for p in residue.segments(t))


def slipped(rng, text):
    """A text with a slip or two of the pen, or with a word more."""
    letters = list(text)
    for _ in range(rng.choice([1, 1, 2])):
        k = rng.randrange(1, len(letters) - 1)
        letters[k : k + 1] = rng.choice([[], [letters[k], letters[k]], [rng.choice("aeioulnrst")], [letters[k], rng.choice("aeioulnrst")]])
    return "".join(letters)


def test_labels_spread_to_slips_of_the_pen(spark):
    rng = random.Random(4)
    known = [t for t in USUAL if len(t) >= 20 and all(residue.segment_kind(p) for p in residue.segments(t))]
    wrong = [w for t in known for _ in range(3) if (w := slipped(rng, t)) and not any(residue.segment_kind(p) for p in residue.segments(w))]
    found = {r.id for r in residue.residue_rows(table(spark, wrong + known)).collect()}
    assert len(wrong) > 40 and set(range(len(wrong), len(wrong) + len(known))) <= found
    assert len(found & set(range(len(wrong)))) >= 0.9 * len(wrong)
    assert not residue.residue_rows(table(spark, TALK)).collect()


def test_half_of_the_usual_wordings_find_the_rest(spark, monkeypatch):
    lines = residue.TRUSTED.strip().splitlines()
    rows = table(spark, lines + [f"A post of ten words or more about a van and snow.\n{x} again" for x in lines])
    every = {r.id for r in residue.residue_rows(rows).collect()}
    monkeypatch.setattr(residue, "TRUSTED", "\n".join(lines[::2]))
    half = {r.id for r in residue.residue_rows(rows).collect()}
    assert every >= set(range(len(lines))) and len(half) >= 0.9 * len(every)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_tables_meet_most_slips():
    """Against brute force: pairs whose texts are alike enough, by what the bits and the tables let through."""
    rng = random.Random(99)
    pairs = [(s, w[0]) for t in USUAL for s in residue.segments(t) for _ in range(20) if len(w := residue.segments(slipped(rng, s))) == 1 and distance(s, w[0]) <= 0.2 * max(len(s), len(w[0]))]
    a, b = (np.array(residue.letter_simhash([p[k] for p in pairs])).view(np.uint64) for k in (0, 1))
    turned = lambda x, n: (x >> np.uint64(n)) | (x << np.uint64((64 - n) % 64)) if n else x
    meet = np.zeros(len(pairs), bool)
    for t in range(residue.TABLES):
        meet |= ((turned(a, t * 64 // residue.TABLES) ^ turned(b, t * 64 // residue.TABLES)) & np.uint64(2**residue.KEY_BITS - 1)) == 0
    meet &= np.bitwise_count(a ^ b) <= residue.LINK_BITS
    assert len(pairs) > 2000 and meet.mean() >= 0.95 and meet[[len(s) < 20 for s, _ in pairs]].mean() >= 0.88


def test_spread_labels_against_brute_force(spark):
    rng = random.Random(12)
    chain = ["the quick station master closes the green gate at noon"]
    for _ in range(6):
        chain.append(slipped(rng, chain[-1]))
    texts = list(dict.fromkeys(chain + [slipped(rng, "nothing of this is near to the other sentence of the day") for _ in range(6)] + ["x " * 400 + "end", "x " * 399 + "end"]))
    hashes = residue.letter_simhash(texts).tolist()
    near = lambda i, j: distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])) and (hashes[i] ^ hashes[j]).bit_count() <= 7
    reached, open_ = {0}, [0]
    while open_:
        i = open_.pop()
        fresh = {j for j in range(len(texts)) if j not in reached and near(i, j)}
        reached |= fresh
        open_ += fresh
    nodes = spark.createDataFrame([*zip(texts, hashes, strict=True)] * 2, "segment string, hash bigint")
    found = {r.segment for r in residue.spread_labels(nodes, nodes.where(F.col("segment") == texts[0])).collect()}
    assert {texts[i] for i in reached} - {texts[0]} <= found <= set(chain)
    assert residue.spread_labels(nodes.where("hash IS NULL"), nodes.where("hash IS NULL")).count() == 0


def test_long_segments_are_nodes_too():
    long = "please enable javascript to view this page and then this page and also that page as this page needs javascript and cookies in your browser to work"
    assert len(long.split()) > 18 and residue.segment_kind(residue.segments(long)[0]) == "wording"
    frame = next(residue._pool(iter([pd.DataFrame({"id": [1], "text": ["word " * 5000]})])))
    assert len(frame) == 1 and len(frame["segment"][0].split()) == 5000


def test_filler_with_words_of_languages():
    bad = [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
        "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur",
        "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum",
        "Lorem ipsum 12 dolor sit amet 2024",
    ]
    good = ["Our designer banned lorem ipsum two years ago", "She put lorem ipsum in the deck and it went out", "No es culpa de nadie y el dolor pasa", "We met in Bonn in 2024"]
    assert [any(residue._is_filler(p.split()) for p in residue.segments(t)) for t in bad + good] == [True] * len(bad) + [False] * len(good)
    frame = next(residue._pool(iter([pd.DataFrame({"id": range(len(bad)), "text": bad})])))
    assert set(frame["kind"]) == {"filler"} and set(frame["id"]) == set(range(len(bad)))


# 7 personal data


def test_personal_data():
    cases = {
        "Write to a.b+c@mail.example now": {"EMAIL"}, "mine is ada [at] mail dot co dot example": {"EMAIL"}, "Follow @someone, booth 25": set(),
        "Call me on +44 7700 900 359 after six": {"PHONE"}, "Text (305) 555-0105 and wait": {"PHONE"}, "Order 2073873842 arrived after 12 days": set(), "on 2023-11-04 we had 24,981 readers": set(),
        "My SSN is 955-83-3022 and it fails": {"ID_NUMBER"}, "my social security number is 000 07 6063": {"ID_NUMBER"}, "pay GB82 WEST 1234 5698 7654 32 now": {"ID_NUMBER"},
        "pay GB82 WEST 1234 5698 7654 33 now": set(), "card 4111 1111 1111 1111 was used": {"ID_NUMBER"}, "Ticket REQ-382382 stayed open": set(),
        "We moved to 95 Elm Street, Springfield 02830.": {"ADDRESS"}, "P.O. Box 2211, Springfield": {"ADDRESS"}, "Musterweg 4a, 95595 Lauf": {"ADDRESS"}, "Calle Mayor 17, Madrid": {"ADDRESS"},
        "As Mira D. Ekberg put it": {"PERSON_NAME"}, "notes by VELOQKAR, Yusra": {"PERSON_NAME"}, "Acme Labs and Fenway Foods met in Boston": set(), "": set(), "metering every flat pays": set(),
    }
    for text, kinds in cases.items():
        assert {s[2] for s in pii.find_spans(text)} == kinds, text
    assert pii.find_spans(None) == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_names_by_context_and_numbers_by_checksum():
    cases = {
        "Michael Brown sent it": {"PERSON_NAME"}, "Sarah Connor sent it": {"PERSON_NAME"}, "Dr Katherine Johnson said": {"PERSON_NAME"}, "Barack Obama spoke": {"PERSON_NAME"}, "My name is Wei Zhang": {"PERSON_NAME"},
        "I met Emily Carter there": {"PERSON_NAME"}, "New York Times said so": set(), "the Central Park Zoo": set(), "Thanks to Fenway Foods for this": set(), "THANKS TO MODELLING CASH FLOWS NOW": set(),
        "YUSRA GALUNOZA TAUGHT ME THIS": {"PERSON_NAME"}, "Visit Maria Street in May": set(), "credit card number 4111 1111 1111 1112": set(), "card 4111 1111 1111 1112": set(), "card 4111 1111 1111 1111": {"ID_NUMBER"},
        "pay DE89 3704 0044 0532 0130 00": {"ID_NUMBER"}, "pay DE89 3704 0044 0532 0130 01": set(), "call it 12345678A": set(), "call it 12345678Z": {"ID_NUMBER"}, "git@github.com:foo/bar": set(), "pkg@1.2.3": set(),
    }
    for text, kinds in cases.items():
        assert {s[2] for s in pii.find_spans(text)} == kinds, text
    assert pii.verhoeff("234123412346") and not pii.verhoeff("234123412347") and pii.verhoeff("2363") and not pii.verhoeff("3263")
    assert pii.dni("12345678Z") and not pii.dni("12345678A") and pii.dni("X1234567L") and pii.cpf("52998224725") and not pii.cpf("52998224726")
    score = lambda t: pii.find_spans(t)[0][3]
    assert score("my inbox is a@b.example") > score("so a@b.example") and score("we moved to 95 Elm Street") > score("so 95 Elm Street") and score("my DNI 12345678Z") > score("my DNI 12345678A")


def test_gates_lose_nothing():
    cases = {
        "Thanks to Wiebke Hoffmann for this": "PERSON_NAME", "I met Dr. Wiebke Petersson today": "PERSON_NAME", "he wrote —Anna Petersson— there": "PERSON_NAME", "“Anna Petersson” said so": "PERSON_NAME",
        "Send it to 12 quai Voltaire, 75007 Paris": "ADDRESS", "at 7 impasse Lamier, 31000 Toulouse": "ADDRESS", "Plot no 12, Sector 5": "ADDRESS", "Shop no. 4, Block C": "ADDRESS",
        "in „Lindenufer 4“, third floor": "ADDRESS", "call +49-(30)-12-(34)-5 -(67": None, "my PAN is ABC 1 2 34": None,
    }
    for text, kind in cases.items():
        found = pii.find_spans(text)
        assert found == pii.find_spans(text, gated=False) and (kind is None or kind in {s[2] for s in found}), text


def test_masking(spark):
    texts = ["Ask a@b.example or call +44 7700 900 359.", None, "", "plain", "plain", "x " * 50_000 + "a@b.example"]
    found = {r.id: r.text for r in pii.mask_table(table(spark, texts)).collect()}
    assert found[0] == "Ask [EMAIL] or call [PHONE]." and found[1] is None and found[2] == "" and found[5].endswith("[EMAIL]")
    assert {(r.id, r.kind) for r in pii.kinds_found(table(spark, texts)).collect()} == {(0, "EMAIL"), (0, "PHONE"), (5, "EMAIL")}
    assert pii.mask_table(table(spark, [])).count() == 0


# 8 encoding


def test_encoding_against_the_library(spark):
    from tokenizers import Tokenizer

    peer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    peer.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab <|endoftext|>é☕ \n\t'sनम🔥0￿") for _ in range(rng.randrange(80))) for _ in range(300)] + ["a" * 20_000, "", None, "x", "x"]
    found = {r.id: list(r.ids) for r in bpe.encode_table(table(spark, texts), "idx").collect()}
    encoder = bpe.BytePairEncoder(bpe.read_vocabulary())
    for i, t in enumerate(texts):
        assert found[i] == peer.encode(t or "", add_special_tokens=False).ids
        assert encoder.decode(found[i]) == (t or "")
    assert bpe.encode_table(table(spark, []), "idx").count() == 0
    assert bpe.count_tokens(table(spark, ["x", None]), ["idx"]).orderBy("idx").collect()[1].tokens == 0


# 9 mixing


def test_mix(spark):
    rng = random.Random(6)
    words = {"news": "report said market today", "chat": "hey lol ok what", "ads": "buy now best price"}
    rows = [(i, s, " ".join(rng.choice(words[s].split()) for _ in range(rng.randrange(5, 60)))) for i, s in enumerate(rng.choices(list(words), [8, 3, 1], k=600))]
    rows += [(1000, None, words["ads"] * 3), (1001, "chat", None), (1002, "chat", ""), (1003, "other", "not wanted"), (None, "chat", "no id"), (1004, " ", words["chat"])]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("rate", F.lit(1)).withColumn("cap", F.lit(2))
    targets = spark.createDataFrame([("news", 0.5, 1), ("chat", 0.3, 2), ("ads", 0.2, 4)], "source string, target_share double, max_repeats bigint")
    mix = mixing.mix_sources(documents, targets)
    shares = {r.source: r for r in mixing.reached_shares(mix, targets).collect()}
    for source, goal, cap in (("news", 0.5, 1), ("chat", 0.3, 2), ("ads", 0.2, 4)):
        assert abs(shares[source].reached_share - goal) < 0.02 and shares[source].most_copies <= cap
    copies = {r.doc_id: r.copies for r in mix.documents.collect()}
    assert copies[1001] == copies[1002] == copies[1003] == 0 and None not in copies
    none = mixing.mix_sources(documents.where("doc_id < 0"), targets)
    assert none.documents.count() == 0 and mixing.reached_shares(none, targets).count() == 3


def test_rates_reach_what_can_be_reached():
    p = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [0.5, 0.5, 0], [0, 0.25, 0.75]])
    tokens, caps = np.array([1e9, 3e4, 200.0, 5e3, 700.0]), np.array([1.0, 2.0, 5.0, 1.0, 3.0])
    goal = np.array([5e4, 3e4, 900.0])
    rates = mixing.fit_rates(p, tokens, caps, goal)
    assert np.allclose((rates * tokens) @ p, goal, rtol=1e-4) and (rates >= 0).all() and (rates <= caps).all()
    short = mixing.fit_rates(p[:3], tokens[:3], caps[:3], np.array([5e4, 3e4, 5e3]))
    assert np.allclose(short * tokens[:3], [5e4, 3e4, 1000.0], rtol=1e-4)


def test_rates_that_do_not_settle_are_an_error(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError):
        mixing.fit_rates(np.array([[0.5, 0.5], [0.9, 0.1]]), np.array([10.0, 20.0]), np.array([1.0, 1.0]), np.array([5.0, 3.0]))


def test_classifier():
    rows = [("a", "red green blue"), ("b", "one two three")] * 20
    found = mixing.fit_classifier(rows, ["a", "b"])
    assert found.posterior("red blue green red")[0] > 0.8 and abs(found.posterior(None).sum() - 1) < 1e-9


# 10 subjects

TOPICS = {
    "law": "contract court verdict appeal lawyer statute clause hearing".split(),
    "sport": "goal match referee penalty striker league stadium coach".split(),
    "energy": "turbine grid battery solar boiler pump insulation meter".split(),
}
FRAMES = ["The {} and the {} were new to us.", "We spent a week on the {} and one on the {}.", "Nobody had seen the {} before the {} came.", "Ask for the {} or for the {}."]
FILLER = ["Some days you only get one thing done, and that is fine.", "We counted chairs and still ran out.", "Coffee is on me next time."]


def planted():
    rng = random.Random(9)
    documents, truth = [], {}
    for i in range(700):
        about = rng.sample(list(TOPICS), rng.choices([1, 2], [4, 1])[0])
        sentences = [rng.choice(FRAMES).format(*rng.sample(TOPICS[s], 2)) for s in about for _ in range(4)] + rng.sample(FILLER, 2)
        figure = rng.choice([s for s in TOPICS if s not in about])
        sentences.insert(1, f"It felt like a {rng.choice(TOPICS[figure])} in the wrong room.")
        documents.append((i, " ".join(sentences)))
        truth[i] = set(about)
    labels = [(i, rng.choice(list(TOPICS)) if rng.random() < 0.1 else rng.choice(sorted(truth[i]))) for i in range(0, 700, 6)]
    return documents, labels, truth


def test_subjects(spark):
    documents, labels, truth = planted()
    model = subjects.fit_model(documents, labels, list(TOPICS))
    found = {i: {s for s, _ in model.document_subjects(t)} for i, t in documents}
    hits = sum(len(found[i] & truth[i]) for i in truth)
    assert hits >= 0.95 * sum(map(len, truth.values())) and hits >= 0.95 * sum(map(len, found.values()))
    frame = spark.createDataFrame([*documents[:50], (900, None), (901, ""), (902, FILLER[0])], "doc_id bigint, text string").withColumn("subject", F.lit("x"))
    rows = subjects.subject_table(frame, model)
    assert {r.id for r in rows.collect()} <= set(range(50)) and abs(sum(r.share for r in subjects.composition(rows).collect()) - 1) < 1e-9
    names = spark.createDataFrame([(s, "d") for s in TOPICS], "subject string, description string")
    empty = subjects.fit_on(frame.where("doc_id < 0"), spark.createDataFrame([], "doc_id bigint, subject string, rater_id bigint"), names)
    assert subjects.subject_table(frame, empty).count() == 0


def test_subjects_come_from_the_leaves(monkeypatch):
    documents, labels, truth = planted()
    model = subjects.fit_model(documents, labels, list(TOPICS))
    assert model.leaves.shape[1] > 3 and {model.subjects[k] for k in model.labels.argmax(axis=1)} == set(TOPICS)
    monkeypatch.setattr(subjects, "LEAVES", 1)
    alone = subjects.fit_model(documents, labels, list(TOPICS))
    found = sum(len({s for s, _ in alone.document_subjects(t)} & truth[i]) for i, t in documents)
    assert alone.leaves.shape[1] == 1 and found < 0.5 * sum(map(len, truth.values()))


def test_subjects_of_a_table_in_languages(spark):
    documents, labels, truth = planted()
    turned = [(1000 + i, " ".join(w[::-1] if w.isalpha() else w for w in t.split(" "))) for i, t in documents]
    rows = [(i, t, None if i % 19 == 0 else " EN" if i < 1000 else "xx", "a") for i, t in documents + turned] + [(3000, None, "en", "a"), (3001, " ", None, "a"), (None, documents[0][1], "en", "a"), (3002, documents[0][1], "zz", "a")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, terms string").withColumn("sizes", F.lit(1)).repartition(3)
    told = spark.createDataFrame([(i, s, 1) for i, s in labels] + [(1000 + i, s, 1) for i, s in labels] + [(None, "law", 1), (1, None, 1), (2, "magic", 1)], "doc_id bigint, subject string, rater_id bigint")
    names = spark.createDataFrame([(s, "d") for s in TOPICS] + [(None, "d")], "subject string, description string")
    found: dict = {}
    for r in subjects.fitted_subjects(frame, told, names).collect():
        found.setdefault(r.id, set()).add(r.subject)
    expected = truth | {1000 + i: s for i, s in truth.items()}
    hits = sum(len(found.get(i, set()) & s) for i, s in expected.items())
    assert hits >= 0.95 * sum(map(len, expected.values())) and hits >= 0.95 * sum(len(s) for i, s in found.items() if i in expected)
    assert not {None, 3000, 3001} & set(found)
    assert subjects.fitted_subjects(frame.where("doc_id < 0"), told, names).count() == 0
    assert subjects.fitted_subjects(frame, told.where("doc_id < 0"), names).count() == 0


def test_names_of_queries():
    assert {f"p{n}_" for n in range(1, 11)} == {re.match(r"p\d+_", q)[0] for q in queries.queries()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data is not there")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    data = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.execute(f"create view {file[:-8]} as select * from '{data}/{file}'")
    expected = connection.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    mine = queries.queries()[name](spark, data).select(*columns).collect()
    assert sorted(map(tuple, mine), key=str) == sorted(expected.fetchall(), key=str)


def test_subject_terms_never_meet_however_many_there_are():
    """A language of few terms keeps its own beside one of millions, which no table of fixed size has places for."""
    many = np.arange(3_000_000) * 613 % (1 << 31)
    few = many[:1000]
    keys = np.concatenate([subjects.term_keys(many, 1), subjects.term_keys(few, 0)])
    index = subjects.Index(keys, np.arange(len(keys)))
    assert (index.of(many, 1) == np.arange(len(many))).all() and (index.of(few, 0) == len(many) + np.arange(1000)).all()
    assert (index.of(many[1000:2000], 0) == subjects.ABSENT).all() and (index.of(few, -1) == subjects.ABSENT).all()
    batch = subjects.Passages(np.arange(2), ["de", ""], np.concatenate([few[:3], many[1000:1002], few[:1]]).astype(np.int32), np.array([3, 3]), np.array([0, 1]))
    known = subjects.known_rows(batch, index, ["de", "en"])
    assert known.terms.tolist() == [3_000_000, 3_000_001, 3_000_002, 1000, 1001, 0]


def test_subject_counts_of_a_corpus_are_whole_and_exact():
    """Counts given away in parts add up, and rare terms are left out by their sum, not by a part."""
    batches = [subjects.Passages(np.arange(3) + 3 * k, ["de", "en", ""], np.array([7, 7, 9, 8], np.int32), np.array([1, 1, 1, 1]), np.array([0, 1, 1, 2])) for k in range(3)]
    corpus = subjects.Corpus(batches, {"de": 3, "en": 3, "": 3})
    held = subjects.HELD_COUNTS
    try:
        subjects.HELD_COUNTS = 1
        told = corpus.sum_of(subjects._frequency_pass(["de", "en"]), 3, 2, 3)
    finally:
        subjects.HELD_COUNTS = held
    assert told.tolist() == [[7, 0, 3], [7, 1, 3], [9, 1, 3]]
    assert not len(corpus.sum_of(subjects._frequency_pass(["de", "en"]), 3, 2, 4))


def test_residue_slip_in_an_ordinary_sentence_labels_nothing(spark):
    """One slip makes a notice of an ordinary sentence by its words; the sentence itself is frequent and no residue."""
    talk, slip, notice = "The error rate went from 4% to 1%", "The error rate went form 4% to 1%", "Please enable JavaScript to view this page"
    assert residue.segment_kind(residue.segments(slip)[0]) and not residue.segment_kind(residue.segments(talk)[0])
    texts = [talk] * 30 + [slip] + [notice] * 3 + ["Pleese enable JavaScript to veiw this page"]
    assert {r.id for r in residue.residue_rows(table(spark, texts)).collect()} == set(range(31, 35))


def test_residue_slip_of_a_slip_labels_nothing(spark):
    """The frequent sentence is two links away from the trusted slip; the notice, its slip and its other trusted form stay."""
    talk, slip, twice, notice = "The error rate went from 4% to 1%", "Again the error rate went from 4% to 1%", "Again the error rate from 4% to 1%", "Please enable JavaScript to view this page"
    kinds = [residue.segment_kind(residue.segments(t)[0]) for t in (talk, slip, twice)]
    assert kinds == [None, None, "wording"]
    texts = [talk] * 30 + [slip, slip, twice] + [notice] * 3 + ["Pleese enable JavaScript to veiw this page"]
    assert {r.id for r in residue.residue_rows(table(spark, texts)).collect()} == set(range(33, 37))


def test_labels_reach_what_they_should():
    told = lambda links, counts, **roles: residue.judged(links, counts, dict.fromkeys(counts, residue.MET) | roles)
    words, usual = residue.WORDS, residue.USUAL
    assert told([("t", "u"), ("u", "s")], {"t": 1, "u": 2, "s": 30}, t=words) == set()
    assert told([("t", "u"), ("u", "s")], {"t": 100, "u": 2, "s": 30}, t=words) == {"t", "u"}
    assert told([("t", "u"), ("u", "v")], {"t": 100, "u": 2, "v": 1}, t=words) == {"t", "u", "v"}
    assert told([("t", "u"), ("u", "v"), ("v", "s")], {"t": 1, "u": 5, "v": 9, "s": 40}, t=words) == {"t", "u", "v"}
    assert told([("t", "s"), ("s", "u")], {"t": 0, "s": 500, "u": 1}, t=usual) == {"t", "s", "u"}
    assert told([("t", "s"), ("r", "s")], {"t": 0, "s": 500, "r": 1}, t=usual, r=words) == {"t", "s", "r"}
    assert told([("t", "r"), ("r", "s")], {"t": 60, "r": 1, "s": 30}, t=words, r=words) == {"t", "r"}
    assert told([("t", "u"), ("u", "s"), ("u", "x"), ("x", "n")], {"t": 1, "u": 1, "s": 90, "x": 1, "n": 50}, t=words, n=words) == {"n", "x"}


def test_residue_judged_by_components_is_the_same(spark, monkeypatch):
    talk, twice, notice = "The error rate went from 4% to 1%", "Again the error rate from 4% to 1%", "Please enable JavaScript to view this page"
    texts = [talk] * 30 + ["Again the error rate went from 4% to 1%"] * 2 + [twice] + [notice] * 3 + ["Pleese enable JavaScript to veiw this page"]
    monkeypatch.setattr(residue, "PROBES", 0)
    assert {r.id for r in residue.residue_rows(table(spark, texts)).collect()} == set(range(33, 37))
