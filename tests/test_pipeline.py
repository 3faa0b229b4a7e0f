"""Retrieval against a plain model, and the batch, the prompts, the readers and the streams on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import htmlx, jsonx
from postmill.functions.tags import normalize_tags, remap_tags
from postmill.operators import enrich, generate, graph, quality, retrieval
from postmill.plans import queries as plans
from postmill.sources import readers, writers
from postmill.streaming import incremental

POST = "idx bigint, text string, engagement bigint, line_count bigint, language string, tags array<string>"
RICH = "We built a small tool for our team this spring.\nIt saved every one of us an hour a day.\nHere is what we learned.\nTell us what you think."


def test_examples_against_the_model(spark):
    rng = random.Random(4)
    texts = [f"This is text number {k} and it has quite enough words to count as a post" + " more" * (k % 3) for k in range(25)]
    posts = [
        (i, rng.choice(texts), rng.choice([0, 5, 5, None]), rng.choice([1, 5, 12]), rng.choice(["English", "Hinglish"]), rng.sample(["A", "B", "C"], rng.randint(0, 2)))
        for i in range(160)
    ]
    posts += [(900, None, 5, 1, "English", ["A"]), (901, "too thin", 10**6, 1, "English", ["A"]), (902, texts[0], 5, 1, None, None)]
    briefs = [(k, length, language, tag) for k, (length, language, tag) in enumerate((a, b, c) for a in ("Short", "Medium", "Long") for b in ("English", "Hinglish") for c in "ABZ")]
    silver = quality.silver(spark.createDataFrame(posts, POST))
    frame = spark.createDataFrame(briefs, "brief_id bigint, length string, language string, tag string")
    found = retrieval.prompt_examples(silver, frame, limit=7).collect()
    usable = [r for r in silver.collect() if r.reason is None and r.fp]
    bucket = lambda n: "Short" if n < 5 else "Medium" if n <= 10 else "Long"
    for k, length, language, tag in briefs:
        tiers = [
            [r for r in usable if r.language == language and bucket(r.line_count) == length and tag in r.tags],
            [r for r in usable if r.language == language and tag in r.tags],
            [r for r in usable if tag in r.tags],
            usable,
        ]
        expected, seen = [], set()
        for tier, rows in zip(retrieval.TIERS, tiers, strict=True):
            best = {}
            for r in rows:
                if r.fp not in best or (r.score, r.engagement, r.length) > (best[r.fp].score, best[r.fp].engagement, best[r.fp].length):
                    best[r.fp] = r
            for r in sorted(best.values(), key=lambda r: (r.score, r.engagement, r.length), reverse=True):
                if r.fp not in seen:
                    seen.add(r.fp)
                    expected.append((r.idx, tier))
        mine = [(r.idx, r.match_tier) for r in sorted((r for r in found if r.brief_id == k), key=lambda r: r.position)]
        assert mine == expected[:7], k


def test_nothing_to_show(spark):
    silver = quality.silver(spark.createDataFrame([], POST))
    frame = spark.createDataFrame([(1, "Short", "English", "A")], "brief_id bigint, length string, language string, tag string")
    assert retrieval.prompt_examples(silver, frame).count() == 0
    assert retrieval.filtered_posts(silver, "Short", "English", "A").count() == 0
    assert retrieval.tag_universe(silver).count() == 0
    assert retrieval.dashboard_counts(silver).first().n_posts == 0


def test_rich_beats_viral(spark):
    posts = [(0, RICH, 5, 4, "English", ["AI"]), (1, RICH, 50, 4, "English", ["AI"]), (2, "AI jobs", 100000, 1, "English", ["AI"]), (3, "Play video", 9, 1, "English", ["AI"])]
    found = retrieval.filtered_posts(quality.silver(spark.createDataFrame(posts, POST)), "Short", "English", "AI").collect()
    assert [(r.idx, r.first_idx, r.engagement) for r in found] == [(1, 0, 50)]


def test_tags(spark):
    frame = spark.createDataFrame([([" a ", "b", "a", "", None],), (None,)], "t array<string>")
    assert [r.t for r in frame.select(normalize_tags(F.col("t")).alias("t")).collect()] == [["a", "b"], []]
    mapping = F.create_map(F.lit("a"), F.lit("B"), F.lit("b"), F.lit("B"))
    assert frame.select(remap_tags(normalize_tags(F.col("t")), mapping).alias("t")).first().t == ["B"]


def clients():
    """A factory that travels to the workers by value."""

    def make():
        return answer

    def answer(prompt):
        if "unify tags" in prompt:
            return '{"job hunting": "Job Search"}'
        if "never" in prompt:
            return "no json"
        if "odd" in prompt:
            raise RuntimeError("gone")
        return '```json\n{"language": "English", "tags": ["job hunting", "AI", "third"]}\n```'

    return make


def test_batch(spark):
    almost = RICH.replace("every one of us", "each one of us")
    raw = [(0, RICH, 5, "x"), (1, "Play video", 1, "x"), (2, almost, 20, "x"), (3, RICH + "\nnever mind the rest of it", 1, "x"), (4, RICH + "\nodd thing at the end, really", 1, "x"), (5, RICH + "\nA last line that differs a lot from all of the others above it.", None, "x")]
    frame = spark.createDataFrame(raw, "idx bigint, text string, engagement bigint, fp string")
    done = enrich.process_posts(frame, clients(), retries=1)
    posts = {r.idx: r for r in done.posts.collect()}
    assert set(posts) == {2, 5} and posts[2].tags == ["Job Search", "AI"] and posts[2].line_count == 4
    failed = {(r.idx, r.stage, r.reason, r.attempts) for r in done.failures.collect()}
    assert failed == {
        (0, "final_deduplication", "near_duplicate", 1), (1, "quality_filter", "media_placeholder", 1),
        (3, "metadata_extraction", "retry_exhausted", 2), (4, "metadata_extraction", "retry_exhausted", 2),
    }
    again = enrich.process_posts(frame.where("idx in (2, 5)"), lambda: (lambda prompt: "{}" if "unify" in prompt else 1 / 0), checkpoint=done.checkpoint)
    assert {r.idx for r in again.posts.collect()} == {2, 5} and again.failures.count() == 0
    with pytest.raises(ValueError, match="missing text"):
        enrich.process_posts(spark.createDataFrame([(1, " ", 1)], "idx bigint, text string, engagement bigint"), clients())
    assert enrich.process_posts(frame.where("idx < 0"), clients()).posts.count() == 0


def test_posts_without_a_text_are_not_asked_about(spark):
    """What is no post by quality comes along with a null text, in the same table as the answers."""
    frame = spark.createDataFrame([(0, RICH, None), (1, None, "too_short")], "idx bigint, text string, reason string")
    found = {r.idx: r for r in enrich.enrich(frame, clients(), retries=1).collect()}
    assert found[0].answer_language == "English" and found[0].attempts == 1
    assert found[1].answer_language is None and found[1].attempts == 0 and found[1].reason == "too_short"


def test_retries():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "{}"

    assert enrich.with_retries(flaky, "p", jsonx.parse_object, 3).attempts == 3
    assert enrich.with_retries(lambda p: "[1]", "p", jsonx.parse_object, 0).error_type == "ResponseError"


def test_json():
    assert jsonx.parse_object('x {"a": 1, "a": 2} y')[0] == {"a": 2}
    assert jsonx.parse_object('[{"a": 1}]')[0] is None
    assert jsonx.parse_object("```JSON\n{\"a\": 1}\n```")[0] == {"a": 1}
    assert jsonx.parse_object('{"a": "x\ny\t\r\nz"}', repair=True)[0] == {"a": "x\ny\t\nz"}
    assert jsonx.escape_controls('"a\\\nb" \n "\x01"') == '"a\\\nb" \n "\\u0001"'
    assert jsonx.checked_variants('{"variants": ["a", "b"]}')[0] is None
    assert jsonx.checked_metadata('{"language": "Hinglish", "tags": "x"}', ("Hinglish",))[0] == {"language": "Hinglish", "tags": ["x"]}
    page = {"elements": [{"commentary": {"text": "T"}, "socialDetail": {"totalSocialActivityCounts": {"count": "1.2K"}}}], "totalSocialActivityCount": 7}
    assert jsonx.post_texts(page) == ["T", "T"] and jsonx.activity_counts(page) == ["7", "1.2K", "1.2K"]


def test_html(spark):
    card = '<article class="x"><a href="#">Link</a>text<br>more<div class="feed-shared-text">In <a>here</a>there<br>next</div><button aria-label="12 reactions">9</button></article>'
    assert htmlx.card_text(card) == "In here there\nnext" or htmlx.card_text(card).startswith("In")
    frame = spark.createDataFrame([(card,), ("<p>ab</p>",), (None,), ("<div data-urn='u'>" + "long enough text " * 3 + "<button>5</button></div>",)], "html string")
    found = frame.select(htmlx.html_card(F.col("html")).alias("c")).select(htmlx.card_likes(F.col("c")).alias("n"), htmlx.likely_post(F.col("c")).alias("p"), htmlx.is_card(F.col("c")).alias("is")).collect()
    assert [(r.n, r.p, r["is"]) for r in found] == [(12, True, True), (0, False, False), (0, False, False), (5, True, True)]


def test_pages_and_activity(spark):
    body = "A post of a page with more than a few words in it."
    pages = spark.createDataFrame([(k, f'<article><div class="feed-shared-text">{body}</div><p>3 likes</p></article>') for k in (1, 2)] + [(3, None)], "idx bigint, html string")
    assert [(r.idx, r.text, r.engagement) for r in readers.posts_of_pages(pages).collect()] == [(1, body, 3)]
    document = json.dumps({"included": [{"commentary": {"text": body}, "totalSocialActivityCount": "2K"}], "elements": []})
    documents = spark.createDataFrame([(1, document), (2, "not json"), (3, None)], "idx bigint, json string")
    assert [(r.idx, r.text, r.engagement) for r in readers.posts_of_activity(documents).collect()] == [(1, body, 2000)]


def test_prompts(spark):
    wanted = spark.createDataFrame([(1, "Short", "English", "AI", "Bold", "General", "Educate", "First Person", "Soft", 1), (2, "Huge", "English", "AI", "Bold", "General", "Educate", "First Person", "Soft", 1)],
        "brief_id bigint, length string, language string, tag string, tone string, audience string, goal string, voice string, cta_strength string, hashtag_count int")
    shown = spark.createDataFrame([(1, 1, " first ", "Exact match"), (1, 2, " ", "x"), (1, 3, "third", ""), (1, 6, "sixth", "x")], "brief_id bigint, position bigint, text string, match_label string")
    made = {r.brief_id: r.prompt for r in generate.build_prompts(wanted, shown).collect()}
    lines = made[1].split("\n")
    assert made[2] is None and lines[0].startswith("Generate a LinkedIn post") and lines[2] == "1) Topic: AI" and lines[3] == "2) Length: Short (1 to 5 lines)"
    assert "- Hashtag rule: Include exactly 1 relevant hashtag on the final line only, separated by spaces." in lines
    at = lines.index("Example 1 (Exact match)")
    assert lines[at - 2 : at + 5] == [generate.EXAMPLES_NOTE, "", "Example 1 (Exact match)", "first", "", "Example 2", "third"]
    assert "6) Return Format:" in generate.build_prompts(wanted, shown, variants=True).first().prompt
    answer = lambda: (lambda prompt: '{"variants": ["One. Two. #x", "b", "c"]}')
    done = generate.generate(generate.build_prompts(wanted, shown, True), wanted, answer, variants=True)
    cards = generate.variant_cards(done).orderBy("position").collect()
    assert [c.text for c in cards] == ["One.\nTwo.\n#x", "b", "c"] and cards[0].line_label == "3 lines" and cards[0].copy_target == "variant-1-insight-led-hook"
    bad = generate.generate(generate.build_prompts(wanted, shown, True), wanted, lambda: (lambda prompt: "not json"), variants=True).collect()
    assert [(r.text, bool(r.error)) for r in bad] == [(None, True)]
    assert [r.value for r in generate.brief_chips(wanted.where("brief_id = 1")).orderBy("position").collect()][-1] == "CTA: Soft / 1 hashtag"
    with pytest.raises(ValueError):
        generate.Options(tone="Loud")


def test_files(spark, tmp_path):
    path = str(tmp_path / "posts.json")
    (tmp_path / "posts.json").write_text(json.dumps([{"text": "a", "engagement": "8", "tags": 42, "line_count": 1.9}, {"text": "b", "tags": [" x", "x"], "language": " "}]))
    found = [tuple(r) for r in readers.read_processed_posts(spark, path).orderBy("idx").collect()]
    assert found == [(0, "a", 8, 1, "English", ["42"]), (1, "b", 0, 0, "English", ["x"])]
    for content in ('{"text": "a"}', '[{"text": " "}]', "[1]"):
        (tmp_path / "bad.json").write_text(content)
        with pytest.raises(Exception):  # noqa: B017
            readers.read_raw_posts(spark, str(tmp_path / "bad.json")).collect()
    posts = readers.read_processed_posts(spark, path)
    writers.write_checkpoint(posts, str(tmp_path / "c.json"))
    assert readers.read_checkpoint(spark, str(tmp_path / "c.json")).count() == 2
    assert readers.read_checkpoint(spark, str(tmp_path / "none.json")).count() == 0
    assert writers.write_json_list(posts, str(tmp_path / "o.json")) == 2
    assert [p["text"] for p in json.loads((tmp_path / "o.json").read_text())] == ["a", "b"]
    assert writers.write_failures(spark.createDataFrame([], enrich.FAILURE_COLUMNS), str(tmp_path / "f.json")) == 0
    assert json.loads((tmp_path / "f.json").read_text()) == []
    assert readers.sidecar_path("/x/posts.json", "failures") == "/x/posts.failures.json"
    assert readers.Settings.from_environment({"POSTMILL_MAX_SCROLLS": "x", "POSTMILL_SCROLL_PAUSE": "2"}).scroll_pause == 2.0
    assert readers.first_source(posts.where("idx < 0"), posts).count() == 2


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, k) for k in range(400, 450)] + [(1, None), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for x in list(parent)}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "idx bigint, text string, engagement bigint"
    spark.createDataFrame([(0, RICH, 1), (1, "Play video", 1)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    incremental.enrich_stream(stream(), str(tmp_path / "out"), clients()).awaitTermination()
    spark.createDataFrame([(0, RICH, 1), (2, RICH + "\nAn ending of its own that makes it another post altogether.", 1)], schema).write.mode("append").parquet(source)
    incremental.enrich_stream(stream(), str(tmp_path / "out"), clients()).awaitTermination()
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "out/posts")).collect()) == [0, 2]


def test_every_query_has_a_name_and_runs_lazily():
    assert len(plans.queries()) >= 40 and set(plans.oracle_sql()) <= set(plans.queries())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_ranking_shuffles_numbers_and_no_texts(spark):
    posts = [(i, f"{RICH}\nNumber {i % 40}.", i % 7, i % 12, "English", ["A", "B"]) for i in range(120)]
    from postmill.session import cut_lineage

    silver = cut_lineage(quality.silver(spark.createDataFrame(posts, POST)))
    frame = spark.createDataFrame([(1, "Short", "English", "A")], "brief_id bigint, length string, language string, tag string")
    found = retrieval.prompt_examples(silver, frame)
    lines = plan_of(found).split("\n")
    assert sum("WindowGroupLimit" in line for line in lines) >= 4  # cut before and after each shuffle
    plan = plan_of(retrieval.filtered_posts(silver, "Short", "English", "A"))
    assert "SinglePartition" not in plan and "Window" not in plan  # sorted by ranges, and numbered from there
    ranked = retrieval.filtered_posts(silver, "Short", "English", "A").orderBy("rank").collect()
    worth = [(r.score, r.engagement, r.length, -r.first_idx) for r in ranked]
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and worth == sorted(worth, reverse=True) and len(ranked) > 10


def test_numbers_over_many_partitions(spark):
    frame = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1009).alias("v"))
    found = retrieval.numbered(frame, [F.col("v").desc()]).collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: -r.v)] == list(range(1, 1001))
    assert retrieval.numbered(frame.where("v < 0"), [F.col("v")]).count() == 0


def test_dashboard_reads_the_posts_once(spark):
    posts = [(1, RICH, 1, 1, "English", ["A", "B"]), (2, RICH + " more", 1, 1, "Hinglish", ["B", " "]), (3, "thin", 1, 1, " ", ["C"]), (4, None, 1, 1, None, None)]
    found = retrieval.dashboard_counts(quality.silver(spark.createDataFrame(posts, POST)))
    assert tuple(found.first()) == (4, 2, "English,Hinglish") and plan_of(found).count("ArrowEvalPython") == 1
    assert tuple(retrieval.dashboard_counts(quality.silver(spark.createDataFrame([], POST))).first()) == (0, 0, "")


def test_every_card_of_a_page(spark):
    say = lambda k: f"Card number {k} of this page says more than a few words."
    page = f"""<html><body><nav><p>Menu of the page with many words in it</p></nav><main>
      <article><div class="feed-shared-text">{say(1)}<br>And a second line.</div><button aria-label="12 reactions">ok</button></article>
      <div class="occludable-update"><article><p>{say(2)}</p><button>3</button></article></div>
      <div data-urn=""><p>{say(3)}</p></div><div data-urn="u"><span class="break-words">{say(4)}</span><p>7 likes</p></div>
      <article><p>short</p></article><div class="sidebar"><p>{say(5)}</p></div></main></body></html>"""
    pages = spark.createDataFrame([(1, page), (2, page), (3, None), (4, ""), (5, "<article>"), (6, "<p>no card at all on this page</p>")], "idx bigint, html string").withColumn("card", F.lit(1)).withColumn("at", F.lit(2))
    found = {r.text: (r.idx, r.engagement) for r in readers.posts_of_pages(pages).collect()}
    assert found == {say(1) + "\nAnd a second line.": (1, 12), say(2): (1, 3), say(4): (1, 7)}


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"idx": k, "text": f"post {k}", "engagement": "1,200" if k else None, "more": [1]}) for k in range(50)]
    (tmp_path / "posts.jsonl").write_text("\n".join([*lines, "", "  "]))
    found = readers.read_raw_lines(spark, str(tmp_path / "posts.jsonl")).orderBy("idx").collect()
    assert [r.idx for r in found] == list(range(50)) and found[3].text == "post 3"
    for bad in ("[1]", "no json", '{"text": "a"}', '{"idx": 1, "text": " "}'):
        (tmp_path / "bad.jsonl").write_text("\n".join([lines[0], bad]))
        with pytest.raises(Exception):  # noqa: B017
            readers.read_raw_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_answers_outlive_a_batch_that_fails(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(0, RICH, 5), (1, RICH + "\nAn ending of its own that makes it another post altogether.", 1)], "idx bigint, text string, engagement bigint")
    progress = str(tmp_path / "answers")
    with monkeypatch.context() as patched:
        patched.setattr(enrich, "resolve_duplicates", lambda ranked: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            enrich.process_posts(frame, clients(), progress=progress)
    assert spark.read.parquet(progress).count() == 2
    silent = lambda: (lambda prompt: '{"job hunting": "Work"}' if "unify" in prompt else 1 / 0)
    done = enrich.process_posts(frame, silent, progress=progress)
    assert {r.idx: r.tags for r in done.posts.collect()} == {0: ["Work", "AI"], 1: ["Work", "AI"]} and done.failures.count() == 0


def test_blank_posts_do_not_stop_a_stream(spark, tmp_path):
    schema = "idx bigint, text string, engagement bigint"
    rows = [(0, RICH, 1), (1, "​ ", 1), (2, None, 1), (3, "", 1), (None, RICH, 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.enrich_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), clients()).awaitTermination()
    assert [r.idx for r in spark.read.parquet(str(tmp_path / "out/posts")).collect()] == [0]
    failed = {(r.idx, r.stage, r.reason) for r in spark.read.parquet(str(tmp_path / "out/failures")).collect()}
    assert failed == {(k, "quality_filter", "empty_text") for k in (1, 2, 3)}


def test_quality_counts_and_first_copies_of_a_stream(spark, tmp_path):
    rows = [(k, text, f"2024-01-0{day} 00:00:00") for k, (text, day) in enumerate([(RICH, 1), (RICH.upper(), 1), ("thin", 1), (RICH, 2), (None, 3)])]
    frame = spark.createDataFrame(rows, "idx bigint, text string, at string").select("idx", "text", F.col("at").cast("timestamp").alias("scraped_at"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, made, mode in (("tally", incremental.quality_stream(stream()), "complete"), ("copies", incremental.first_copies(stream()), "append")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    tally = {(str(r.window.start)[:10], r.reason): r.n_posts for r in spark.table("tally").collect()}
    assert tally == {("2024-01-01", "ok"): 2, ("2024-01-01", "thin_post"): 1, ("2024-01-02", "ok"): 1, ("2024-01-03", "empty_text"): 1}
    assert spark.table("copies").count() == 2


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from postmill import session

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:  # noqa: N801
            isDefined = staticmethod(lambda: False)

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session)
