"""Example builders, stems, and what a user's conversations and uploads do."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gristmill.functions import chunking, stem, text
from gristmill.operators import build, chat, dataset, evaluate, lifecycle, limits, quality, retrieve
from gristmill.operators.prompts import Contract
from gristmill.plans import models
from gristmill.sources import io
from gristmill.streaming import events as streams

WORDS = "river stone garden window paper engine market bridge forest island copper silver winter summer morning evening travel letter number doctor".split()


def passage(lib: int, doc: int, i: int) -> str:
    """A worthy passage with a beginning of its own."""
    body = " ".join(WORDS[(lib * 7 + doc * 3 + i * 5 + j * (i + 1)) % len(WORDS)] for j in range(60))
    return f"Passage {WORDS[lib]} {WORDS[doc + 4]} {WORDS[i + 8]} of library {lib} tells {body}."


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"lib{a}", f"lib{a}-doc{d}.txt", i, passage(a, d, i), f"Title {a}{d}") for a in range(2) for d in range(3) for i in range(6)]
    return spark.createDataFrame(rows, "library string, document string, chunk_index int, text string, title string").cache()


def contents(r) -> list[str]:
    return [s["content"] for s in r["sources"]]


def test_single_has_its_gold_among_others(spark, corpus):
    made, rejected = build.single(corpus, corpus, models.Extractive(), top_k=5, n=2)
    rows = made.collect()
    assert len(rows) == 72 and len({r["example_id"] for r in rows}) == 72 and rejected.count() == 0
    for r in rows:
        assert r["gold"][0]["text"] in contents(r) and len(r["sources"]) == r["k"] == len(set(contents(r)))
        assert r["answer_spans"][0] in r["gold"][0]["text"] and r["answer_spans"][0] in r["target"]
        assert {s["name"][:5] for s in r["sources"]} == {"Title"} if r["name_style"] == "title" else all(s["name"].endswith(".txt") for s in r["sources"])
    assert len({contents(r).index(r["gold"][0]["text"]) for r in rows}) > 2  # not always first
    assert {r["k"] for r in rows} > {5}
    assert [r["reason"] for r in dataset.check(made).collect()] == [None] * 72


def test_negative_lacks_the_gold_and_what_is_beside_it(spark, corpus):
    made, rejected = build.negative(corpus, corpus, models.Extractive())
    where = {r["text"]: (r["document"], r["chunk_index"]) for r in corpus.collect()}
    rows = made.collect()
    assert rows and len(rows) + rejected.count() == 36
    for r in rows:
        g = (r["gold"][0]["document"], r["gold"][0]["index"])
        assert all(d != g[0] or abs(i - g[1]) > 1 for d, i in map(where.get, contents(r)))
        assert r["target"].startswith(Contract().abstention() + " The sources cover ") and not r["answerable"]
    assert {r["reason"] for r in dataset.check(made).collect()} == {None}
    twin = corpus.where("library = 'lib0'").limit(1)
    copied = corpus.unionByName(twin.withColumn("document", F.lit("lib0-copy.txt")))
    _, rejected = build.negative(twin, copied, models.Extractive())
    assert [tuple(r) for r in build.rejections(rejected).collect()] == [("negative_still_answerable", 1)]


def test_two_gold_and_partial(spark, corpus):
    made, _ = build.two_gold(corpus, corpus, models.Extractive())
    rows = made.collect()
    assert len(rows) == 36
    for r in rows:
        assert len({g["document"] for g in r["gold"]}) == 2 and {g["text"] for g in r["gold"]} <= set(contents(r)) and r["target"].count("> **") == 2
    assert {r["reason"] for r in dataset.check(made).collect()} == {None}
    made, _ = build.partial(corpus, corpus, models.Extractive())
    rows = made.collect()
    assert len(rows) == 36 and all(" Also, what about " in r["question"] and r["covers"] and not r["acknowledges"] for r in rows)
    assert {r["reason"] for r in dataset.check(made).collect()} == {"partial_uncovered_not_acknowledged"}
    lone = corpus.where("document = 'lib0-doc0.txt'")
    other = {r["gold"][1]["index"] - r["gold"][0]["index"] for r in build.two_gold(lone, lone, models.Extractive())[0].collect()}
    assert other and all(abs(d) > 1 for d in other)


def test_multiturn_has_three_kinds(spark, corpus):
    first, _ = build.single(corpus.where("chunk_index < 3"), corpus, models.Extractive(), n=1)
    unused = corpus.where("chunk_index >= 3").withColumn("gold_id", F.xxhash64("document", "chunk_index"))
    pairs = dataset.pair_turns(first.select("library", F.col("gold")[0]["document"].alias("document"), "example_id"), unused)
    made, rejected = build.multiturn(first, unused, pairs, corpus, models.Extractive())
    rows = made.collect()
    assert len(rows) + rejected.count() == 18 and {r["type"] for r in rows} == {"multiturn_answerable", "multiturn_uncovered", "multiturn_empty"}
    for r in rows:
        assert [m["role"] for m in r["history"]] == ["user", "assistant"] and r["history"][1]["content"].startswith("The document says so.")
        assert (r["gold"][0]["text"] in contents(r)) == (r["type"] == "multiturn_answerable") and (r["type"] != "multiturn_empty" or not r["sources"])
    assert {r["reason"] for r in dataset.check(made).collect()} == {None}
    text_of = {r["example_id"]: r["section"] for r in build.review(dataset.check(made)).collect()}
    assert len(text_of) == len(rows) and all(s.startswith("## [multiturn") and "- history user: " in s and "**A:**" in s for s in text_of.values())


def test_spans_that_are_not_in_the_passage_are_turned_down(spark, corpus):
    class Wrong(models.Extractive):
        def questions(self, passage, n):
            return F.transform(super().questions(passage, n), lambda q: F.struct(q["question"].alias("question"), F.lit("never said").alias("answer_span")))

        def two_passage_question(self, a, b):
            return F.struct(F.lit("What?").alias("question"), F.lit("never said").alias("answer_span_a"), F.lit("nor this").alias("answer_span_b"))

    made, rejected = build.single(corpus, corpus, Wrong(), n=1)
    assert made.count() == 0 and [tuple(r) for r in build.rejections(rejected, build.two_gold(corpus, corpus, Wrong())[1]).orderBy("reason").collect()] == [("question_span_not_in_passage", 36), ("two_gold_span_not_in_passage", 36)]


def test_small_parts(spark):
    d = spark.createDataFrame([("a b", "x  a b  y")], "s string, p string")
    assert d.select(dataset.span_in_passage(F.col("s"), F.col("p")), dataset.span_in_passage(F.lit(""), F.col("p")), dataset.span_in_passage(F.lit("b c"), F.col("p"))).first() == (True, False, False)
    assert [r["value"] for r in dataset.kept_counts(spark.createDataFrame([("x", "l"), ("y", "l"), ("x", "m")], "type string, library string"), "type", "library").collect()] == ["l", "m", "x", "y"]
    c = spark.createDataFrame([([{"document": "a", "index": i} for i in range(3)],)], "c array<struct<document:string,index:int>>")
    near = lambda doc, i: [x["index"] for x in c.select(dataset.prune_near(F.col("c"), F.lit(doc), F.lit(i))).first()[0]]
    assert near("a", 0) == [2] and near("a", 1) == [0, 1, 2] and near("b", 0) == [0, 1, 2]
    same = [[x["index"] for x in c.select(dataset.shuffled(F.col("c"), F.lit(s))).first()[0]] for s in ("p", "p", "q", "r", "s", "t")]
    assert same[0] == same[1] and len(set(map(tuple, same))) > 1 and all(sorted(x) == [0, 1, 2] for x in same)
    one = spark.range(1).select(dataset.example_id(F.lit("single"), F.lit("lib"), F.lit("d" * 30), F.lit(4), F.lit(0))).first()[0]
    assert one == "single-lib-" + "d" * 24 + "-4-0"
    assert [e["type"] for e in streams.canned("x")] == ["start", "delta", "end"] and streams.canned("x")[1]["delta"] == "x"
    at = spark.createDataFrame([(dt.datetime(2026, 1, 2, 3, 4, 5, 678900),)], "t timestamp_ntz").select(text.iso(F.col("t").cast("timestamp"))).first()[0]
    assert at == "2026-01-02T03:04:05.678Z"


def test_windows_are_cut_in_one_pass(spark):
    texts = ["", " ", "a", "é" * 999, "ab " * 500, "🙂" * 2345, "x" * 1000, "y" * 1001, "z" * 1801]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    for size, overlap in ((1000, 200), (100, 70), (10, 0)):
        for r in d.select("t", chunking.windows(F.col("t"), size, overlap).alias("w"), chunking.window_count(F.col("t"), size, overlap).alias("n")).collect():
            if r["t"] is None:
                assert r["w"] is None
                continue
            flat = " ".join(r["t"].split())
            want = [flat[s : s + size] for s in range(0, max(1, len(flat) - overlap), size - overlap)]
            assert r["w"] == want and r["n"] == len(want)


STEMS = {
    "install": "instal", "installing": "instal", "installed": "instal", "installation": "instal", "consistency": "consist", "consolingly": "consol", "knitted": "knit", "knives": "knive", "generate": "generat", "generously": "generous",
    "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "dying": "die", "news": "news", "proceed": "proceed", "agreed": "agre", "luxuriated": "luxuri", "happy": "happi", "say": "say", "by": "by",
    "vietnamization": "vietnam", "relational": "relat", "analogi": "analog", "fluently": "fluentli", "hopefulness": "hope", "adoption": "adopt", "controller": "control", "roll": "roll", "communism": "communism", "communication": "communic", "bed": "bed",
    "shed": "shed", "yes": "yes", "boy's": "boy", "sitting": "sit", "university": "univers", "national": "nation", "rate": "rate", "formative": "format", "electrical": "electr", "callousness": "callous", "skies": "sky", "early": "earli",
}


def test_stems():
    assert {w: stem.stem(w) for w in STEMS} == STEMS


def test_full_text_finds_other_forms(spark):
    c = spark.createDataFrame([(1, "t", "Installing the heater takes an hour."), (2, "t", "The heater is heavy."), (3, "u", "install install"), (4, "t", "the of and")], "chunk_id int, tenant string, text string")
    q = spark.createDataFrame([(1, "t", "How do I install it?"), (2, "t", "the and of")], "query_id int, tenant string, text string")
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieve.full_text(q, c).collect()] == [(1, 1, 1)]
    assert retrieve.sparse(q, c).where("query_id = 1").count() == 0


def test_conversations(spark):
    c = spark.createDataFrame([(1, "u", None, 0, 5), (2, "u", "T", 0, 9), (3, "v", None, 0, 1)], "conv_id int, user_id string, title string, created_at int, updated_at int")
    new = spark.createDataFrame([(1, "u", "assistant", "hi", 10), (1, "u", "user", " ", 11), (1, "u", "user", "What is  this?", 12), (2, "u", "user", "no", 8), (3, "u", "user", "not mine", 20), (9, "u", "user", "nowhere", 20)], "conv_id int, user_id string, role string, text string, created_at int")
    after, messages, rejected = chat.append_messages(c, new.select("conv_id", "role", "text", "created_at").limit(0), new)
    assert {r["conv_id"]: (r["title"], r["updated_at"]) for r in after.collect()} == {1: ("What is this?", 12), 2: ("T", 9), 3: (None, 1)}
    assert messages.count() == 4 and sorted(r["conv_id"] for r in rejected.collect()) == [3, 9]
    asked = spark.createDataFrame([("u", 10, 1), ("u", 11, 2), ("w", 12, 3)], "user_id string, conv_id int, created_at int")
    made, no = chat.create_conversations(c, asked, 3)
    assert sorted(r["conv_id"] for r in made.collect()) == [1, 2, 3, 10, 12] and [(r["conv_id"], r["reason"]) for r in no.collect()] == [(11, "too_many_conversations")]
    visits = spark.createDataFrame([("u", 50), ("x", 60), ("x", 55)], "user_id string, at int")
    now, every = chat.get_or_create(c, visits)
    got = {r["user_id"]: r["conv_id"] for r in now.collect()}
    assert got["u"] == "2" and len(got["x"]) == 64 and every.where("user_id = 'x'").first()["created_at"] == 55 and every.count() == 4
    assert [r["conv_id"] for r in chat.listing(c, "updated_at", "conv_id").collect()] == [2, 1, 3]


def test_versions_swing_at_once(spark, tmp_path):
    docs = spark.createDataFrame([("u", "1", 1)], "user_id string, document_id string, order_key int")
    chunks = spark.createDataFrame([("1", 0)], "document_id string, i int")
    new = spark.createDataFrame([("u", "2", 2), ("u", "3", 3)], "user_id string, document_id string, order_key int")
    more = spark.createDataFrame([("2", 0), ("2", 1), ("3", 0)], "document_id string, i int")
    d, c, no = lifecycle.ingest(docs, chunks, new, more, 2)
    path = str(tmp_path / "t")
    assert lifecycle.publish(path, documents=docs, chunks=chunks) == "v000001"
    old = lifecycle.current(spark, path, "documents")
    assert lifecycle.publish(path, documents=d, chunks=c) == "v000002"
    assert sorted(r["document_id"] for r in lifecycle.current(spark, path, "documents").collect()) == ["1", "2"] and lifecycle.current(spark, path, "chunks").count() == 3
    assert old.count() == 1 and [r["document_id"] for r in no.collect()] == ["3"]


def test_counters_and_reports(spark, tmp_path):
    calls = spark.createDataFrame([("k", i, i, i == 3) for i in range(5)], "key string, call_id long, at_ms long, down boolean")
    got = {r["call_id"]: (r["ok"], r["remaining"]) for r in limits.open_rate_window(calls, 2, 1000, F.col("down")).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, None), 3: (True, 2), 4: (False, None)}
    v = "array<struct<valid: boolean>>"
    r = spark.createDataFrame([(None, [(True,), (False,)], 0, 5, 10), (None, [], 1, 7, 30), ("down", [], 0, None, None)], f"error string, verdicts {v}, malformed int, ttft_ms int, latency_ms int")
    assert tuple(evaluate.generation_counters(r).first()) == (2, 1, 1, 1, 1, 2, 1, 6.0, 20.0)
    assert evaluate.first_questions(spark.createDataFrame([(3,), (1,), (2,)], "query_id int"), 2).collect() == [(1,), (2,)]
    up = lambda dims: spark.range(1).select(limits.upload_problem(F.lit(5), F.lit("text/plain"), F.lit("text"), F.lit(1), F.lit(0), F.lit(dims))).first()[0]
    assert up(1536) is None and up(7) == "bad_dimensions"
    chunks = spark.createDataFrame([("l", "a.pdf", i, "Some words. " * 40) for i in range(3)] + [("m", "b.txt", 1, "short"), ("m", "b.txt", 0, "two")], "library string, document string, chunk_index int, text string")
    stats = quality.statistics(chunks, "library", "document").withColumn("verdict", quality.verdict())
    io.write_lines(quality.report_lines(stats), str(tmp_path / "r.md"))
    lines = (tmp_path / "r.md").read_text().split("\n")
    assert lines[0] == "# Corpus quality report" and "| l | 1 | 1 | 1 | 3 |" in lines and "Documents: **2** (1 PDFs, 50%), chunks: **5**, passing all heuristics: **1**" in lines
    assert lines[-2].startswith("- `b.txt` (m): ") and lines.index("## Per library") < lines.index("## Per document") < lines.index("## Flagged")
    assert {r["document"]: r["text"] for r in quality.document_text(chunks.where("library = 'm'")).collect()} == {"b.txt": "two short"}
    fetched = spark.createDataFrame([("x/a.pdf", 1 << 20, "ok"), ("x/b.txt", 5, "too small")], "path string, bytes long, status string")
    m = spark.createDataFrame([("a.pdf", "l"), ("b.txt", "l")], "filename string, library string")
    assert [tuple(r) for r in quality.fetch_summary(fetched, m).orderBy("library").collect()] == [(None, 1, 1, 1.0, 1), ("l", 1, 1, 1.0, 1)]
    for name in ("b.txt", "a.txt"):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / name).write_text("x")
    assert [r["name"] for r in io.files(spark, str(tmp_path / "f"), in_order=True).collect()] == ["a.txt", "b.txt"]


def test_the_user_turn_is_kept_before_its_reply(spark, tmp_path):
    spark.createDataFrame([(1, 1, "q", "a", 10), (1, 2, "r", "", 20)], "conv_id int, turn int, user_text string, reply string, at_ms long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id int, turn int, user_text string, reply string, at_ms long").parquet(str(tmp_path / "in"))
    streams.persist_turns(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("conv_id", "at_ms").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in got] == [(1, "user", "q"), (1, "assistant", "a"), (2, "user", "r")]
