"""Chat, admission, streams, lifecycle, sources, and the driver's entry."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.operators import chat, lifecycle, limits, quality
from gristmill.plans import models, queries
from gristmill.sources import io
from gristmill.streaming import events as streams
from gristmill.streaming import limits as stream_limits

REPO = Path(__file__).resolve().parents[1]


def test_clean_wire(spark):
    part = lambda *t: [{"type": "text", "text": x} for x in t]
    payload = [
        {"id": "1", "role": "user", "parts": part("a", "b")},
        {"role": "system", "parts": part("no")},
        {"id": "2", "role": "assistant", "parts": "no list"},
        7,
        None,
        {"role": "assistant", "parts": [{"type": "image"}, *part("c")]},
        {"id": "3", "role": "user", "parts": part(" \n")},
    ]
    d = spark.createDataFrame([(json.dumps(payload),), (None,), ("no json",)], "p string")
    got = [[tuple(m) for m in r[0]] for r in d.select(chat.clean_wire(F.col("p"))).collect()]
    assert got == [[("1", "user", "ab"), ("sanitized-1", "assistant", "c")], [], []]


def test_history(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x" * 100) for t in range(10)] + [(1, 10, "tool", "y"), (2, 0, "user", "z" * 900), (3, 0, "user", "  ")]
    m = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = lambda *a: sorted((r["conv_id"], r["turn"]) for r in chat.window(m, *a).collect())
    assert got(3) == [(1, 7), (1, 8), (1, 9), (2, 0)]
    assert got(40, 450) == [(1, 6), (1, 7), (1, 8), (1, 9), (2, 0)]
    assert {r["conv_id"]: r["turn"] for r in chat.latest_user_turn(m).collect()} == {1: 8, 2: 0, 3: 0}
    assert {r["conv_id"] for r in chat.titles(m).collect()} == {1, 2}


CALLS = [("a", 1, 0), ("a", 2, 10), ("a", 3, 999), ("a", 4, 1000), ("b", 5, 5), ("a", 6, 1500), ("a", 7, 1600)]
VERDICTS = {1: (True, 1, None), 2: (True, 0, None), 3: (False, None, 1), 4: (True, 1, None), 5: (True, 1, None), 6: (True, 0, None), 7: (False, None, 1)}


def test_rate_window(spark):
    calls = spark.createDataFrame(CALLS, "key string, call_id long, at_ms long")
    got = {r["call_id"]: (r["ok"], r["remaining"], r["retry_after"]) for r in limits.rate_window(calls, 2, 1000).collect()}
    assert got == VERDICTS
    assert {r["call_id"]: r["ok"] for r in limits.rate_window(calls, 2, 1000, True).collect()} == {k: v[0] for k, v in VERDICTS.items()}
    day = [("k", i, i * 61_000) for i in range(4)] + [("k", 9, 100)]
    tiers = {r["call_id"]: r["rejected_by"] for r in limits.two_tiers(spark.createDataFrame(day, "key string, call_id long, at_ms long"), 1, 3).collect()}
    assert tiers == {0: None, 9: "minute", 1: None, 2: None, 3: "day"}


def test_rate_window_as_a_stream(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame(CALLS[n * 3 : n * 3 + 4][: 3 if n == 0 else 4], "key string, call_id long, at_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, call_id long, at_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_limits.rate_window(stream, 2, 1000).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = {r["call_id"]: (r["ok"], r["remaining"], r["retry_after"]) for r in spark.table("calls").collect()}
    assert got == VERDICTS


def test_streams_land_once(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    assert streams.sessions(e).agg(F.sum("n")).first()[0] == e.count()
    assert [x["type"] for x in streams.canned("t")] == ["start", "delta", "end"]


def test_lifecycle(spark):
    d = spark.createDataFrame([("u", "1"), ("u", "2"), ("v", "3")], "user_id string, document_id string")
    c = spark.createDataFrame([("1", 0), ("1", 1), ("3", 0)], "document_id string, i int")
    doomed = spark.createDataFrame([("u", "1"), ("u", "3")], "user_id string, document_id string")
    parents, children, affected = lifecycle.delete_cascade(d, c, doomed)
    assert sorted(r["document_id"] for r in parents.collect()) == ["2", "3"] and [r["document_id"] for r in children.collect()] == ["3"]
    assert {r["document_id"]: r["affected"] for r in affected.collect()} == {"1": 1, "3": 0}
    assert {r["document_id"]: r["n_chunks"] for r in lifecycle.counts(d, c).collect()} == {"1": 2, "2": 0, "3": 1}
    new = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "user_id string, order_key int")
    assert sorted(r["order_key"] for r in lifecycle.within_quota(d, new, 3).collect()) == [1, 3]
    cache = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, seq int, value string")
    hit, miss = lifecycle.cache_lookup(spark.createDataFrame([("k",), ("m",)], "key string"), cache)
    assert hit.first()["value"] == "new" and miss.first()["key"] == "m"
    users = spark.createDataFrame([("1", "x1", "a@x"), ("2", "x2", "b@x")], "user_id string, external_id string, email string")
    logins = spark.createDataFrame([("x1", "new@x", True), ("y1", "a@x", True), ("y2", "b@x", False), ("y3", None, False)], "external_id string, email string, verified boolean")
    got = {r["external_id"]: r["email"] for r in lifecycle.upsert_users(users, logins).collect()}
    assert got == {"y1": "a@x", "x2": "b@x", "y2": "y2@unknown.local", "y3": "y3@unknown.local"}


def test_files_to_chunks(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("Hello there.\nAgain.")
    (folder / "sub" / "a.txt").write_text("the same name")
    (folder / "b.md").write_text(" \n")
    (folder / "c.exe").write_bytes(b"x")
    (folder / "d.txt").write_bytes(b"")
    (folder / "e.pdf").write_bytes(b"%PDF text")
    rows, left = io.export_chunks(io.extract(io.files(spark, str(folder), empty=True), lambda raw: raw.decode()[5:]))
    assert sorted((r["documentName"], r["chunkIndex"], r["chunkCount"], r["normalized"]) for r in rows.collect()) == [("a.txt", 0, 1, "Hello there. Again."), ("e.pdf", 0, 1, "text")]
    assert {r["name"]: r["reason"] for r in left.collect()} == {"a.txt": "duplicate_name", "b.md": "no_text", "c.exe": "unsupported_type", "d.txt": "empty"}


def test_json_and_reports(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "é?", "expectedSubstrings": ["x"]}\n\n{"id": "2"}\n')
    d = io.json_lines(spark, str(tmp_path / "q.jsonl"), io.QUESTIONS)
    assert d.count() == 2 and io.without(d, ["2"]).first()["question"] == "é?"
    with pytest.raises(Exception, match="a row has no question"):
        io.json_lines(spark, str(tmp_path / "q.jsonl"), io.QUESTIONS, ("question",)).collect()
    io.write_json_lines(d, str(tmp_path / "out"), "id")
    assert "é?" in next((tmp_path / "out" / "id=1").glob("*.json")).read_text()
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"id": "i", "library": "l", "filename": "f.txt", "title": "T"}]}))
    m = io.manifest(spark, str(tmp_path / "m.json"))
    chunks = spark.createDataFrame([("f-part1of2.txt",), ("g.txt",)], "document string")
    assert {r["document"]: (r["library"], r["title"]) for r in quality.with_manifest(chunks, m).collect()} == {"f-part1of2.txt": ("l", "T"), "g.txt": ("?", "g.txt")}
    with pytest.raises(Exception, match="not in the manifest: g.txt"):
        quality.strict_manifest(chunks, m).collect()
    wiki = json.dumps({"query": {"pages": {"5": {"title": "T", "extract": "Body"}}}})
    ev = lambda c: spark.range(1).select(c).first()[0]
    assert ev(io.wiki_page(F.lit(wiki))) == "T\n\nBody" and ev(io.wiki_page(F.lit("{}"))) is None
    assert ev(io.tolerant_json(F.lit('Sure: {"a": 1} ok'), "a int"))["a"] == 1 and ev(io.tolerant_json(F.lit("no"), "a int"))["a"] is None
    v = spark.createDataFrame([("t", [1.0, 2.0])], "tenant string, embedding array<float>")
    io.append_vectors(v, str(tmp_path / "v"), 2)
    with pytest.raises(Exception, match="a vector has 2 numbers"):
        io.append_vectors(v, str(tmp_path / "v"), 3)
    io.write_report(v.select("tenant"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"tenant": "t"}


def test_split_into(spark):
    text = "\n\n".join(f"paragraph {i} " + "x" * 50 for i in range(9))
    d = spark.createDataFrame([(text,), ("y" * 100,)], "t string")
    a, b = (r[0] for r in d.select(quality.split_into(F.col("t"), 3)).collect())
    assert len(a) == 3 and "\n\n".join(a) == text and b == ["y" * 34, "y" * 34, "y" * 32]


def test_models(spark):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, text string")
    e = models.embed(d, lambda xs: [[float(len(x))] for x in xs], batch=2)
    assert sorted((r["id"], r["embedding"]) for r in e.collect()) == [(i, [2.0]) for i in range(5)]

    def fails_on_three(prompts):
        if prompts[0] == "t3":
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    g = {r["id"]: (r["reply"], r["error"]) for r in models.generate(d, fails_on_three, "text").collect()}
    assert g[0] == ("T0", None) and g[3] == (None, "RuntimeError: down")
    assert models.Settings.from_env({"CHAT_HISTORY_CHARS": "999999"}).history_chars == 64_000
    for bad in ({"CHAT_PROVIDER": "nope"}, {"CHAT_PROVIDER": "compatible"}):
        with pytest.raises(ValueError):
            models.Settings.from_env(bad)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    same = lambda v: str(v)[:19] if hasattr(v, "isoformat") else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    assert sorted(repr([same(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([same(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    d = entry.entry(spark)
    assert d.columns == ["query_id", "prompt"] and d.count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_upload_admission_counts_the_chunks(spark, tmp_path):
    """Prose of about 450,000 characters has more than 500 chunks."""
    from gristmill.plans import queries

    many, few = "some words of prose. " * 21_500, "some words of prose. " * 1_000
    spark.createDataFrame([(1, many), (2, few)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["reason"] for r in queries.upload_admission(spark, str(tmp_path)).collect()}
    assert len(many) < 500_000 and got == {1: "too_many_chunks", 2: None}


def test_short_quotes_dont_cite_a_gold_that_is_elsewhere(spark, tmp_path):
    """A quote of one word may stand in any passage; SQL decides by the document's number."""
    import duckdb

    rows = [(252, "some words passage", "en", "src1"), (343, "some words sources", "en", "src2"), (253, "some words passage", "en", "src1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("filter_chain", "filter_stats", "kept_by_field"):
        want = con.execute(queries.SQL[name])
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())
        if name == "filter_chain":
            assert {r["example_id"]: r["reason"] for r in got.collect()}[252] == "gold_not_cited"
