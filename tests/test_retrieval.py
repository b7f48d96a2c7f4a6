"""Ranking, fusion and retrieval metrics."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evaluate, retrieve


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "u", "red fox jumps", [1.0, 0.0]), (2, "u", "blue fox fox", [0.0, 1.0]), (3, "u", "green hen", [0.6, 0.8]), (4, "v", "red fox", [1.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id int, tenant string, text string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(10, "u", "fox fox", [1.0, 0.1], ["blue"]), (11, "u", "  ", [1.0, 0.0], ["x"]), (12, "w", "fox", [1.0, 0.0], ["x"])]
    return spark.createDataFrame(rows, "query_id int, tenant string, text string, embedding array<float>, expected array<string>")


def ids(df):
    return [(r["query_id"], r["chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_dense(queries, chunks):
    assert ids(retrieve.dense(queries, chunks, 2)) == [(10, 1), (10, 3)]
    assert retrieve.dense(queries, chunks, 0).count() == 0
    sim = retrieve.dense(queries, chunks, 1).first()["similarity"]
    assert sim == pytest.approx(1 / math.sqrt(1.01), abs=1e-6)


def test_sparse(queries, chunks):
    assert ids(retrieve.sparse(queries, chunks)) == [(10, 2), (10, 1)]


def test_bm25_fills_up_with_zero_scores(queries, chunks):
    got = retrieve.bm25(queries, chunks, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1, 3] and got[2]["score"] == 0
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    mean = (3 + 3 + 2) / 3
    assert got[0]["score"] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean)))


def test_fusion_keeps_first_order_on_ties(spark):
    ranked = lambda xs: spark.createDataFrame([(1, c, i + 1, 0.5) for i, c in enumerate(xs)], "query_id int, chunk_id string, rank int, similarity double")
    got = retrieve.fuse(ranked("xyz"), ranked("ywx")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["y", "x", "w", "z"]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and [r["similarity"] for r in got] == [0.5, 0.5, 0.0, 0.5]
    tied = retrieve.fuse(ranked("ab"), ranked("ba")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tied] == ["a", "b"]


def test_neighbours_and_gold(spark):
    c = spark.createDataFrame([("d", i) for i in range(4)] + [("e", 0)], "document string, chunk_index int")
    assert sorted(map(tuple, retrieve.neighbours(c).where("chunk_index = 1").collect())) == [("d", 1, 0), ("d", 1, 2)]
    gold = spark.createDataFrame([("x", "d", 1)], "example_id string, document string, chunk_index int")
    assert [r["chunk_index"] for r in retrieve.without_gold(c, gold).collect()] == [3]
    assert sorted(r["chunk_index"] for r in retrieve.without_gold(c, gold, False).collect()) == [0, 2, 3]


def test_metrics(queries, chunks, spark):
    both = evaluate.run("dense", retrieve.dense, queries, chunks).unionByName(evaluate.run("hybrid", retrieve.hybrid, queries, chunks))
    got = {r["strategy"]: r for r in evaluate.summary(both, "strategy").collect()}
    assert got["dense"]["n"] == 3 and got["dense"]["hit_at_k"] == pytest.approx(1 / 3) and got["dense"]["mrr"] == pytest.approx(1 / 9)
    table = {r["query_id"]: (r["dense"], r["hybrid"]) for r in evaluate.compare(both, ["dense", "hybrid"]).collect()}
    assert table[11] == ("miss", "miss") and table[10][0] == "#3"
    report = evaluate.markdown(evaluate.summary(both, "strategy")).first()["report"]
    assert report.startswith("| strategy |") and "| dense | 3 | 0.333 | 0.111 |" in report
    none = evaluate.summary(both.limit(0)).first()
    assert (none["n"], none["hit_at_k"], none["mrr"], none["mean_top_similarity"]) == (0, 0, 0, 0)


def test_dense_plan_reads_only_what_it_ranks(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("tenant"), "embedding")
    plan = retrieve.dense(e.withColumnRenamed("chunk_id", "query_id"), e)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_blocks_meet_every_pair_once(spark, monkeypatch):
    """Rankings by small blocks equal a brute force, with repeated vectors and texts, zero vectors and ids of any type."""
    import random

    from gristmill.operators import blocks

    r = random.Random(1)
    vectors = [[float(r.randrange(-2, 3)) for _ in range(4)] for _ in range(30)] + [[0.0] * 4, [1.0, 2.0, 0.0, 1.0], [2.0, 4.0, 0.0, 2.0]]
    texts = [" ".join(r.choice(["fox", "hen", "red", "blue", "owl", "cat"]) for _ in range(r.randrange(1, 7))) for _ in vectors]
    rows = [((f"d{i % 7}", i), "u" if i % 3 else "v", texts[i], v) for i, v in enumerate(vectors)]
    c = spark.createDataFrame(rows, "chunk_id struct<document: string, chunk_index: int>, tenant string, text string, embedding array<float>")
    asked = [(i, "u" if i % 2 else "v", texts[i], vectors[-1 - i]) for i in range(9)]
    q = spark.createDataFrame(asked, "query_id int, tenant string, text string, embedding array<float>")
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(blocks, "SCORES", 8)

    def cosine(a, b):
        na, nb = sum(x * x for x in a), sum(x * x for x in b)
        return math.inf if not na or not nb else max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)) / math.sqrt(na * nb)))

    def matching(a, b):
        wanted = set(a.split())
        return round(sum(w in wanted for w in b.split()) / math.log(len(b.split()) + 1), 9)

    for ranked, value, at in ((retrieve.dense, cosine, 3), (retrieve.sparse, matching, 2)):
        want = []
        for x in asked:
            scored = sorted((-value(x[at], y[at]), y[0]) for y in rows if y[1] == x[1])
            want += [(x[0], y) for s, y in scored if at == 3 or s < 0][:5]
        got = [(x["query_id"], tuple(x["chunk_id"])) for x in ranked(q, c, 5).orderBy("query_id", "rank").collect()]
        assert got == want


def test_pairs_of_a_tenant_are_no_rows(spark, sf):
    """Neither pairs nor postings are joined row by row: their number grows with the square of a tenant."""
    from gristmill.plans import queries

    for name in ("dense_topk", "sparse_topk", "full_text_topk"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "term#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_counted_terms(spark):
    from gristmill.functions import terms

    d = spark.createDataFrame([(1, "The fox, the FOX's fox a"), (2, None), (3, "the"), (4, "red fox red")], "id int, text string")
    got = {r["id"]: (r["length"], dict(zip(r["terms"], r["tfs"]))) for r in terms.counted(d, terms.raw_words(F.col("text"))).collect()}
    assert got == {1: (3, {"fox": 2, "fox's": 1}), 2: (None, {}), 3: (0, {}), 4: (3, {"red": 2, "fox": 1})}
    some = terms.counted(d, terms.raw_words(F.col("text")), wanted=["red"], exploded=True).collect()
    assert [tuple(r) for r in some] == [(4, 3, "red", 2)]


def test_bm25_ranks_its_hits_once(spark, sf):
    """Filling up with zero scores doesn't join the hits a second time."""
    from gristmill.plans import queries

    plan = queries.bm25_topk(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("qtf#" in line for line in plan.splitlines() if "Aggregate [query_id" in line) == 1
