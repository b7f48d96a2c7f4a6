"""Citations, prompts, repairs and the dataset's filters."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from gristmill.functions import repair
from gristmill.operators import citations, dataset, evaluate, prompts

TEXT = "The Battery  lasts 14 hours in normal use, and charging it takes about ninety minutes with the supplied adapter."
SOURCES = [{"name": "Guide.txt", "content": TEXT}, {"name": "Other Notes.md", "content": "Nothing “much” is here — only notes that fill the space of a page."}]
SRC = "array<struct<name:string,content:string>>"


def test_verify(spark):
    reply = 'Yes.\n> **Guide.txt** — Battery lasts 14 hours\n> **Guide.txt** — "in normal use"\n> **No.txt** — x\n> wrong\n> **Guide.txt** — ' + "y" * 201
    d = spark.createDataFrame([(1, reply, SOURCES), (2, None, SOURCES), (3, "none", [])], f"id int, reply string, sources {SRC}")
    rows = citations.rows(citations.verify(d), "id").orderBy("position").collect()
    assert [(r["known"], r["verbatim"], r["verbatim_strict"], r["within_length"], r["valid"]) for r in rows] == [(True, True, True, True, True), (True, True, False, True, True), (False, False, False, True, False), (True, False, False, False, False)]
    assert {r["id"]: r["malformed"] for r in citations.verify(d).collect()} == {1: 1, 2: 0, 3: 0}
    m = evaluate.citation_metrics(citations.verify(d)).first()
    assert (m["replies"], m["citations"], m["precision_lenient"], m["precision_strict"], m["replies_without_citation"]) == (3, 4, 0.5, 0.25, 2)
    assert math.isnan(evaluate.citation_metrics(citations.verify(d.where("id = 3"))).first()["precision_lenient"])


def test_prompts(spark, tmp_path):
    d = spark.createDataFrame([(SOURCES, "Q?"), ([], "Q?")], f"sources {SRC}, q string")
    full, none = (r[0] for r in d.select(prompts.prompt(F.col("q"), F.col("sources"))).collect())
    assert full == f"Sources:\n\n[1] Guide.txt\n{' '.join(TEXT.split())}\n\n---\n\n[2] Other Notes.md\n{SOURCES[1]['content']}\n\nQuestion: Q?\n\nAnswer:"
    assert none.startswith("Sources: (none") and none.endswith("\n\nQuestion: Q?\n\nAnswer:")
    c = prompts.Contract()
    sha = c.dump(str(tmp_path / "c.json"))
    assert prompts.Contract.load(str(tmp_path / "c.json")).system_prompt == c.system_prompt
    raw = json.loads((tmp_path / "c.json").read_text())
    assert raw["sha256"] == sha
    (tmp_path / "c.json").write_text(json.dumps(raw | {"systemPrompt": "changed"}))
    with pytest.raises(ValueError, match="digest"):
        prompts.Contract.load(str(tmp_path / "c.json"))
    turns = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "c"}]
    t = spark.createDataFrame([(turns,)], "t array<struct<role:string,content:string>>")
    assert [x["content"] for x in t.select(prompts.replace_last_turn(F.col("t"), F.lit("new"))).first()[0]] == ["a", "b", "new"]
    m = d.select(prompts.messages(c, F.col("q"), F.col("sources")).alias("m"), prompts.short_circuit(F.col("sources"), F.lit(1), c).alias("s")).collect()
    assert [x["role"] for x in m[0]["m"]] == ["system", "user"] and m[0]["s"] is None and m[1]["s"] == c.no_sources_reply


@pytest.mark.parametrize(
    ("line", "kinds", "want"),
    [
        ("> **guide.TXT** — lasts 14 hours", ["document_name_case"], "> **Guide.txt** — lasts 14 hours"),
        ("> **Other Notes** — only notes", ["document_name_partial"], "> **Other Notes.md** — only notes"),
        ("> **Othr Notes.md** — only notes", ["document_name_fuzzy"], "> **Other Notes.md** — only notes"),
        ("  > **Guide.txt** — lasts 14 hours", ["citation_dedented"], "> **Guide.txt** — lasts 14 hours"),
        ("> **Guide.txt** — “lasts 14 hours”", ["quote_unwrapped"], "> **Guide.txt** — lasts 14 hours"),
        ("> **Guide.txt** — ...lasts 14 hours...", ["quote_trimmed"], "> **Guide.txt** — lasts 14 hours"),
        ("> **Other Notes.md** — nothing 'much' is here - only", ["quote_normalized"], "> **Other Notes.md** — Nothing “much” is here — only"),
        ("> **Guide.txt** — The Battery lasts 14 hours ... with the supplied adapter", ["quote_segment"], "> **Guide.txt** — The Battery lasts 14 hours"),
        ("> **Guide.txt** — charging it takes about ninety minuts with the supplied adapter", ["quote_fuzzy"], "> **Guide.txt** — charging it takes about ninety minutes with the supplied adapter."),
        ("> **Guide.txt** — lasts 14 hours", [], "> **Guide.txt** — lasts 14 hours"),
        ("> **Unknown.pdf** — lasts 14 hours", [], "> **Unknown.pdf** — lasts 14 hours"),
        ("> **Guide.txt** — something that was never written anywhere", [], "> **Guide.txt** — something that was never written anywhere"),
    ],
)
def test_repairs(line, kinds, want):
    got, done = repair.repair_reply("It does.\n" + line, SOURCES)
    assert [d["kind"] for d in done] == kinds and got == "It does.\n" + want


def test_shorten():
    text = " ".join(f"word{i}" for i in range(60))
    got, done = repair.repair_reply(f"About word40.\n> **A** — {text}", [{"name": "A", "content": text}])
    short = got.split(" — ")[1]
    assert [d["kind"] for d in done] == ["quote_shortened"] and short in text and len(short) <= 200 and "word40" in short


def example(i, target, **more):
    base = {"example_id": i, "library": "lib", "question": f"Q {i}?", "type": "single", "answerable": True, "target": target, "sources": SOURCES, "gold": [{"document": "Guide.txt", "index": 0, "text": TEXT}], "covers": None, "acknowledges": None}
    return base | more


@pytest.fixture(scope="module")
def examples(spark):
    good = "Yes.\n> **Guide.txt** — lasts 14 hours"
    ready = prompts.Contract().abstention()
    rows = [
        example(1, good),
        example(2, " \n"),
        example(3, "x" * 9900),
        example(4, good + "\n> broken"),
        example(5, "No citation."),
        example(6, "Yes.\n> **X.txt** — lasts 14 hours\n> **Guide.txt** — never said"),
        example(7, "Yes.\n> **Guide.txt** — never said\n> **X.txt** — lasts 14 hours"),
        example(8, "Yes.\n> **Long.txt** — " + "z " * 120, sources=[{"name": "Long.txt", "content": "z " * 300}], gold=[]),
        example(9, "Yes.\n> **Other Notes.md** — only notes"),
        example(10, good, type="partial", covers=False),
        example(11, good, type="partial"),
        example(12, good, type="partial", acknowledges=True),
        example(13, good, type="negative", answerable=False),
        example(14, "I'd rather not.", type="negative", answerable=False),
        example(15, ready + " More.", type="negative", answerable=False),
    ]
    schema = f"example_id int, library string, question string, type string, answerable boolean, target string, sources {SRC}, gold array<struct<document:string,index:int,text:string>>, covers boolean, acknowledges boolean"
    return spark.createDataFrame(rows, schema)


def test_filter_reasons(examples):
    got = {r["example_id"]: r["reason"] for r in dataset.check(examples).collect()}
    assert got == {
        1: None, 2: "empty_target", 3: "too_long", 4: "malformed_citation_line", 5: "no_citation", 6: "unknown_document_name", 7: "quote_not_verbatim", 8: "quote_too_long", 9: "gold_not_cited",
        10: "partial_covered_part_missing", 11: "partial_uncovered_not_acknowledged", 12: None, 13: "abstention_has_citation", 14: "abstention_not_canonical", 15: None,
    }
    stats = {(r["reason"], r["type"]): r["n"] for r in dataset.filter_stats(dataset.check(examples)).collect()}
    assert stats["kept", None] == 3 and stats["kept", "negative"] == 1 and stats["no_citation", "single"] == 1
    row = dataset.stats_report(dataset.check(examples)).first()
    assert (row["candidates"], row["kept"], row["kept_rate"]) == (15, 3, 0.2) and json.loads(row["rejected"])["too_long"] == 1


def test_repair_frame(examples):
    got = {r["example_id"]: r for r in repair.repair(examples.where("example_id in (1, 13)")).collect()}
    assert got[1]["repairs"] == [] and got[13]["target"] == example(13, "Yes.\n> **Guide.txt** — lasts 14 hours")["target"]


def test_dedupe(spark):
    rows = [(i, "lib", q, True) for i, q in enumerate(["How long does the battery last in use?", "how LONG does the battery last in use", "How long does the battery last in normal use?", "What else?", "what else"])] + [(9, "other", "What else?", True)]
    d = spark.createDataFrame(rows, "example_id int, library string, question string, answerable boolean")
    kept = dataset.dedupe(d)
    assert sorted(r["example_id"] for r in kept.collect()) == [0, 3, 9]
    assert dataset.dedupe(kept).count() == 3


def test_sampling_and_pairs(spark):
    long = "alpha beta gamma " * 30
    rows = [(lib, f"{lib}-{d}", i, long) for lib in "ab" for d in range(2) for i in range(3)] + [("a", "a-0", 9, "123 " * 200)]
    c = spark.createDataFrame(rows, "library string, document string, chunk_index int, text string")
    got = dataset.sample_gold(c, 6).orderBy("place").collect()
    assert [r["document"] for r in got] == ["a-0", "a-1", "b-0", "b-1", "a-0", "a-1"] and all(r["text"] == long for r in got)
    golds = spark.createDataFrame([("x", "a", "a-0", 0), ("y", "c", "c-0", 0)], "example_id string, library string, document string, chunk_index int")
    more = c.unionByName(spark.createDataFrame([("c", "c-0", i, long) for i in range(3)], c.schema))
    p = {r["example_id"]: (r["partner"], r["partner_index"]) for r in dataset.partners(golds, more).collect()}
    assert p["x"][0] == "a-1" and p["y"] == ("c-0", 2)
    yields = spark.createDataFrame([(i + 1, n) for i, n in enumerate([2, 0, 1, 2, 1, 1])], "place int, yielded int")
    assert [sorted(r["place"] for r in dataset.quota(yields, n).collect()) for n in (0, 1, 3, 4, 99)] == [[], [1], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5, 6]]
    kept = spark.createDataFrame([("a", f"d{i % 3}", i) for i in range(30)] + [("b", "x", 90)], "library string, document string, example_id int")
    unused = spark.createDataFrame([("a", f"d{i % 3}", 100 + i) for i in range(30)] + [("b", "x", 190), ("c", "x", 191)], "library string, document string, gold_id int")
    pairs = dataset.pair_turns(kept, unused).collect()
    doc = {r["gold_id"]: r["document"] for r in unused.collect()} | {r["example_id"]: r["document"] for r in kept.collect()}
    assert len(pairs) == 31 and len({r["gold_id"] for r in pairs}) == 31
    assert [r["example_id"] for r in pairs if doc[r["example_id"]] == doc[r["gold_id"]]] == [90]


def test_splits(spark):
    d = spark.createDataFrame([("health-guides", "x"), ("rust-book", "x"), ("z", "y")], "library string, document string")
    got = {r["split"]: r["n"] for r in dataset.split_report(d).collect()}
    assert got == {"test": 1, "validation": 1, "train": 1}
    assert [r["document"] for r in dataset.leaks(d.withColumn("split", dataset.split_name(F.col("library")))).collect()] == ["x"]


def test_dedupe_looks_at_few_questions_and_misses_none():
    """Words that all questions share lead nowhere, and the fold equals one that compares with every kept question."""
    kept = dataset.Kept(0.8)
    assert all(kept.add("what about " + " ".join(f"w{i * 7 + j}" for j in range(7))) for i in range(2000))
    assert max(map(len, kept.index.values())) < 20
    import random

    r = random.Random(3)
    for threshold in (0.5, 0.8, 1.0):
        asked = [" ".join(f"w{min(r.randrange(12), r.randrange(40))}" for _ in range(r.randrange(9))) for _ in range(600)]
        before, want = [], []
        for q in asked:
            w = set(q.split())
            alike = any(q == p or (w & v and len(w & v) >= threshold * (len(w) + len(v) - len(w & v))) for p, v in before)
            want.append(not alike)
            if not alike:
                before.append((q, w))
        fold = dataset.Kept(threshold)
        assert [fold.add(q) for q in asked] == want


def test_citations_collapse_without_touching_single_blanks(spark, sf):
    """Every text is collapsed by the pattern that leaves single blanks and plain characters alone."""
    from gristmill.plans import queries

    plan = queries.citation_verify(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert " (?![!-~])[" in plan
