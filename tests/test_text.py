"""Text functions and chunking on hand-made rows: white space, marks, boundaries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import chunking, repair, text


@pytest.fixture(scope="module")
def ev(spark):
    """Evaluates a function of columns on values."""

    def run(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]

    return run


def test_white_space(ev):
    s = "  a \n b﻿　c  "
    assert ev(text.collapse, s) == "a b c"
    assert ev(lambda c: text.collapse(c, text.PY_SPACE), "\x1c a\x85﻿b ") == "a ﻿b"
    assert ev(lambda c: text.collapse(c, text.PY_SPACE), s) == " ".join(s.split())
    assert ev(text.blank, "  \n") is True and ev(text.blank, None) is True and ev(text.blank, "x") is False
    assert ev(text.trim, "﻿\n a b \t") == "a b"


def test_or_query(ev):
    assert ev(text.or_query, "'; DROP TABLE \"Chunk\"; -- price | & !") == "drop | table | chunk | price"
    assert ev(text.or_query, "AN13-A1 c++ --flag a b the the") == "an13-a1 | flag | the | the"
    assert ev(text.or_query, "?! .") == ""


def test_tokens(ev):
    assert ev(text.tokens, "The cat's 3 lives: don't re-run A b IT 42") == ["cat's", "lives", "don't", "re", "run", "42"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("> **A.txt** — a quote", ("A.txt", "a quote")),
        ("> **A — B** — c** — d", ("A — B", "c** — d")),
        ("> **A** — q\r", ("A", "q")),
        ("> **A** - q", None),
        (" > **A** — q", None),
        (">**A** — q", None),
        ("> **A** — ", None),
        ("> ** — q", None),
        ("> A — q", None),
    ],
)
def test_citation_line(ev, line, want):
    got = ev(text.citation, line)
    assert (got and tuple(got)) == want


def test_wrapping(ev):
    for s, want in (('"abc"', "abc"), ("“ a ”", "a"), ('""', '""'), ("'a\"", "'a\""), ('""a""', '"a"'), ("„x“", "x"), ("«y»", "y")):
        assert ev(text.strip_wrapping, s) == want


def test_titles(ev):
    assert ev(text.title, "x" * 60) == "x" * 60
    assert ev(text.title, "x" * 61) == "x" * 59 + "…"
    assert ev(text.title, " a\n b ") == "a b"
    assert ev(text.title, "y" * 58 + " z" * 9) == "y" * 58 + "…"


def test_names(ev):
    assert ev(text.whole_file, "a-b-part2of10.txt") == "a-b.txt" and ev(text.whole_file, "part1.txt") == "part1.txt"
    shown = lambda n, s: ev(text.display_name, n, "Book", s)
    assert shown("b-part2of3.txt", "title") == "Book (part 2 of 3)" and shown("b.txt", "title") == "Book" and shown("b-part2of3.txt", "filename") == "b-part2of3.txt"
    assert ev(text.bare_name, "Straße No. 5") == "strasseno5"
    assert ev(text.extension_type, "A.PDF") == "application/pdf" and ev(text.extension_type, "x.exe") == "application/octet-stream"


def test_loose(ev):
    assert ev(text.find_loose, "He said “Yes” — twice", "SAID 'yes' - TWICE") == "said “Yes” — twice"
    assert ev(text.find_loose, "abc", "") is None and ev(text.find_loose, "abc", "d") is None


def test_small_functions(ev):
    assert ev(text.jaccard, ["a", "b"], ["b", "c"]) == pytest.approx(1 / 3) and ev(text.jaccard, [], []) == 0
    assert ev(text.plain_question, "What's NEW, in 2.0?") == "what s new in 2 0"
    assert ev(text.hint_words, "The the fox_es ran up") == ["the", "fox", "ran"]
    assert [ev(text.line_kind, x) for x in ("> q", "- b", " ", "text")] == ["citation", "bullet", "blank", "paragraph"]
    assert ev(text.bold_parts, "a **b** c **d**") == ["**b**", "**d**"]
    assert ev(text.role, "user") == "user" and ev(text.role, "tool") == "assistant"
    assert ev(text.preview, "a " * 200) == ("a " * 60)[:120]
    assert ev(text.letter_share, "") == 0 and ev(text.letter_share, "aé1 ") == 0.5
    assert ev(text.compose_questions, "How?", "What now?") == "How? Also, what now?"
    assert ev(text.contains_any, "The  Big\ncat", ["dog", "big CAT"]) is True


def test_choices_are_spread(spark):
    d = spark.range(4000)
    share = d.agg(F.avg((text.name_style(F.col("id")) == "title").cast("double")), F.avg((text.context_size(F.col("id")) < 5).cast("double"))).first()
    assert abs(share[0] - 0.3) < 0.03 and abs(share[1] - 0.1) < 0.02


def split_by_hand(t, size, seps):
    if not t:
        return []
    if len(t) <= size:
        return [t]
    if not seps:
        return [t[i : i + size] for i in range(0, len(t), size)]
    return [x for p in t.split(seps[0]) if p for x in split_by_hand(p, size, seps[1:])]


def chunks_by_hand(t, size, overlap):
    out, now = [], ""
    for p in split_by_hand(t, size, chunking.SEPARATORS):
        if len(now) + bool(now) + len(p) <= size:
            now = f"{now} {p}" if now else p
            continue
        if now:
            out.append(now)
        room = max(0, min(overlap, size - 1 - len(p), len(now)))
        now = f"{now[-room:]} {p}" if room else p
    return out + [now] if now else out


def test_chunks_as_by_hand(spark):
    r = random.Random(0)
    texts = ["", "short\n\ntext", "x" * 500, "a. b. " * 40, "word " * 100, "😀" * 130]
    for _ in range(150):
        texts.append("".join(r.choice(["word", "longerword", " ", "\n", "\n\n", ". ", "😀é", "x" * 45]) for _ in range(r.randint(0, 60))))
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["c"] for x in d.select("i", chunking.chunks(F.col("t"), 40, 10).alias("c")).collect()}
    assert got == {i: chunks_by_hand(t, 40, 10) for i, t in enumerate(texts)}
    assert all(len(c) <= 40 for cs in got.values() for c in cs)
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunks(F.col("t"), 10, 10)


def test_windows(spark):
    texts = ["", "a", "x y " * 700]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["c"] for x in d.select("i", chunking.windows(F.col("t")).alias("c")).collect()}
    flat = " ".join(texts[2].split())
    assert got[0] == [""] and got[1] == ["a"] and got[2] == [flat[s : s + 1000] for s in range(0, len(flat) - 200, 800)]


ODD = ["", " ", "a", " a  b\t\tc \n", "x\u00a0\u2003y\ufeff z\x85w\x1c\x1d q", "\u3000\ufeff", "tail \x1f", "one. two\r\nthree\x0bfour\u2028five ²½ Ⅷ é_9 \ufffd", "long " * 900, "z" * 2500, "🙂 " * 700, None]


def test_windows_and_collapse_on_odd_white_space(spark):
    """Windows made over Arrow batches equal those of the expression, and collapsing equals the plain pattern."""
    from gristmill.functions import chunking

    d = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    want = d.select("id", F.posexplode(chunking.windows(F.col("text"))).alias("chunk_index", "text")).collect()
    assert sorted(map(tuple, chunking.window_rows(d).collect())) == sorted(map(tuple, want))
    for space in (text.WEB_SPACE, text.PY_SPACE):
        plain = F.btrim(F.regexp_replace("text", f"{space}+", " "), F.lit(" "))
        assert d.where(~text.collapse(F.col("text"), space).eqNullSafe(plain)).count() == 0


def test_statistics_on_odd_texts(spark):
    """Counts over Arrow batches equal those of expressions; line breaks and white space are Python's."""
    from gristmill.operators import quality

    facts = quality._facts(spark.createDataFrame(list(enumerate(ODD)), "id int, text string"))
    want = facts.sparkSession.createDataFrame(list(enumerate(ODD)), "id int, text string").select(
        "id", F.length("text").alias("chars"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")).alias("letters"), F.length(text.collapse(F.col("text"))).alias("flat")
    )
    assert sorted(map(tuple, facts.select("id", "chars", "letters", "flat").collect())) == sorted(map(tuple, want.collect()))
    lines = {r["id"]: (r["lines"], r["short"], r["bad"]) for r in facts.collect()}
    assert lines[4] == (3, 3, 0) and lines[7] == (4, 4, 1) and lines[8] == (1, 0, 0) and lines[11] == (None, None, None)


def test_corpus_passes_are_arrow(spark, sf):
    """Neither windows nor statistics fold over arrays row by row."""
    from gristmill.plans import queries

    for name in ("corpus_doc_stats", "corpus_library_rollup", "gold_round_robin"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "regexp_extract_all" not in plan and "split(" not in plan


def test_repairs_hold_few_rows():
    import pyarrow as pa

    parts = list(repair._passes(iter([pa.record_batch([pa.array(range(1000))], names=["a"])])))
    assert max(p.num_rows for p in parts) <= 64 and sum(p.num_rows for p in parts) == 1000
