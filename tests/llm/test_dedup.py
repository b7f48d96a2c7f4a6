"""Operators 5, 6, 7 and 9 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, line_dedup, near_dedup, substring_dedup

from .conftest import SCHEMA, EXTRA, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def table(spark, texts: dict[int, str]):
    return spark.createDataFrame([(i, t, "en", "s", len(t), *["x"] * len(EXTRA)) for i, t in texts.items()], SCHEMA)


# -- 5 -------------------------------------------------------------------------------------


def best_chain(p, q, gap):
    n, score = len(p), [1.0] * len(p)
    order = np.lexsort((q, p)).tolist()
    for i, x in enumerate(order):
        for y in order[:i]:
            if p[y] < p[x] and q[y] < q[x]:
                score[x] = max(score[x], 1 + score[y] - max(0, gap * (p[x] - p[y] + q[x] - q[y] - 2)))
    return max(score) if n else 0


def test_chains_score_as_brute_force():
    r = random.Random(0)
    for _ in range(200):
        n = r.randint(1, 14)
        p, q = (np.array([r.randint(0, 30) for _ in range(n)]) for _ in range(2))
        found = substring_dedup.chains(p, q)
        assert sorted(i for c in found for i in c) == list(range(n))
        c = found[0]
        assert all(p[a] < p[b] and q[a] < q[b] for a, b in zip(c, c[1:]))
        own = len(c) - sum(substring_dedup.GAP * (p[b] - p[a] + q[b] - q[a] - 2) for a, b in zip(c, c[1:]))
        assert own == pytest.approx(best_chain(p.tolist(), q.tolist(), substring_dedup.GAP))


def test_lcs():
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup._lcs(a, b) == t[-1][-1]


def test_planted_passages_are_found_and_clean_documents_left(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(80)]
    edited = passage.copy()
    edited[30] = "changed"
    del edited[55]
    new = lambda n: [word() for _ in range(n)]
    texts = {1: new(200) + passage + new(50), 2: new(10) + passage, 3: passage[:70] + new(90), 4: new(40) + edited + new(40), 5: new(400), 6: new(100) + passage[:30] + new(100), 7: []}
    found = substring_dedup.passages(table(spark, {i: " ".join(t) for i, t in texts.items()})).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4}
    span = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found if not r["first"]}
    assert span == {2: (10, 90), 3: (0, 70), 4: (40, 119)}
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in found if r["first"]] == [(1, 200, 280)]
    assert all(r["similarity"] >= 0.8 and r["other_doc_id"] == 1 for r in found if not r["first"])


def test_passages_apart_are_found_apart(spark):
    """Two passages, the second too short, with 35 other words between: together they aren't alike enough."""
    r = random.Random(3)
    new = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    one, two = new(55), new(24)
    texts = {1: new(30) + one + new(35) + two + new(30), 2: new(9) + one + new(35) + two + new(9)}
    found = substring_dedup.passages(table(spark, {i: " ".join(t) for i, t in texts.items()})).collect()
    assert sorted((x["doc_id"], x["start_word"], x["end_word"]) for x in found) == [(1, 30, 85), (2, 9, 64)]


def test_every_copy_in_a_document_is_found(spark):
    r = random.Random(4)
    new = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    one = new(55)
    texts = {1: new(30) + one + new(30), 2: new(9) + one + new(7) + one + one + new(120) + one, 3: new(20) + 2 * new(60)}
    found = substring_dedup.passages(table(spark, {i: " ".join(t) for i, t in texts.items()})).where("not first").collect()
    copied = {w for x in found for w in range(x["start_word"], x["end_word"])}
    assert {x["doc_id"] for x in found} == {2}
    assert copied == {w for a in (9, 71, 126, 301) for w in range(a, a + 55)}


def test_edited_passages_are_found(spark):
    """60 passages of 60 words with nine of them changed, neither of the outer two."""
    r = random.Random(5)
    new = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    texts = {}
    for i in range(60):
        one = new(60)
        other = one.copy()
        for at in r.sample(range(2, 58), 9):
            other[at] = new(1)[0]
        texts[i], texts[100 + i] = new(30) + one + new(30), new(9) + other + new(7)
    found = substring_dedup.passages(table(spark, {i: " ".join(t) for i, t in texts.items()})).where("not first").collect()
    assert all(min(x["end_word"], 69) - max(x["start_word"], 9) >= 45 for x in found)
    assert sorted((x["doc_id"], x["other_doc_id"]) for x in found) == [(100 + i, i) for i in range(60)]


def test_a_passage_whose_pieces_stand_elsewhere_is_found(spark):
    r = random.Random(6)
    new = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]
    whole = new(95)
    pieces = [whole[:37], whole[29:66], whole[58:]]  # every 5-gram first stands in one of them
    texts = {i: new(90) + x + new(90) for i, x in enumerate(pieces)} | {7: new(80) + whole + new(70), 8: new(12) + whole + new(75)}
    found = substring_dedup.passages(table(spark, {i: " ".join(t) for i, t in texts.items()})).where("not first").collect()
    assert [(x["doc_id"], x["other_doc_id"], x["start_word"], x["end_word"]) for x in found] == [(8, 7, 12, 107)]


def test_seeds_survive_packing():
    r = np.random.default_rng(0)
    h, p = r.integers(0, 1 << 64, 500, np.uint64), r.integers(0, 1 << 30, 500)
    ids, tags = np.sort(r.integers(-9, 1 << 62, 20)), r.integers(0, 1 << 24, 20)
    doc = r.integers(0, 20, 500)
    back = [np.concatenate(x) for x in zip(*(substring_dedup._unpack(*row[1:]) for row in substring_dedup._pack(h, doc, p, ids, tags, 4)))]
    low = h & np.uint64((1 << 8 * substring_dedup.HASH_BYTES) - 1)
    assert sorted(zip(*(x.tolist() for x in back))) == sorted(zip(low.tolist(), ids[doc].tolist(), tags[doc].tolist(), p.tolist()))


def invented(seed: int):
    r = random.Random(seed)
    return r, lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def spans_of(spark, texts, **kw):
    rows = [(i, " ".join(t)) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw).collect()


def test_a_passage_whose_overlapping_pieces_stand_elsewhere_is_found(spark):
    """No 5-gram of the passage is new to the two that share it, nor to the documents between them."""
    _, new = invented(7)
    whole = new(72)
    pieces = {1: whole[:30], 2: whole[20:52], 3: whole[42:], 12: whole[:30], 13: whole[20:52], 14: whole[42:]}
    texts = {i: new(90) + x + new(90) for i, x in pieces.items()} | {i: new(40 + i) + whole + new(50) for i in (10, 11, 15)}
    found = [x for x in spans_of(spark, texts) if not x["first"]]
    assert {x["doc_id"]: (x["start_word"], x["end_word"]) for x in found} == {11: (51, 123), 15: (55, 127)}


def test_texts_of_one_doc_id_are_told_apart(spark):
    _, new = invented(8)
    one, two = new(60), new(60)
    three = two + new(20)
    rows = [(1, new(300) + one), (2, new(5) + one + new(9)), (2, new(70) + two), (3, three), (3, three)]
    found = spans_of(spark, rows)
    texts = {(x["doc_id"], x["text_hash"]) for x in found}
    assert len(texts) == 4 and len(found) == 4
    later = {(x["doc_id"], x["other_doc_id"], x["start_word"], x["other_start"]): x for x in found if not x["first"]}
    assert set(later) == {(2, 1, 5, 300), (3, 2, 0, 70)}
    assert later[2, 1, 5, 300]["text_hash"] != later[3, 2, 0, 70]["other_text_hash"]


def test_a_shorter_passage_is_not_padded(spark):
    """49 equal words among others are no passage of 50, though 49 of 50 are more than 80 %."""
    _, new = invented(10)
    one, two = new(49), new(50)
    found = spans_of(spark, {1: new(40) + one + new(40), 2: new(9) + one + new(60), 3: new(40) + two + new(40), 4: new(9) + two + new(60)})
    assert {x["doc_id"] for x in found} == {3, 4}


def test_one_word_on_and_on(spark):
    """A text of one word gives few blocks, not one for each place and each place of the other."""
    texts = {1: ["erin"] * 3000, 2: ["erin"] * 7000, 3: ["a", "b"] * 2000, 4: ["b", "a"] * 900}
    found = [x for x in spans_of(spark, texts) if not x["first"]]
    assert {x["doc_id"]: len({w for y in found if y["doc_id"] == x["doc_id"] for w in range(y["start_word"], y["end_word"])}) for x in found} == {2: 7000, 4: 1800}
    assert len(found) < 50


def test_exact_copies_are_found_whole(spark):
    _, new = invented(9)
    one, short = new(50), new(49)
    found = spans_of(spark, {i: t for i, t in enumerate([one, one, short, short, one, new(80)])})
    assert sorted((x["doc_id"], x["first"], x["start_word"], x["end_word"], x["other_doc_id"]) for x in found) == [(0, True, 0, 50, None), (1, False, 0, 50, 0), (4, False, 0, 50, 0)]


def exact_by_hand(texts, size):
    """Words of each document in runs of ``size`` that an earlier document holds."""
    earlier, out = set(), {}
    for i in sorted(texts):
        runs = {s: tuple(texts[i][s : s + size]) for s in range(len(texts[i]) - size + 1)}
        out[i] = {w for s, g in runs.items() if g in earlier for w in range(s, s + size)}
        earlier |= set(runs.values())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_passages_in_mosaics_are_found(spark, monkeypatch, seed):
    """Mosaics of shared pieces of many lengths, held to a brute force over all runs of 50 words: nearly every document and word."""
    monkeypatch.setattr(substring_dedup, "LOCAL_BYTES", 1 << 12)
    monkeypatch.setattr(substring_dedup, "MARGIN", 8)
    r, new = invented(20 + seed)
    pool = [new(r.randint(20, 140)) for _ in range(12)]
    texts = {}
    for i in range(60):
        t = []
        for _ in range(r.randint(1, 5)):
            x = r.choice(pool)
            a = r.randint(0, len(x) // 2)
            t += x[a : a + r.randint(10, 140)] + new(r.choice([0, 3, 30]))
        texts[i] = t
    found = [x for x in spans_of(spark, texts) if not x["first"]]
    want = exact_by_hand(texts, 50)
    got = {i: {w for x in found if x["doc_id"] == i for w in range(x["start_word"], x["end_word"])} for i in texts}
    missed = sum(len(want[i] - got[i]) for i in texts)
    assert sum(map(len, want.values())) > 2000 and missed <= 0.03 * sum(map(len, want.values()))
    assert sum(not got[i] for i in texts if want[i]) <= 1
    for x in found:  # and each row is true
        a, b = texts[x["doc_id"]][x["start_word"] : x["end_word"]], texts[x["other_doc_id"]][x["other_start"] : x["other_end"]]
        assert x["other_doc_id"] < x["doc_id"] and x["n_words"] >= 50
        assert 100 * substring_dedup._lcs(a, b) >= 80 * max(len(a), len(b))


@pytest.mark.parametrize("seed", range(4))
def test_no_word_of_an_exact_passage_is_lost(spark, monkeypatch, seed):
    """Mosaics of many shared pieces, some of them repeated within a text: all words that a brute force over all runs of 50 finds."""
    monkeypatch.setattr(substring_dedup, "LOCAL_BYTES", 1 << (12 + 4 * (seed % 2)))
    r, new = invented(60 + seed)
    pool = [new(r.randint(30, 120)) for _ in range(6)]
    texts = {}
    for i in range(90):
        t = new(r.choice([0, 5]))
        for _ in range(r.randint(1, 6)):
            x = r.choice(pool)
            a = r.randint(0, len(x) // 2)
            t += x[a : a + r.randint(20, 120)] + new(r.choice([0, 0, 3, 30]))
        texts[i] = t
    found = [x for x in spans_of(spark, texts) if not x["first"]]
    want = exact_by_hand(texts, 50)
    got = {i: {w for x in found if x["doc_id"] == i for w in range(x["start_word"], x["end_word"])} for i in texts}
    assert sum(map(len, want.values())) > 3000 and not {i: want[i] - got[i] for i in texts if want[i] - got[i]}
    for x in found:
        a, b = texts[x["doc_id"]][x["start_word"] : x["end_word"]], texts[x["other_doc_id"]][x["other_start"] : x["other_end"]]
        assert x["other_doc_id"] < x["doc_id"] and x["n_words"] >= 50
        assert 100 * substring_dedup._lcs(a, b) >= 80 * max(len(a), len(b))


@pytest.mark.parametrize("local", [1 << 23, 1])
def test_a_passage_whose_pieces_stand_before_it_in_the_other_text_is_found(spark, monkeypatch, local):
    monkeypatch.setattr(substring_dedup, "LOCAL_BYTES", local)
    _, new = invented(70)
    whole = new(50)
    pieces = [w for i in range(7) for w in whole[i : i + 44] + new(60)]
    found = [x for x in spans_of(spark, {1: pieces + whole + new(30), 2: new(9) + whole + new(9)}) if not x["first"]]
    assert [(x["doc_id"], x["start_word"], x["end_word"], x["other_start"]) for x in found] == [(2, 9, 59, len(pieces))]


@pytest.mark.parametrize(("edits", "least"), [(0.1, 1.0), (0.15, 0.98), (0.18, 0.9)])
def test_recall_of_edited_passages(spark, edits, least):
    """Passages of 60 to 120 words with words changed, put in or left out at random, against all 100 planted."""
    r, new = invented(int(100 * edits))
    texts = {}
    for i in range(100):
        one, other = new(r.randint(60, 120)), []
        for w in one:
            x = r.random()
            other += [w] if x >= edits else new(1) if x < 0.6 * edits else [w, *new(1)] if x < 0.8 * edits else []
        texts[i], texts[1000 + i] = new(r.randint(10, 200)) + one + new(30), new(9) + other + new(r.randint(10, 90))
    found = {(x["doc_id"], x["other_doc_id"]) for x in spans_of(spark, texts) if not x["first"]}
    assert found <= {(1000 + i, i) for i in range(100)}
    assert len(found) >= 100 * least


def test_passages_odd_rows(docs, no_docs):
    found = substring_dedup.passages(docs)
    ids = {r["doc_id"] for r in found.collect()}
    assert {36, 39, 42, 45, 48, 51} <= ids and not ids & {0, 3, 6, 9, 12, 15, 18, 21, 33, None}
    assert substring_dedup.passages(no_docs).count() == 0


# -- 6 -------------------------------------------------------------------------------------


def contamination(docs, items, span=13):
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        n = min(span, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if k := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= k
        names = sorted({str(x) for x in found if x is not None})
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_decontamination(spark, sf, documents, docs, limit):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(901, None), (902, ""), (903, "two WORDS"), (903, "two words"), (904, prose(60, 1)), (None, "word"), (905, "éé " * 14)], "item_id long, text string")
    for d, b in ((documents, bench), (docs, odd), (docs, bench)):
        found = decontaminate.scan(d, b, broadcast_words=limit)
        got = sorted(map(tuple, found.drop("leaked").collect()), key=repr)
        rows, items = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.collect()]
        assert got == contamination(rows, items)
        long_items = [x for x in items if len(ALNUM.findall((x[1] or "").translate(UPPER))) >= 13]
        leaked = sum(x[5] or y[2] > 0 for x, y in zip(sorted(contamination(rows, items), key=lambda r: repr((r[0], r[1]))), sorted(contamination(rows, long_items), key=lambda r: repr((r[0], r[1])))))
        assert found.where("leaked").count() == leaked
        kept = decontaminate.clean(d, b, broadcast_words=limit)
        assert kept.columns == d.columns and kept.count() == len(rows) - leaked


def test_decontamination_of_nothing(docs, no_docs):
    none = no_docs.select(F.col("doc_id").alias("item_id"), "text")
    assert {tuple(r)[2:4] for r in decontaminate.scan(docs, none).collect()} == {(0, 0)}
    assert decontaminate.scan(no_docs, none).count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    r = np.random.default_rng(3)
    for _ in range(50):
        g = r.integers(0, 9, r.integers(0, 40)).astype(np.uint64)
        at = decontaminate.winnow(g, 9)
        for s in range(len(g) - 8):
            inside = [x for x in at if s <= x < s + 9]
            assert any(g[x] == g[s : s + 9].min() for x in inside)


# -- 7 -------------------------------------------------------------------------------------


def lines_by_hand(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    holders: dict[str, set] = {}
    for i, t in rows:  # documents, which rows may repeat; null is one of them
        for k in {x.strip(strip).translate(UPPER) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(i)
    low = lambda i: -1 if i is None else i
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keys = [x.strip(strip).translate(UPPER) for x in ls]
        kept = [x for x, k in zip(ls, keys) if len(k) < min_chars or len(holders[k]) < min_docs or low(i) == max(map(low, holders[k]))]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def repeated_lines(spark):
    """Lines held by four documents in five rows, by five with a null one, and by two texts of one largest document."""
    lines = [f"line {i} is long enough to be a key of its own, no doubt" for i in range(4)]
    rows = [(1, lines[0]), (1, lines[0]), (1, lines[0] + "\nown"), (2, lines[0]), (2, lines[0])]
    rows += [(i, f"{lines[1]}\n{lines[2]}") for i in (1, 2, 3, 4)] + [(None, lines[1]), (None, lines[1] + "\nmore")]
    rows += [(9, f"a\n{lines[2]}"), (9, f"{lines[2]}\nb\n{lines[2]}"), (None, None), (7, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [line_dedup.HOT, 3])
def test_line_dedup(spark, documents, docs, no_docs, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    for d in (documents, docs, repeated_lines(spark)):
        got = sorted(map(tuple, line_dedup.report(d).collect()), key=repr)
        assert got == lines_by_hand([(r["doc_id"], r["text"]) for r in d.collect()])
    assert line_dedup.report(no_docs).count() == 0
    clean = line_dedup.clean(docs)
    assert clean.columns == docs.columns and clean.where("length(text) <> n_chars").count() == 0
    assert clean.where("text is null").count() == 1


def test_line_dedup_agrees_with_its_sql(spark, tmp_path):
    """On repeated and null doc_ids too."""
    import duckdb

    d = repeated_lines(spark)
    d.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(line_dedup.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, line_dedup.report(d).collect()), key=repr) == sorted(want, key=repr)
    five = [r for r in want if r[2]]
    assert {r[0] for r in five} == {None, 1, 2, 3, 4} - ({4} if len(five) < 6 else set()) and all(r[2] == 0 for r in want if r[0] == 9)


def test_a_hot_line_is_no_run_of_one_task(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "concat('this one line stands in all of the documents\n', id) AS text")
    assert line_dedup.report(rows).agg(F.sum("n_dropped")).first()[0] == 19999


def test_long_bitmaps(spark):
    line = "one line that is long enough to be counted here, surely"
    texts = {i: "\n".join(f"{i} own {j}" if j % 3 else line for j in range(200)) for i in range(6)}
    d = table(spark, texts)
    assert sorted(map(tuple, line_dedup.report(d).collect()), key=repr) == lines_by_hand(sorted(texts.items()))
    bits = line_dedup.keep_bitmaps(d).first()
    assert bits["n_dropped"] == 67 and len(bits["words"]) == 4


# -- 9 -------------------------------------------------------------------------------------


def near_by_hand(rows, k, percent):
    """rows: (doc_id, text), each doc_id once."""
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(UPPER))
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def family(n: int, seed: int) -> dict[int, str]:
    """Chains of texts, each near the one before but far from the first, and exact copies."""
    r = random.Random(seed)
    out, w = {}, prose(150, seed).split()
    for i in range(n):
        w = w.copy()
        if i % 4:
            w[r.randrange(len(w))] = f"x{seed}{i}"
        out[seed * 1000 + i] = " ".join(w)
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, documents, unique_docs, k, percent):
    grown = table(spark, family(60, 1) | family(45, 2) | {9: "", 10: "a b", 11: "A  B"})
    for d in (documents, unique_docs, grown):
        got = sorted(map(tuple, near_dedup.group(d, k, percent).collect()))
        assert got == near_by_hand([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()], k, percent)


def test_near_dedup_large_bands(spark, monkeypatch):
    """Bands beyond SMALL go through blocks and give the same groups."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 2000)
    texts = family(50, 3) | family(40, 4)
    got = sorted(map(tuple, near_dedup.group(table(spark, texts), 3, 85).collect()))
    assert got == near_by_hand(sorted(texts.items()), 3, 85)


def test_near_dedup_of_repeated_ids(spark):
    """A doc_id with two texts is linked with what either is linked with, however rows lie."""
    same, other = prose(60, 1), prose(60, 2)
    near = " ".join([*same.split()[:-1], "end"])
    for u in (prose(50, 3), prose(50, 4), "short", other):
        rows = [(5, same), (5, u), (9, same), (7, near), (7, near), (8, other), (6, ""), (5, ""), (4, prose(50, 5)), (None, same)]
        want = {5: 5, 9: 5, 7: 5, 8: 5 if u == other else 8, 6: 6, 4: 4, None: None}
        for parts in (1, 5):
            d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            got = near_dedup.group(d, 3, 85).collect()
            assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
            kept = near_dedup.keep_one(d, 3, 85).collect()
            assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({x for x in want.values() if x})


def test_recall_of_near_copies(spark):
    """Copies of 100 texts with words changed, put in and left out, at all degrees: the near stage links just those that brute force links."""
    r = random.Random(11)
    texts = {}
    for i in range(100):
        one = prose(r.randint(40, 200), 1000 + i).split()
        other = one.copy()
        for _ in range(1 + i // 20):
            at = r.randrange(len(other))
            other[at : at + r.randint(0, 1)] = [f"w{i}"] * r.randint(0, 2)
        texts[i], texts[500 + i] = " ".join(one), " ".join(other)
    for k, percent in ((5, 80), (3, 85)):
        want = near_by_hand(list(texts.items()), k, percent)
        assert sorted(map(tuple, near_dedup.group(table(spark, texts), k, percent).collect())) == want
        assert 20 < sum(not x[3] for x in want) < 95


def test_near_dedup_odd_rows(docs, no_docs):
    got = near_dedup.group(docs).collect()
    assert len(got) == docs.count() and [r["kept"] for r in got if r["doc_id"] is None] == [True]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {36} == set(ids) & {36, 39, 42} and None in ids
    assert near_dedup.group(no_docs).count() == 0


def test_super_minhash_estimates_jaccard():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 300).astype(np.uint64)
    h = near_dedup.super_minhash([pool[:200], pool[50:250], np.empty(0, np.uint64), pool[:3]], 128)
    assert abs((h[0] == h[1]).mean() - 150 / 250) < 0.12
    assert np.isinf(h[2]).all() and np.isfinite(h[3]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101)] + [(200, 200)]
    got = {r["id"]: r["root"] for r in near_dedup.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 103: 100}
