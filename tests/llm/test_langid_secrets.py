"""Operators 3 and 4: held-out accuracy, brute-force paths, base findings by plain patterns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gristmill.llm import langid, secrets

FAR = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_and_inputs(spark):
    d = spark.read.parquet(FAR)
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    test = got[got["held_out"]]
    assert len(test) > 150 and (test["lang"] == test["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    # neither the language of held-out rows nor the source matters
    other = d.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    again = langid.identify(other).toPandas().set_index("doc_id")["lang_pred"]
    assert (again.loc[got["doc_id"]].to_numpy() == got["lang_pred"]).all()


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(0)
    for trial in range(40):
        sizes = r.integers(0, 6, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = r.normal(0, 2, (first[-1], 3)).astype(np.float32)
        labels = langid.viterbi(scores, first, 1.0, block=2)
        for a, b in zip(first, first[1:]):
            total = lambda path: sum(scores[a + i, p] for i, p in enumerate(path)) - sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
            if b > a:
                assert np.isclose(total(labels[a:b]), max(map(total, itertools.product(range(3), repeat=b - a))), atol=1e-4)


def test_many_languages_take_the_same_paths_in_little_memory():
    r = np.random.default_rng(1)
    for k in (17, 40):
        sizes = r.integers(0, 90, 12)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = r.normal(0, 2, (first[-1], k)).astype(np.float32)
        blocks = langid.BLOCK_LANGS
        langid.BLOCK_LANGS = 99
        try:
            want = langid.viterbi(scores, first, 3.0)
        finally:
            langid.BLOCK_LANGS = blocks
        got = langid.viterbi(scores, first, 3.0)
        total = lambda path, a, b: scores[np.arange(a, b), path[a:b]].astype(float).sum() - 3 * (np.diff(path[a:b]) != 0).sum()
        for a, b in zip(first, first[1:]):
            assert np.isclose(total(got, a, b), total(want, a, b), atol=1e-3)
    model = langid.Model([str(i) for i in range(200)], np.ones((1 << 16, 200), np.int64), np.ones((langid.SCRIPTS, 200), np.int64))
    assert langid._slice_bytes(model) * len(model.langs) <= langid.SLICE * langid.BLOCK_LANGS


def test_spans_of_mixed_text(spark):
    d = spark.read.parquet(FAR)
    model = langid.fit(d.where(~langid.held_out()))
    en, de = (d.where((F.col("lang") == x) & langid.held_out() & (F.length("text") > 300)).orderBy("doc_id").first()["text"][:300] for x in ("en", "de"))
    lang, score, spans = langid.predict(model, pa.array([en + " " + de, "", "123 !!"], pa.large_string()), spans=True)
    assert {s["lang"] for s in spans[0]} == {"en", "de"} and score[0] < 0.9
    assert lang[1:] == ["und", "und"] and score[1] == score[2] == 0


def test_langid_odd_rows(docs, no_docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 3, 6, 9)} == {"und"}
    assert langid.identify(no_docs).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(nothing).collect()} == {"und"}
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0


def base_by_hand(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def check_secrets(d, found):
    texts = {}
    for r in d.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    for r in found.collect():
        want = base_by_hand(texts[r["doc_id"]])
        shown = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("net:")] == shown
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        assert r["n_net"] == len(spans) - len(shown)


def test_secret_scan(spark, documents, docs, no_docs):
    net = secrets.fit(spark.read.parquet(FAR))
    assert 0 < net.threshold <= 1
    check_secrets(documents, secrets.scan(documents, net))
    odd = secrets.scan(docs, net)
    assert odd.count() == docs.count()
    check_secrets(docs, odd)
    assert secrets.scan(no_docs).count() == 0
    # secrets whose keyword is far away are found by form; prose is left alone
    at = lambda t: net.probability(np.stack([secrets.window(t, a, b) for a, b in secrets.candidates(t)]))
    assert secrets.candidates("plain words only") == []
    hidden = "the value 4f9d1c0ba77e23d95c66ab12 is new"
    assert at(hidden)[0] > at("see chapter-of-the-building-plans now")[0]


def test_secrets_that_the_patterns_miss_are_found(spark):
    """Bare keys of forms that no pattern has, against long words, numbers, addresses and paths."""
    net = secrets.fit(spark.read.parquet(FAR))
    r = np.random.default_rng(9)
    alnum = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    draw = lambda letters, n: "".join(r.choice(letters, n))
    kinds = {
        "bare": lambda: draw(alnum, 32),
        "prefixed": lambda: "zz_" + draw(alnum, 36),
        "upper hex": lambda: draw(list("0123456789ABCDEF"), 40),
        "behind a path": lambda: "some-path/of-many-words/" * 4 + draw(alnum, 40),
    }
    rows, i = [], 0
    for make in kinds.values():
        for _ in range(50):
            rows.append((i, f"the value {make()} was seen in the log", 1))
            i += 1
    plain = ["anthrererendanhe", "mail7.example.com", "9807915762804490", "erschlichchstscher", "https://www.example.com/path/to/page.html", "twenty-four-seven-support", "2026-01-31T10:15:30.000", "================", "a_very_long_function_name"]
    for w in plain:
        rows.append((i, f"and then {w} was seen, too", 0))
        i += 1
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    n = {r["doc_id"]: r["n_net"] for r in secrets.scan(d, net).collect()}
    assert not any(r["n_assign"] + r["n_access"] + r["n_hex"] for r in secrets.scan(d, net).collect())
    found = [[n[k] > 0 for k in range(50 * j, 50 * j + 50)] for j in range(len(kinds))]
    assert all(np.mean(f) >= 0.9 for f in found), [np.mean(f) for f in found]
    assert sum(n[k] > 0 for k in range(200, i)) <= 1, [w for w, k in zip(plain, range(200, i)) if n[k]]


def test_calibration_is_apart_and_clean_text_left_alone(spark, monkeypatch):
    """What training and calibration see has no candidate in common; few documents of sf0.01 without a planted secret get a span."""
    seen = {}
    monkeypatch.setattr(secrets.Net, "train", lambda self, x, y, w, train=secrets.Net.train: seen.update(train=x) or train(self, x, y, w))
    monkeypatch.setattr(secrets.Net, "calibrate", lambda self, x, y, cal=secrets.Net.calibrate: seen.update(test=x, y=y) or cal(self, x, y))
    d = spark.read.parquet(FAR)
    net = secrets.fit(d)
    part = lambda x: {w.tobytes() for w in x[:, secrets.CONTEXT : secrets.CONTEXT + secrets.SEEN]}
    assert not part(seen["train"]) & part(seen["test"])
    assert (net.probability(seen["test"][seen["y"] > 0]) >= net.threshold).mean() >= secrets.RECALL
    got = secrets.scan(d, net)
    assert got.where("n_net > 0").count() <= 0.02 * got.count()


def test_all_labelled_windows_are_learnt_from(spark, monkeypatch):
    """More secrets than any sample of 4,000 takes, and a threshold from all that were set apart."""
    r = random.Random(4)
    texts = [f"token = {r.getrandbits(160):040x} and chapter-{r.getrandbits(60):020d}-of-it" for _ in range(4500)]
    seen = []
    monkeypatch.setattr(secrets, "learn", lambda x, y: seen.append((len(x), y.sum())) or secrets.Net())
    secrets.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {(w.tobytes(), y) for t in texts for w, y in secrets.labelled(t)}
    assert seen == [(len(want), sum(y for _, y in want))] and seen[0][1] > 8000


def test_shards_learn_as_one_and_lose_no_window(spark, monkeypatch):
    d = spark.read.parquet(FAR)
    want = {(w.tobytes(), y) for (t,) in d.select("text").collect() for w, y in secrets.labelled(t or "")}
    monkeypatch.setattr(secrets, "BLOCK", 60)
    monkeypatch.setattr(secrets, "MADE", 300)
    counted = []
    monkeypatch.setattr(secrets.Net, "calibrate_on", lambda self, z, y, n, old=secrets.Net.calibrate_on: counted.append((z, y, n)) or old(self, z, y, n))
    net = secrets.fit(d)
    z, y, n = counted[0]
    p = net._scaled(z)
    kept = n[(y > 0) & (p >= net.threshold)].sum() / n[y > 0].sum()
    assert kept >= secrets.RECALL and n[(y == 0) & (p >= net.threshold)].sum() <= 0.05 * n[y == 0].sum()
    again = secrets.fit(d.repartition(7))
    assert (again.state() == net.state()).all() and again.threshold == net.threshold
    # blocks hold every window once
    rows = pa.RecordBatch.from_pylist([{"w": w, "y": y} for w, y in sorted(want)])
    monkeypatch.setattr(secrets, "examples", lambda x, y, seed: (x, y))
    back = [(w.tobytes(), int(k)) for x, y in secrets._blocks(iter([rows.slice(0, 7), rows.slice(7)]), 60) for w, k in zip(x, y)]
    assert len(want) > 120 and sorted(back) == sorted(want)


def test_unseen_forms_are_found():
    """Learning from hexadecimal secrets only, and from made-up keys of other forms, it finds most access keys."""
    r = np.random.default_rng(2)
    texts = [f'{"word " * int(r.integers(0, 4))}token = "{"".join(r.choice(list("0123456789abcdef"), 40))}" {"word " * int(r.integers(0, 4))}' for _ in range(150)]
    texts += [f'key AKIA{"".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16))} end' for _ in range(50)]
    texts += [f"some {''.join(r.choice(list('abcdefghijklmnopqrstuvwxyz'), 18))} word" for _ in range(200)]
    rows = [(w, y, "AKIA" in t) for t in texts for w, y in secrets.labelled(t)]
    x, y, form = np.stack([w for w, _, _ in rows]), np.array([y for _, y, _ in rows]), np.array([f for _, _, f in rows])
    assert secrets.unseen_recall(x, y, form) >= 0.8


def test_labels_need_no_context():
    found = secrets.labelled("token: abcdefghij0123456789")
    assert [y for _, y in found] == [1, 1] and not (found[0][0] == found[1][0]).all()


def test_a_secret_deep_in_a_candidate_is_seen(spark):
    net = secrets.Net()  # it looks for five digits in the candidate
    net.conv[:], net.w1[:], net.w2[:] = 0, 0, 0
    net.conv[:, 6, 0] = net.w1[secrets.FILTERS, 0] = 1
    net.w2[0], net.b2, net.threshold = 4, -18, 0.5
    text = "see " + "abcdefgh/" * 12 + "81726Zq" * 5 + "/abcdefgh" * 9 + " now"
    d = spark.createDataFrame([(1, text), (2, "see " + "abcdefgh/" * 40 + " now")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_net"] for r in secrets.scan(d, net).collect()} == {1: 1, 2: 0}
    for a, b in ((0, 16), (0, 48), (5, 54), (7, 500)):
        parts = secrets.windows(a, b)
        assert parts[0][0] == a and parts[-1][1] == b and all(y - x <= secrets.SEEN for x, y in parts)
        assert all(x2 <= y1 for (_, y1), (x2, _) in zip(parts, parts[1:]))


def test_threshold_keeps_the_recall_of_hard_secrets():
    r = np.random.default_rng(0)
    net, y = secrets.Net(), np.arange(2200) < 200
    z = r.normal(0, 1, len(y)) + y
    net.logits = lambda x: z[x]
    at = np.arange(len(y))
    net.calibrate(at, y.astype(float))
    assert (net.probability(at[y]) >= net.threshold).mean() >= secrets.RECALL
