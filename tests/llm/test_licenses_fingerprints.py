"""Operators 8 and 10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import license_scan, lz_fingerprint

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def base(text: str | None):
    w = words_of(text)
    places = [(s, label) for p, label in PHRASES.items() for q in [p.split()] for s in range(len(w) - len(q) + 1) if w[s : s + len(q)] == q]
    at = [s for s, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(w: list[str], t: list[str]) -> int:
    """The least edit distance of a template from any stretch of a text."""
    row = [0] * (len(w) + 1)
    for i, x in enumerate(t, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(w, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def closeness(w: list[str]) -> dict[str, float]:
    """The best share of a template for each label, by edit distance over all stretches of the text."""
    out: dict[str, float] = {}
    have = set(w)
    for label, text, must in license_scan.TEMPLATES:
        t = text.split()
        if set(must.split()) <= have:
            out[label] = max(out.get(label, 0.0), 1 - nearest(w, t) / len(t))
    return out


def check_licenses(d) -> dict:
    """Base columns as by hand; labels only where the text is near a template, and wherever a template stands in it unchanged."""
    rows = {}
    texts = sorted(((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()), key=repr)
    got = sorted(license_scan.scan(d).collect(), key=repr)
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(repr(i) for i, _ in texts)
    by_base: dict = {}
    for i, t in texts:
        by_base.setdefault((i, *base(t)), []).append(t)
    for r in got:
        key = (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        text = by_base[key].pop()
        w = words_of(text)
        near = closeness(w) if len(w) < 3000 else {}
        labels = set(filter(None, r["labels"].split(",")))
        assert r["labels"] == ",".join(sorted(labels)) and set(filter(None, r["base_labels"].split(","))) <= labels
        exact = {label for label, t, _ in license_scan.TEMPLATES if f" {t} " in f" {' '.join(w)} "}
        assert exact <= labels
        if len(w) < 3000:
            for x in labels - set(r["base_labels"].split(",")):
                assert near[x] >= license_scan.COVERAGE - 1e-9, (x, near[x], text)
            assert r["score"] == 1 if r["n_base"] else r["score"] <= max(near.values(), default=0.0) + 1e-9
        rows[r["doc_id"]] = r
    return rows


def test_license_scan(spark, documents, docs, no_docs):
    long = "\n".join(f"{t} , and so on" for _, t, _ in license_scan.TEMPLATES)
    more = spark.createDataFrame([(1, long), (2, "under the mit license " * 30), (3, "K under the MIT licenſe"), (4, "cc by  NC cc-by-nc"), (5, long.replace("license", "licence"))], "doc_id long, text string")
    for d in (documents, docs, more):
        check_licenses(d)
    assert license_scan.scan(no_docs).count() == 0


def test_shredded_templates_are_no_license(spark):
    """Every run of a template, each once, but not in a row; and whole ones out of order."""
    r = random.Random(3)
    rows, i = [], 0
    for label, text, _ in license_scan.TEMPLATES:
        w = text.split()
        if len(w) < 9:
            continue
        runs = [w[k : k + 3] for k in range(len(w) - 2)]
        rows.append((i, label, " ".join(x for run in runs for x in run)))
        r.shuffle(runs)
        rows.append((i + 1, label, " ".join(x for run in runs for x in run)))
        pieces = [w[k : k + 4] for k in range(0, len(w), 4)]
        rows.append((i + 2, label, " ".join(x for p in reversed(pieces) for x in p)))
        i += 3
    got = check_licenses(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"))
    shredded = [got[i]["labels"].split(",") for i, label, _ in rows if label not in got[i]["base_labels"].split(",")]
    assert sum(label in got[i]["labels"].split(",") for i, label, _ in rows if label not in ("mit", "apache-2", "cc-by-nc")) == 0 and shredded


def test_edited_licenses_are_found(spark):
    """A tenth of the words changed, put in or left out: most are found; all with one word in twenty changed."""
    r = random.Random(4)
    for share, least in ((0.05, 0.95), (0.1, 0.8)):
        rows, want = [], {}
        for n in range(4):
            for k, (label, text, must) in enumerate(license_scan.TEMPLATES):
                w, at = text.split(), license_scan._place(text, must)
                if len(w) < 30:
                    continue
                out = []
                for j, x in enumerate(w):
                    edit = not at <= j < at + 3 and r.random() < share
                    out += [x] if not edit else r.choice([["xx"], [], [x, "xx"]])
                rows.append((100 * n + k, "word " * r.randint(0, 9) + " ".join(out) + " more"))
                want[100 * n + k] = label
        got = check_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sum(label in got[i]["labels"].split(",") for i, label in want.items()) >= least * len(want)



def lz78(text: str) -> set[str]:
    seen, at = set(), 0
    out = set()
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n] in seen:
            n += 1
        seen.add(text[at : at + n])
        out.add(text[at : at + n])
        at += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \né"), max_size=80))
def test_parse(text):
    ends, begin = lz_fingerprint.parse(text, set())
    cut = [0, *ends] + ([len(text)] if begin < len(text) else [])
    assert {text[a:b] for a, b in zip(cut, cut[1:])} == lz78(text)
    assert len(lz_fingerprint.phrase_hashes(text, ends)) == len(lz78(text))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc "), max_size=120), st.text(st.sampled_from("abc "), max_size=60))
def test_edited_parse_starts_where_the_text_is_unchanged(text, following):
    p = lz_fingerprint.Parsed(1, text, 8)
    edited, print_ = p.edited(following, 8)
    n = len(text) // 4
    assert edited == (text[:-n] if n else text) + following[:n]
    assert (p.sketch == lz_fingerprint.fingerprint(text, 8)).all() and (print_ == lz_fingerprint.fingerprint(edited, 8)).all()


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_with_edits(spark, documents, docs, no_docs, ranges):
    many = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text {i % 200} of many {i}") for i in range(300)]
    for d in (documents, docs, spark.createDataFrame(many, "doc_id long, text string").repartition(4)):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in d.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42), x[1]))
        want = []
        for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
            n = len(t) // 4
            e = t[: len(t) - n] + u[:n]
            a, b, c = (lz_fingerprint.fingerprint(x) for x in (t, e, u))
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), lz_fingerprint.to_text(a), lz_fingerprint.to_text(b), lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)))
        got = sorted(map(tuple, lz_fingerprint.with_edits(d, ranges=ranges).collect()), key=repr)
        assert got == sorted(want, key=repr)
    assert lz_fingerprint.with_edits(no_docs, ranges=ranges).count() == 0


def test_likeness():
    f = lz_fingerprint.fingerprint
    x = "".join(chr(97 + i * i % 23) for i in range(3000))
    assert lz_fingerprint.likeness(f(x), f(x)) == 1 and lz_fingerprint.likeness(f(""), f("")) == 1 and lz_fingerprint.likeness(f(""), f("a")) == 0
    assert lz_fingerprint.likeness(f(x), f(x[:2400] + "zyx" * 200)) > lz_fingerprint.likeness(f(x), f("qr" * 1500))
