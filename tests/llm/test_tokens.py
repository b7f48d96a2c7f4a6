"""Operators 1 and 2 against the tokenizer libraries."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import _text, bpe, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")


def ranks() -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(ranks())


#: Code points that Unicode tables of different years agree on.
TEXT = st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]) | st.sampled_from("'strevmlld \n\t 　aAbB19½"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_pretokens_are_the_patterns_matches(texts):
    whole, cps, first = _text.code_points(pa.array(texts, pa.large_string()))
    starts = _text.pretokens(cps, first)
    ends = np.append(starts[1:], len(cps))
    assert [whole[a:b] for a, b in zip(starts, ends)] == [m for t in texts for m in regex.findall(P.PATTERN, t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_replay_gives_the_librarys_ids(encoding, merges, texts):
    ids, at = bpe.Encoder(merges).encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoding.encode_ordinary(t) for t in texts]


def test_replay_of_runs_and_repeats(encoding, merges):
    words = ["a" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 12)] + ["0" * 300, "=" * 257, "ha" * 99]
    assert merges.replay([w.encode() for w in words]) == [encoding.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    if name.endswith(".json"):
        t = Tokenizer.from_file(P.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        p = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda x: len(p.encode(x))
    got = sorted(map(tuple, token_counts.count_tokens(docs, P.path(name), limit=100).collect()), key=repr)
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := count(r["text"] or ""), n > 100) for r in docs.collect()]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("size", [0, 5])
def test_counts_are_the_same_with_any_table(docs, size):
    path = P.path("byte_bpe_50k.json")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(token_counts.count_tokens(docs, path)) == rows(token_counts.count_tokens(docs, path, table_size=size))


def test_encode_and_decode(docs, encoding):
    found = bpe.encode(docs, RANKS)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        ids = encoding.encode_ordinary(text)
        want.append((r["doc_id"], ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = sorted(((r["doc_id"], r["text"]) for r in bpe.decode(found, RANKS).collect()), key=repr)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)


def test_empty_tables(no_docs):
    assert token_counts.count_tokens(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode(no_docs, RANKS).count() == 0


def test_a_small_cache_gives_the_same_ids(monkeypatch, merges, encoding):
    monkeypatch.setattr(bpe, "CACHE_IDS", 10)
    e = bpe.Encoder(merges)
    for t in ["one two three four five six seven", "eight nine one two", "ten eleven twelve thirteen"]:
        assert e.encode(pa.array([t], pa.large_string()))[0].tolist() == encoding.encode_ordinary(t)
