"""Token counts by a two-tier lookup on the map side.

A byte-level BPE tokenizer splits a text into pre-tokens and encodes each alone, so a
text's count is the sum of its pre-tokens' lengths.  One pass over the corpus finds the
most frequent pre-tokens: every task counts its own and passes on a summary of at most
``SUMMARY_SIZE`` of them, which is all that crosses a shuffle.  Their 64-bit hashes and lengths, at most
``table_size`` of them (12 bytes each), are broadcast.  The second pass looks every pre-token of the
corpus up there; what is missing goes to a cache in the worker and, if it is missing there too, through
the tokenizer library.  The table only saves time: counts are the same with any table.

Tokenizers of another kind (``.model``, or ``.json`` that isn't plain byte-level BPE) encode
whole texts through their library.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows get a row each; a null doc_id
stays null; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark, _text

#: Frequent pre-tokens in the broadcast table, and summary rows of a task.
TABLE_SIZE = 1 << 14
SUMMARY_SIZE = 1 << 12
#: Distinct pre-tokens that a task counts before it drops the rarest, and that a worker's cache holds.
TASK_DISTINCT = 1 << 17
CACHE_SIZE = 1 << 19
#: Pieces that go to the library at once: its encodings are large.
PIECES = 2048


def is_byte_level(spec: str) -> bool:
    """Whether pre-tokens of ``_text.pretokens`` are this tokenizer's, so lengths add up."""
    j = json.loads(spec)
    pre, model = j.get("pre_tokenizer") or {}, j.get("model") or {}
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not j.get("normalizer")
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in j.get("added_tokens", []))
    )


class Cache:
    """Hashes and lengths: sorted arrays, merged now and then with what is new."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and whether each was there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.values[at], self.keys[at] == h

    def add(self, h: np.ndarray, v: np.ndarray, limit: int) -> None:
        if len(self.keys) + len(h) > limit:
            self.keys, self.values = self.keys[:0], self.values[:0]
        keys, values = np.concatenate([self.keys, h]), np.concatenate([self.values, v])
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]


def _segments(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text, pre-token starts, ends and hashes, and each text's first pre-token."""
    whole, cps, first = _text.code_points(texts)
    start = _text.pretokens(cps, first)
    end = np.append(start[1:], len(cps)) if len(start) else start
    h = _text.span_hash(cps, _text.symbol_keys(0x110000), start, end)
    return whole, start, end, h, np.searchsorted(start, first)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent pre-tokens: key, text and count."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    names: dict[int, str] = {}
    for _, texts in _text.slices(batches):
        whole, start, end, h, _ = _segments(texts)
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        new = ~np.isin(u, keys)
        for k, i in zip(u[new].tolist(), at[new].tolist()):
            names[k] = whole[start[i] : end[i]]
        both = np.concatenate([keys, u])
        keys, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys) > TASK_DISTINCT:
            top = np.sort(np.argpartition(counts, -TASK_DISTINCT // 2)[-TASK_DISTINCT // 2 :])
            keys, counts = keys[top], counts[top]
            names = {k: names[k] for k in keys.tolist()}
    top = np.lexsort((keys, -counts))[:SUMMARY_SIZE]
    yield pa.RecordBatch.from_arrays([pa.array(keys[top].astype(np.int64)), pa.array([names[k] for k in keys[top].tolist()], pa.string()), pa.array(counts[top])], names=["key", "piece", "n"])


def frequent(documents: DataFrame, size: int = TABLE_SIZE) -> DataFrame:
    """The most frequent pre-tokens of all whole texts: key, piece, n; at most ``size`` rows."""
    found = documents.select("text").mapInArrow(_summaries, "key long, piece string, n long")
    return found.groupBy("key").agg(F.min("piece").alias("piece"), F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size)


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; ``tokenizer`` is a file's path on the driver."""
    spark: SparkSession = documents.sparkSession
    raw = open(tokenizer, "rb").read()
    byte_level = tokenizer.endswith(".json") and is_byte_level(raw.decode())
    keys, lengths = np.empty(0, np.uint64), np.empty(0, np.int32)
    if byte_level and table_size:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(raw.decode())
        t.encode_special_tokens = True
        rows = frequent(documents, table_size).select("key", "piece").toPandas()
        keys = rows["key"].to_numpy(np.int64).astype(np.uint64)
        lengths = np.array([len(e.ids) for e in t.encode_batch(rows["piece"].tolist(), add_special_tokens=False)], np.int32)
    shared = spark.sparkContext.broadcast((raw, keys, lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, keys, lengths = shared.value
        lookup = _lookup(raw, Cache(keys, lengths)) if byte_level else _library(raw, tokenizer)
        for batch, texts in _text.slices(batches):
            n = lookup(texts)
            yield _spark.record(batch, ("doc_id",), n_bytes=pc.binary_length(texts).cast(pa.int64()), n_tokens=n, over_limit=n > limit)

    return _spark.map_arrow(documents, count, "n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=1)
def _tokenizer(raw: bytes):
    """Kept between the tasks of a worker process, which has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode())


def _lookup(raw: bytes, table: Cache):
    """Counts of texts by the table, then the worker's cache, then the library."""
    tokenizer = _tokenizer(raw)
    special = [a["content"] for a in json.loads(raw).get("added_tokens", [])]
    cache = Cache(np.empty(0, np.uint64), np.empty(0, np.int32))

    def lengths(texts: pa.Array) -> np.ndarray:
        whole, start, end, h, first = _segments(texts)
        n, there = table.find(h)
        miss = np.flatnonzero(~there)
        if len(miss):
            u, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            v, known = cache.find(u)
            new = np.flatnonzero(~known)
            if len(new):
                i = miss[at[new]]
                pieces = [whole[a:b] for a, b in zip(start[i].tolist(), end[i].tolist())]
                v = v.copy()
                tokenizer.encode_special_tokens = True
                v[new] = [len(e.ids) for k in range(0, len(pieces), PIECES) for e in tokenizer.encode_batch_fast(pieces[k : k + PIECES], add_special_tokens=False)]
                cache.add(u[new], v[new], CACHE_SIZE)
            n = n.copy()
            n[miss] = v[back]
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        out = total[first[1:]] - total[first[:-1]]
        for s in special:  # texts with the strings of special tokens are cut there by the library
            if s in whole:
                tokenizer.encode_special_tokens = False
                for i in np.flatnonzero(np.asarray(pc.match_substring(texts, s))).tolist():
                    out[i] = len(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids)
        return out

    return lengths


def _library(raw: bytes, name: str):
    """Counts of whole texts by the library of the file's kind."""
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: np.array([len(x) for x in p.encode(texts.to_pylist(), num_threads=1)], np.int64)
    t = _tokenizer(raw)
    t.no_truncation()
    t.no_padding()
    return lambda texts: np.array([len(e.ids) for e in t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], np.int64)
