"""Benchmark decontamination by winnowing.

Words are hashed; of the k-word grams in every stretch of ``window`` of them the one with
the least hash is kept as a fingerprint (the rightmost of equals).  Two texts that share
``span`` = window + k - 1 words share the stretch, so both keep the same gram: no shared
span of that length is missed.  Fingerprints of training and benchmark texts are joined on
their hash, and each hit is extended to the longest run of equal words around it; a run of
``span`` words or more is a contamination.  Items with fewer words than ``span`` are one
window of their own length, found by the hash of the whole window.

A document is ``contaminated`` if a twentieth of its words is hit, and ``leaked`` if it is
contaminated or holds a window of ``span`` words, however long it is: ``clean`` drops the
leaked ones.  Items of fewer words may be common phrases, so they count by their share only.

Benchmark fingerprints go to the tasks if there are at most ``broadcast_rows`` (16 bytes
each, and the items' word hashes, counted too).  Beyond that the documents' fingerprints are
joined with them by a shuffle, and the windows around their hits with the items' windows.  Both ways
give the same rows.

Null texts have no words.  Items without words occur nowhere.  Items with a null item_id
count as hits but not among n_items.  Repeated items count once.  Repeated rows of documents
get a row each.  An empty benchmark contaminates nothing.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

SPAN, K = 13, 5
#: Word hashes of all benchmark items that are broadcast at most.
BROADCAST_WORDS = 4_000_000


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the grams that are least in some stretch of ``window``; of equals the rightmost."""
    n = len(grams)
    if n < window:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    # over the reversed grams argmin takes the first, so the rightmost
    at = np.arange(n - window, -1, -1) + window - 1 - view.argmin(1)
    return np.unique(at)


class Items:
    """The benchmark in word hashes, and its fingerprints sorted by hash."""

    def __init__(self, ids: list[str | None], words: np.ndarray, first: np.ndarray, span: int, k: int):
        self.ids, self.words, self.first, self.span, self.k = ids, words, first, span, k
        keys, item, place, self.short = [], [], [], {}
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b - a >= span:
                grams = _text.gram_hash(words[a:b], k)
                at = winnow(grams, span - k + 1)
                keys.append(grams[at])
                item.append(np.full(len(at), i))
                place.append(at)
            elif b > a:
                self.short.setdefault(b - a, []).append((int(_text.gram_hash(words[a:b], b - a)[0]), i))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = (np.concatenate(item) if item else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]
        self.short = {n: (np.array([h for h, _ in x], np.uint64), [i for _, i in x]) for n, x in self.short.items()}

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a text are hit, and the items that hit them."""
        hit = np.zeros(len(words) + 1, np.int64)
        found: set[int] = set()
        if len(words) >= self.span and len(self.keys):
            grams = _text.gram_hash(words, self.k)
            there = np.isin(grams, self.keys)
            if there.any():
                at = winnow(grams, self.span - self.k + 1)
                at = at[there[at]]
                lo, hi = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
                done: dict[tuple[int, int], int] = {}  # item and diagonal: up to where it is known
                for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                    for f in range(a, b):
                        i, q = int(self.item[f]), int(self.place[f])
                        if done.get((i, p - q), -1) >= p:
                            continue
                        s, e = self._extend(words, p, i, q)
                        done[i, p - q] = e
                        if e - s >= self.span:
                            hit[s] += 1
                            hit[e] -= 1
                            found.add(i)
        for n, (hashes, items) in self.short.items():
            if len(words) < n:
                continue
            grams = _text.gram_hash(words, n)
            there = np.isin(grams, hashes)
            if there.any():
                for p in np.flatnonzero(there).tolist():
                    hit[p] += 1
                    hit[p + n] -= 1
                seen = set(grams[there].tolist())
                found.update(i for h, i in zip(hashes.tolist(), items) if h in seen)
        return np.cumsum(hit[:-1]) > 0, found

    def whole(self, items: set[int]) -> bool:
        """Whether any of the items has a full window."""
        return any(self.first[i + 1] - self.first[i] >= self.span for i in items)

    def _extend(self, words: np.ndarray, p: int, i: int, q: int) -> tuple[int, int]:
        """The run of equal words around a hit: first and last+1 in the text."""
        item = self.words[self.first[i] : self.first[i + 1]]
        n = min(len(words) - p, len(item) - q)
        right = words[p : p + n] != item[q : q + n]
        e = p + (int(right.argmax()) if right.any() else n)
        n = min(p, q)
        left = (words[p - n : p] != item[q - n : q])[::-1]
        return p - (int(left.argmax()) if left.any() else n), e


def read_items(benchmark: DataFrame) -> DataFrame:
    """item_id and the word hashes of each distinct item with words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _text.slices(batches):
            w = _text.split_words(texts, _text.ALNUM)
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))
            yield _spark.record(batch, ("item_id",), words=lists)

    return _spark.map_arrow(benchmark, words, "words array<long>", keep=("item_id",), read=("item_id", "text")).where("size(words) > 0").distinct()


def _items(rows: list[tuple], span: int, k: int) -> Items:
    first = np.concatenate([[0], np.cumsum([len(w) for _, w in rows])]).astype(np.int64)
    words = np.array([x for _, w in rows for x in w], np.int64).view(np.uint64)
    return Items([None if i is None else str(i) for i, _ in rows], words, first, span, k)


_ADDED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, leaked boolean"


def _result(n_words: np.ndarray, n_hit: list[int], names: list[list[str]], full: list[bool]) -> dict:
    contaminated = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words.tolist())]
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in names], pa.int64()),
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names],
        "contaminated": contaminated,
        "leaked": [x or y for x, y in zip(contaminated, full)],
    }


def scan(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and leaked."""
    items = read_items(benchmark)
    size = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    if size > broadcast_words:
        return _scan_joined(documents, items, span, k)
    shared = _broadcast(items, span, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch, texts in _text.slices(batches):
            w = _text.split_words(texts, _text.ALNUM)
            # most texts share no gram with the benchmark: one look at all grams of the batch finds the others
            maybe = _candidates(items, w)
            n_hit, names, full = [0] * len(texts), [[] for _ in range(len(texts))], [False] * len(texts)
            for i in maybe:
                hit, found = items.hits(w.hash[w.first[i] : w.first[i + 1]])
                n_hit[i], full[i] = int(hit.sum()), items.whole(found)
                names[i] = sorted({items.ids[x] for x in found if items.ids[x] is not None})
            yield _spark.record(batch, ("doc_id",), **_result(np.diff(w.first), n_hit, names, full))

    return _spark.map_arrow(documents, run, _ADDED)


def clean(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents that aren't leaked, with all their columns."""
    items = read_items(benchmark)
    size = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    if size > broadcast_words:
        bad = _scan_joined(documents, items, span, k, ("gm_row",)).where("leaked").select("gm_row").distinct()
        marked = documents.withColumn("gm_row", F.xxhash64("doc_id", "text"))
        return marked.join(bad, "gm_row", "left_anti").select(*documents.columns)
    shared = _broadcast(items, span, k)

    def passes(texts: pa.Array) -> np.ndarray:
        w = _text.split_words(texts, _text.ALNUM)
        n, bad = np.diff(w.first), np.zeros(len(texts), bool)
        for i in _candidates(shared.value, w):
            hit, found = shared.value.hits(w.hash[w.first[i] : w.first[i + 1]])
            bad[i] = shared.value.whole(found) or hit.any() and 20 * int(hit.sum()) >= n[i]
        return ~bad

    return _spark.filter_arrow(documents, lambda: passes)


def _broadcast(items: DataFrame, span: int, k: int):
    rows = sorted(((r["item_id"], r["words"]) for r in items.collect()), key=lambda x: (x[0] is None, str(x[0])))
    return items.sparkSession.sparkContext.broadcast(_items(rows, span, k))


def _candidates(items: Items, w: _text.Words) -> list[int]:
    """Texts of which some gram, taken over the whole batch, is a fingerprint or a short item."""
    places = []
    if len(items.keys):
        grams = _text.gram_hash(w.hash, items.k)
        places.append(np.flatnonzero(_member(items.keys, grams)))
    for n, (hashes, _) in items.short.items():
        places.append(np.flatnonzero(_member(np.sort(hashes), _text.gram_hash(w.hash, n))))
    at = np.concatenate(places) if places else np.empty(0, np.int64)
    return np.unique(np.searchsorted(w.first, at, "right") - 1).tolist()


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is among the sorted keys; a table of the top 20 bits decides most."""
    if not len(h):
        return np.zeros(0, bool)
    table = np.zeros(1 << 20, bool)
    table[keys >> np.uint64(44)] = True
    out = table[h >> np.uint64(44)]
    at = np.flatnonzero(out)
    out[at] = keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]
    return out


def _windows(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of n words, as two numbers."""
    other = _text.mix(words ^ np.uint64(0xA0761D6478BD642F))
    return tuple((_text.gram_hash(w, n) ^ np.uint64(n)).view(np.int64) for w in (words, other))


def _short_key(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """A hash of the first words, k at most, of each run of n: what short items are looked for by."""
    m = min(n, k)
    return _text.gram_hash(words, m) ^ np.uint64(0xE7037ED1A0B428DB + m)


def _scan_joined(documents: DataFrame, items: DataFrame, span: int, k: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same rows by joins.

    Texts' fingerprints meet the distinct ones of all items, so a common one costs a text one row however many items
    have it.  Only texts with a hit are read again, each once: they give the windows around
    their hits, which meet the items' windows by 128-bit hashes.
    """
    items = items.select(F.col("item_id").cast("string").alias("gm_name"), "words", F.xxhash64("item_id", "words").alias("gm_key"))
    lengths = tuple(sorted(r[0] for r in items.select(F.size("words").alias("n")).where(f"n < {span}").distinct().collect()))
    short = {min(n, k): [m for m in lengths if min(m, k) == min(n, k)] for n in lengths}

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints (b null) and windows (a and b) of each item."""
        for batch in batches:
            out = []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array(words, np.int64).view(np.uint64)
                n = min(span, len(w))
                if n == span:
                    grams = _text.gram_hash(w, k)
                    prints = grams[winnow(grams, span - k + 1)]
                else:
                    prints = _short_key(w, n, k)[:1]
                out += [(key, x, None, n == span) for x in np.unique(prints).view(np.int64).tolist()]
                out += [(key, x, y, n == span) for x, y in set(zip(*(h.tolist() for h in _windows(w, n))))]
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["gm_key", "a", "b", "gm_full"])

    def prints(w: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """By the kind of window (0: whole ones, else words of the key of short ones): hashes and positions of a text's fingerprints."""
        grams = _text.gram_hash(w, k)
        at = winnow(grams, span - k + 1)
        every = [(0, grams[at].view(np.int64), at)]
        for m in short:
            h = _short_key(w, m, k)
            every.append((m, h.view(np.int64), np.arange(len(h))))
        return every

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _text.slices(batches):
            w = _text.split_words(texts, _text.ALNUM)
            found = [np.unique(np.concatenate([h for _, h, _ in prints(w.hash[a:b])])) for a, b in zip(w.first[:-1], w.first[1:])]
            rows = np.repeat(batch.column(0).to_numpy(), [len(p) for p in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(rows)], names=["a", "gm_row"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of a text that hold a fingerprint which some item has."""
        for batch, texts in _text.slices(batches):
            w = _text.split_words(texts, _text.ALNUM)
            for i, (row, hits) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own, hits = w.hash[w.first[i] : w.first[i + 1]], np.array(hits, np.int64)
                cols: list[tuple] = []
                for m, h, at in prints(own):
                    at = at[np.isin(h, hits)]
                    for n in [span] if not m else short[m]:
                        start = at if m else np.unique(at[:, None] - np.arange(span - k + 1))
                        start = start[(start >= 0) & (start + n <= len(own))]
                        x, y = _windows(own, n)
                        cols.append((x[start], y[start], start, np.full(len(start), n)))
                a, b, s, n = map(np.concatenate, zip(*cols))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row, np.int64)), pa.array(a), pa.array(b), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["gm_row", "a", "b", "s", "n"])

    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("gm_row"))
    facts = _spark.cut(items.select("gm_key", "words").mapInArrow(of_items, "gm_key long, a long, b long, gm_full boolean"))
    windows = facts.where("b is not null")
    marks = docs.select("gm_row", "text").mapInArrow(of_texts, "a long, gm_row long").join(facts.where("b is null").select("a").distinct(), "a", "left_semi")
    hits = marks.groupBy("gm_row").agg(F.collect_set("a").alias("gm_hits"))
    texts = docs.select("gm_row", "text").join(hits, "gm_row").select("gm_row", "text", "gm_hits")
    shared = texts.mapInArrow(around, "gm_row long, a long, b long, s int, n int").join(windows.select("a", "b").distinct(), ["a", "b"], "left_semi")
    shared = _spark.cut(shared.distinct())
    named = shared.select("gm_row", "a", "b").distinct().join(windows, ["a", "b"]).select("gm_row", "gm_key", "gm_full").distinct().join(items.select("gm_key", "gm_name"), "gm_key")
    named = named.groupBy("gm_row").agg(F.sort_array(F.collect_set("gm_name")).alias("gm_names"), F.max("gm_full").alias("gm_full"))
    edges = shared.groupBy("gm_row").agg(F.collect_list(F.struct("s", "n")).alias("gm_edges"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _text.slices(batches):
            n = np.diff(_text.split_words(texts, _text.ALNUM).first)
            yield _spark.record(batch, (*keep, "gm_row") if "gm_row" not in keep else keep, gm_n=pa.array(n, pa.int64()))

    kept = (*keep, "gm_row") if "gm_row" not in keep else keep
    counted = _spark.map_arrow(docs, count, "gm_n long", keep=kept, read=(*kept, "text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n = get["gm_n"].to_numpy()
            n_hit = []
            for size, own in zip(n.tolist(), get["gm_edges"].to_pylist()):
                d = np.zeros(size + 1, np.int64)
                for e in own or []:
                    d[e["s"]] += 1
                    d[e["s"] + e["n"]] -= 1
                n_hit.append(int((np.cumsum(d[:-1]) > 0).sum()))
            yield _spark.record(batch, keep, **_result(n, n_hit, [x or [] for x in get["gm_names"].to_pylist()], [bool(x) for x in get["gm_full"].to_pylist()]))

    joined = counted.join(edges, "gm_row", "left").join(named, "gm_row", "left")
    return _spark.map_arrow(joined, finish, _ADDED, keep=keep, read=(*keep, "gm_n", "gm_edges", "gm_names", "gm_full"))
