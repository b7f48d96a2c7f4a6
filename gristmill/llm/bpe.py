"""Byte-level BPE encoding and decoding by replaying the merges over a corpus of words.

The words that a stretch of the corpus adds to those known already are laid out as one
chain of symbols.  An inverted index maps each token pair to the positions where it stands
in any word.  Pairs are taken in rank order; every position of the pair is merged at once
and only the two neighbouring pairs of each are taken out and put in anew.  A word is
replayed once for all its occurrences; a bounded cache in the worker keeps its ids, so the
corpus's words are never shuffled and memory doesn't follow the corpus.

Decoding takes the ids alone, through the table of the tokens' bytes.

Null texts count as empty.  Repeated rows get a row each; a null doc_id stays null; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _spark, _text

#: Ids that the cache holds before it starts anew (4 bytes each, and 16 for each word).
CACHE_IDS = 6_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Merges:
    """Ranks of tokens, and what each pair of tokens makes."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = r
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, r in ranks.items():
            by_id[r] = token
        self.tokens = by_id
        self.sizes = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, as if each word alone merged its lowest pair, leftmost first, until none is left."""
        out: list[list[int] | None] = []
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        byte, ranks = self.byte, self.ranks
        for w in words:
            r = ranks.get(w)
            if r is not None:
                out.append([r])
                spans.append((0, 0))
                continue
            out.append(None)
            spans.append((len(ids), len(w)))
            ids.extend([byte[b] for b in w])
            ids.append(-1)  # ends the word
        n = len(ids)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pairs = self.pairs
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = ids[i], ids[i + 1]
            if a >= 0 and b >= 0:
                k = a << 32 | b
                r = pairs.get(k)
                if r is not None:
                    # pairs that make the same token share a rank, so the index is by rank
                    index.setdefault(r, []).append(i)
        ready = list(index)
        heapq.heapify(ready)
        while ready:
            r = heapq.heappop(ready)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for done, i in enumerate(places):
                a = ids[i]
                if a < 0:
                    continue
                j = following[i]
                if j >= n:
                    continue
                b = ids[j]
                if b < 0 or pairs.get(a << 32 | b) != r:
                    continue  # a neighbour's merge took it
                ids[i] = r
                ids[j] = -2
                k = following[i] = following[j]
                low = r
                if k < n:
                    before[k] = i
                    c = ids[k]
                    if c >= 0:
                        x = pairs.get(r << 32 | c)
                        if x is not None:
                            if x in index:
                                index[x].append(i)
                            else:
                                index[x] = [i]
                                heapq.heappush(ready, x)
                            low = min(low, x)
                p = before[i]
                if p >= 0:
                    c = ids[p]
                    if c >= 0:
                        x = pairs.get(c << 32 | r)
                        if x is not None:
                            if x in index:
                                index[x].append(p)
                            else:
                                index[x] = [p]
                                heapq.heappush(ready, x)
                            low = min(low, x)
                if low < r:  # a new pair comes before the rest of these
                    rest = places[done + 1 :]
                    if rest:
                        if r in index:
                            index[r].extend(rest)
                        else:
                            index[r] = rest
                            heapq.heappush(ready, r)
                    break
        for w, (at, size) in enumerate(spans):
            if out[w] is None:
                out[w] = [x for x in ids[at : at + size] if x >= 0]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after the other."""
        return gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of values, one after the other."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    at = np.arange(total) + np.repeat(start - (end - size), size)
    return values[at]


class Encoder:
    """Encodes batches of texts; keeps the ids of words in a bounded cache."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids = self.merges.replay(words)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.array([x for w in ids for x in w], np.uint32)
        start = len(self.ids) + np.cumsum(size) - size
        keys, start, size = (np.concatenate(x) for x in ((self.keys, keys), (self.start, start), (self.size, size)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.size, self.ids = keys[order], start[order], size[order], np.concatenate([self.ids, flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (and the last one's end)."""
        whole, cps, first = _text.code_points(texts)
        at = _text.pretokens(cps, first)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        end = np.append(at[1:], len(cps))
        h = _text.span_hash(cps, _text.symbol_keys(0x110000), at, end)
        u, one, back = np.unique(h, return_index=True, return_inverse=True)
        for attempt in (0, 1):
            known = np.zeros(len(u), bool)
            if len(self.keys):
                known = self.keys[np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)] == u
            if known.all():
                break
            if len(self.ids) > CACHE_IDS and not attempt:
                self._clear()
                continue
            new = one[~known]
            self._learn(u[~known], [whole[a:b].encode("utf-8", "surrogatepass") for a, b in zip(at[new].tolist(), end[new].tolist())])
        place = np.searchsorted(self.keys, u)
        start, size = self.start[place][back], self.size[place][back]
        total = np.concatenate([[0], np.cumsum(size)])
        return gather(self.ids, start, size), total[np.searchsorted(at, first)]


def encode(documents: DataFrame, ranks: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of each row; ``ranks`` is a file's path on the driver.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the
    bytes that the ids decode to.  Without ``keep_ids`` the ids themselves are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared.value)
        for batch, texts in _text.slices(batches):
            ids, at = encoder.encode(texts)
            sizes = encoder.merges.sizes[ids]
            decoded = gather(encoder.merges.bytes, encoder.merges.starts[ids], sizes).tobytes()
            to = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
            raw, cuts = ids.astype("<u4").tobytes(), (at * 4).tolist()
            columns = {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))} if keep_ids else {}
            yield _spark.record(
                batch,
                ("doc_id",),
                **columns,
                n_tokens=np.diff(at),
                ids_sha256=[hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])],
                decoded_sha256=[hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(to, to[1:])],
            )

    return _spark.map_arrow(documents, run, ("ids array<int>, " if keep_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string")


_ENCODER: dict[int, Encoder] = {}


def _worker_encoder(raw: bytes) -> Encoder:
    """Kept between the tasks of a worker process."""
    key = hash(raw)
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = Encoder(Merges(read_ranks(raw)))
    return _ENCODER[key]


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the text that each row's ids decode to; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _worker_encoder(shared.value).merges
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [merges.decode(np.asarray(x.values, np.int64)).decode("utf-8", "replace") if x.is_valid and len(x.values) else "" for x in ids]
            yield _spark.record(batch, ("doc_id",), text=pa.array(texts, pa.string()))

    return _spark.map_arrow(encoded, run, "text string", read=("doc_id", "ids"))
