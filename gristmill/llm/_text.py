"""Vectorised text primitives that work on Arrow string buffers.

Everything here runs inside ``mapInArrow`` workers.  Texts of a batch stay one
contiguous buffer; words, pre-tokens and their 64-bit hashes come out of a fixed
number of numpy passes over it, so no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on; longer single texts make a pass of their own.
CHUNK_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    inv = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.full(n, _P, np.uint64), np.full(n, inv, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 1
    return _pow(size if n <= size else 1 << n.bit_length())


@lru_cache(maxsize=4)
def symbol_keys(n: int) -> np.ndarray:
    """A fixed random 64-bit number for each symbol below n."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _P)


def span_hash(symbols: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of symbols, by prefix sums of a polynomial modulo 2^64."""
    n = len(symbols)
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(keys[symbols] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _M2))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, _ = powers(k + 1)
    h, done = np.zeros(n, np.uint64), 0
    part, size = words * up[1], 1  # of runs of 1, 2, 4 ... words; k's binary digits say which follow each other
    while size <= k:
        if k & size:
            h = h + part[done : done + n] * up[done]
            done += size
        part, size = part[:-size] + part[size:] * up[size], 2 * size
    return mix(h)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with at most about ``limit`` bytes of text each, beside their texts without nulls."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts), np.int64))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), texts.slice(i, j - i)
            i = j


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text begins (and the last one ends)."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def code_points(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one str, its code points, and where each text begins in them."""
    raw, at = utf8(texts)
    whole = raw.tobytes().decode("utf-8", "surrogatepass")
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return whole, cps, first[at]


class Words:
    """The words of a batch of texts: hash, first and last byte, and the first word of each text."""

    __slots__ = ("hash", "start", "end", "first")

    def __init__(self, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.hash, self.start, self.end, self.first = hash_, start, end, first


def _table(inside) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, np.array([inside(int(b)) for b in lower])


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z, as bytes of UTF-8.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: ``[^\x20\x09-\x0D]+``
SPACED = _table(lambda b: not (b == 0x20 or 9 <= b <= 13))


def split_words(texts: pa.Array, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """Words of one of the two kinds above; A-Z count as a-z."""
    raw, at = utf8(texts)
    lower, inside = kind
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, np.zeros(len(at), np.int64))
    mask = inside[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    h = span_hash(lower[raw], symbol_keys(256), starts, ends)
    return Words(h, starts, ends, np.searchsorted(starts, at))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 white space, 3 other, as the tokenizer libraries' Unicode tables have it."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 3, np.uint8)
    for k, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+")):
        e = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(e.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
    return out


def _runs(raw_class: np.ndarray, edge: np.ndarray) -> np.ndarray:
    new = edge[:-1].copy()
    new[1:] |= raw_class[1:] != raw_class[:-1]
    return new


def pretokens(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of the byte-level pattern begin; they cover all texts without gaps.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+``.  A run is a
    maximal stretch of one class of characters inside a text.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    c = char_classes()[cps]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    begin = _runs(c, edge)
    last = np.ones(n, bool)
    last[:-1] = begin[1:]
    white = c == 2
    # the last white space of a run before other text stands alone or goes with what follows
    handed = white & last & ~edge[1:]
    prefix = handed & (cps == 32)
    start = begin | handed
    start[1:] &= ~prefix[:-1]
    # contractions: an apostrophe alone, not after a blank, then certain letters
    quote = np.flatnonzero((cps == 39) & begin & last)
    if len(quote):
        quote = quote[(quote + 1 < n) & ~edge[np.minimum(quote + 1, n)]]
        quote = quote[~((quote > 0) & prefix[quote - 1])]
        one = cps[quote + 1]
        more = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        two = np.where(more, cps[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(x) for x in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = single | double
        quote, size = quote[hit], np.where(single[hit], 2, 3)
        start[quote + 1] = False
        after = quote + size
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)
