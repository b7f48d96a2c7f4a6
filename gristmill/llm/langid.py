"""Language identification of spans by Viterbi over per-word scores.

Every language learnt has smoothed log-probabilities of hashed character 2- and 3-grams
(with word edges), and the scripts it is written in.  A word's script leaves only the
languages that use that script as candidates; each candidate's score is the mean
log-probability of the word's grams, times the square root of its letters.  Viterbi over a
text's words, with a penalty for a switch, labels each word; stretches of one label are the
spans of a mixed text.  The text's language is the one with most letters, its score their
share (so 0 to 1).

Null ids are not held out: their rows are learnt from (their crc is null), and predicted like all.

The model is ``buckets`` x languages numbers, whatever the corpus; it is fitted on at most
about ``rows_per_lang`` labelled rows of each language, chosen by a hash of the text, and
every prediction reads the text alone, the whole of it.

Texts that are null or have no letter are ``und`` with score 0.  If nothing can be learnt
(no labelled row), all are ``und``.  Ties go to the label that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

BUCKETS = 1 << 16
ROWS_PER_LANG = 4000
SWITCH_PENALTY = 6.0
#: Bytes of text that are scored at once: every letter takes some hundred bytes on the way.
SLICE = 1 << 20
#: Languages up to which texts are cut into blocks, each with a table of languages by languages.
BLOCK_LANGS = 16
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01

#: First code points of the ranges and what script they are; 0 has no letters of a known script.
_RANGES = [
    (0x0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14),
    (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 25), (0x18B0, 0), (0x1C80, 3),
    (0x1C90, 21), (0x1CC0, 0), (0x1D00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2D00, 21), (0x2D30, 0), (0x2DE0, 3), (0x2E00, 0), (0x2E80, 26), (0x3040, 27), (0x3100, 26), (0x3130, 22),
    (0x3190, 26), (0x31F0, 27), (0x3200, 0), (0x3400, 26), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAB30, 1), (0xABC0, 0), (0xAC00, 22), (0xD7FF, 0), (0xF900, 26), (0xFB00, 1),
    (0xFB07, 0), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF66, 27), (0xFFA0, 22), (0x10000, 0), (0x20000, 26), (0x32000, 0),
]
SCRIPTS = 28


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: is it a letter, its lower case, its script."""
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter[:0x1E944]).tolist():
        x = chr(i).lower()
        if len(x) == 1:
            lower[i] = ord(x)
    at = np.array([a for a, _ in _RANGES])
    script = np.array([s for _, s in _RANGES], np.uint8)[np.searchsorted(at, np.arange(n), "right") - 1]
    return letter, lower, script


class Grams:
    """Words (maximal runs of letters) of a batch of texts and the hashed grams of their letters."""

    def __init__(self, texts: pa.Array, buckets: int):
        _, cps, first = _text.code_points(texts)
        letter, lower, script = _letters()
        n = len(cps)
        mask = letter[cps]
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        start = mask.copy()
        start[1:] &= ~mask[:-1] | edge[1:n]
        end = mask.copy()
        end[:-1] &= ~mask[1:] | edge[1:n]
        self.start, last = np.flatnonzero(start), np.flatnonzero(end)
        self.size = last - self.start + 1
        self.first = np.searchsorted(self.start, first)
        at = np.flatnonzero(mask)
        self.scripts = script[cps[at]]
        self.begin = np.concatenate([[0], np.cumsum(self.size)])  # of each word among the letters
        c = lower[cps[at]].astype(np.uint64) + np.uint64(1)
        head = np.zeros(len(at), bool)
        head[self.begin[:-1]] = True
        tail = np.zeros(len(at), bool)
        tail[self.begin[1:] - 1] = True
        one = np.zeros(len(at), np.uint64)
        one[1:] = c[:-1]
        one[head] = 0
        after = np.zeros(len(at), np.uint64)
        after[:-1] = c[1:]
        after[tail] = 0
        w = np.uint64(1 << 21)
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        pair = one * w + c
        self.grams = [((g * _text._P) >> shift).view(np.int64) for g in (pair ^ np.uint64(1 << 62), pair * w + after)]

    def word_script(self) -> np.ndarray:
        """The script of each word's first letter."""
        return self.scripts[self.begin[:-1]]


class Model:
    """Log-probabilities (buckets x languages), and which language may be meant in which script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = counts.astype(np.float64) + 0.5
        self.logp = np.log(p / p.sum(0)).astype(np.float32) if len(langs) else np.empty((len(counts), 0), np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(1)] = True  # a script that no language uses rules none out

    def scores(self, g: Grams) -> np.ndarray:
        """Words x languages; -inf where the script rules a language out."""
        total = self.logp[g.grams[0]]
        for x in g.grams[1:]:
            total = total + self.logp[x]
        s = np.add.reduceat(total, g.begin[:-1], axis=0) / (len(g.grams) * np.sqrt(g.size))[:, None]
        s -= s.max(1, keepdims=True)
        s[~self.allowed[g.word_script()]] = -1e9
        return s.astype(np.float32)


def _step(v: np.ndarray, scores: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Best totals one word later, and what a switch gives; labels are the second last axis."""
    top = v.max(-2, keepdims=True) - penalty
    out = np.maximum(v, top)
    out += scores
    return out, top


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, block: int = 48) -> np.ndarray:
    """The best label of each word.

    Texts are cut into blocks of words and all blocks go forward side by side, once for each
    label of their first word; then the blocks of a text are chained; then each block is
    traced back from the labels that the chain gave its ends.  With more than ``BLOCK_LANGS``
    labels, whose tables of labels by labels would be large, whole texts go forward side by side.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int16)
    size = np.diff(first)
    if not n or k == 1:
        return labels
    if k > BLOCK_LANGS:
        return _plain_viterbi(scores, first, penalty)
    scores = np.ascontiguousarray(scores.T, np.float64)
    count = -(-size // block)
    text = np.repeat(np.arange(len(size)), count)
    head = np.cumsum(count) - count  # the first block of each text
    nth = np.arange(len(text)) - head[text]
    begin = first[:-1][text] + nth * block
    width = np.minimum(block, first[1:][text] - begin)
    order = np.argsort(-width, kind="stable")
    alive = np.searchsorted(-width[order], -np.arange(block), "left")  # blocks longer than t
    b = begin[order]

    gain = np.full((k, k, len(b)), -1e18)
    gain[range(k), range(k)] = scores[:, b]
    for t in range(1, block):
        if m := alive[t]:
            gain[:, :, :m] = _step(gain[:, :, :m], scores[:, b[:m] + t], penalty)[0]
    v = np.empty((len(b), k, k))
    v[order] = gain.transpose(2, 0, 1)  # first label x last label of each block

    # chain the blocks of each text
    texts = np.argsort(-count, kind="stable")
    texts = texts[count[texts] > 0]
    longest = int(count[texts[0]])
    more = np.searchsorted(-count[texts], -np.arange(longest + 1), "left")
    best = np.empty((len(text), k))
    start_of = np.empty((len(text), k), np.int16)  # the block's first label for each last label
    last_of = np.empty((len(text), k), np.int16)  # the last label of the block before, for each first label
    at = head[texts]
    best[at], start_of[at] = v[at].max(1), v[at].argmax(1)
    own = np.arange(k)
    for t in range(1, longest):
        at = head[texts[: more[t]]] + t
        before = best[at - 1]
        top = before.max(1, keepdims=True)
        stay = before >= top - penalty
        last_of[at] = np.where(stay, own, before.argmax(1)[:, None])
        total = np.where(stay, before, top - penalty)[:, :, None] + v[at]
        best[at], start_of[at] = total.max(1), total.argmax(1)
    one, two = np.empty(len(text), np.int16), np.empty(len(text), np.int16)
    for t in range(longest - 1, -1, -1):
        here = texts[: more[t]]
        at = head[here] + t
        ends = count[here] == t + 1
        two[at[ends]] = best[at[ends]].argmax(1)
        go = at[~ends]
        two[go] = last_of[go + 1, one[go + 1]]
        one[at] = start_of[at, two[at]]

    # inside the blocks, from the first label on
    one, two = one[order], two[order]
    w = np.full((k, len(b)), -1e18)
    w[one, np.arange(len(b))] = scores[one, b]
    back = np.empty((k, n), np.int16)
    for t in range(1, block):
        if m := alive[t]:
            here = b[:m] + t
            now = w[:, :m].copy()
            switch = now.argmax(0)
            w[:, :m], top = _step(now, scores[:, here], penalty)
            back[:, here] = np.where(now >= top, own[:, None], switch)
    labels[b + width[order] - 1] = two
    for t in range(block - 1, 0, -1):
        if m := alive[t]:
            here = b[:m] + t
            labels[here - 1] = back[labels[here], here]
    return labels


def _plain_viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The same word by word: a switch costs the same from any label, so a step needs the best label only, and what is kept of a word is a bit a label and that one."""
    n, k = scores.shape
    labels = np.zeros(n, np.int16)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(size[0] + 1), "left")  # texts longer than t
    v = scores[begin].astype(np.float64)
    stays, best = np.ones((n, k), bool), np.zeros(n, np.int16)
    last = np.empty(len(begin), np.int16)
    for t in range(1, size[0] + 1):
        m = alive[t]
        ended = slice(m, alive[t - 1])
        last[ended] = v[ended].argmax(1)
        if not m:
            break
        here = begin[:m] + t
        top = v[:m].argmax(1)
        switch = v[np.arange(m), top] - penalty
        stays[here] = v[:m] >= switch[:, None]
        best[here] = top
        v = np.maximum(v[:m], switch[:, None]) + scores[here]
    labels[begin + size - 1] = last
    for t in range(size[0] - 1, 0, -1):
        here = begin[: alive[t]] + t
        now = labels[here]
        labels[here - 1] = np.where(stays[here, now], now, best[here])
    return labels


def _slice_bytes(model: Model) -> int:
    """Bytes of text that are scored at once: fewer for many languages, each of which takes some numbers a word."""
    return max(1 << 14, SLICE * BLOCK_LANGS // max(BLOCK_LANGS, len(model.langs)))


def fit(labelled: DataFrame, buckets: int = BUCKETS, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learns from text and lang of the rows whose lang is not null."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    langs = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    names = [x for x, _ in langs]
    counts, scripts = np.zeros((buckets, len(names)), np.int64), np.zeros((SCRIPTS, len(names)), np.int64)
    if names:
        share = F.create_map(*[F.lit(x) for name, n in langs for x in (name, min(1.0, rows_per_lang / n))])
        chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch, texts in _text.slices(batches, limit=SLICE):
                lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
                for name in set(lang):
                    g = Grams(texts.filter(pa.array([x == name for x in lang])), buckets)
                    now = total.setdefault(name, np.zeros(buckets + SCRIPTS, np.int64))
                    for x in g.grams:
                        now[:buckets] += np.bincount(x, minlength=buckets)
                    now[buckets:] += np.bincount(g.scripts, minlength=SCRIPTS)
            for name, now in total.items():
                at = np.flatnonzero(now)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(now[at])], names=["lang", "at", "n"])

        found = chosen.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
        both = np.zeros((buckets + SCRIPTS, len(names)), np.int64)
        both[found["at"], found["lang"].map({x: i for i, x in enumerate(names)})] = found["n"]
        counts, scripts = both[:buckets], both[buckets:]
    return Model(names, counts, scripts)


def label(documents: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of each row; with ``spans`` also the spans: label, first and last+1 word."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in _text.slices(batches, limit=_slice_bytes(model)):
            lang, score, found = predict(model, texts, penalty, spans)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield _spark.record(batch, ("doc_id",), lang_pred=lang, score=score, **({"spans": pa.array(found, kind)} if spans else {}))

    return _spark.map_arrow(documents, run, "lang_pred string, score double" + (", spans array<struct<lang: string, start: int, end: int>>" if spans else ""))


def predict(model: Model, texts: pa.Array, penalty: float = SWITCH_PENALTY, spans: bool = False) -> tuple[list[str], np.ndarray, list]:
    """Language, score and (if asked for) spans of each text."""
    k, n = len(model.langs), len(texts)
    g = Grams(texts, len(model.logp))
    if not k or not len(g.size):
        return ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    labels = viterbi(model.scores(g), g.first, penalty)
    text_of = np.repeat(np.arange(n), np.diff(g.first))
    letters = np.bincount(text_of * k + labels, weights=g.size, minlength=n * k).reshape(n, k)
    best, total = letters.argmax(1), letters.sum(1)
    score = letters[np.arange(n), best] / np.maximum(total, 1)
    found: list = []
    if spans:
        for i in range(n):
            own = labels[g.first[i] : g.first[i + 1]]
            cut = np.flatnonzero(np.diff(own)) + 1
            found.append([{"lang": model.langs[own[a]], "start": int(a), "end": int(b)} for a, b in zip([0, *cut], [*cut, len(own)])] if len(own) else [])
    return [model.langs[b] if t else "und" for b, t in zip(best, total)], score, found


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep(documents: DataFrame, min_score: float = 0.0, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The documents with a language that has at least ``min_score`` of the letters; ``und`` goes.

    At 0 a text stays however many languages share it.
    """
    model = fit(documents.where(~held_out()).select("lang", "text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def passes(texts: pa.Array) -> np.ndarray:
        lang, score, _ = predict(shared.value, texts, penalty)
        return (score >= min_score) & np.array([x != "und" for x in lang], bool)

    return _spark.filter_arrow(documents, lambda: passes, limit=_slice_bytes(model))


def identify(documents: DataFrame, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learns from the labelled rows that aren't held out."""
    model = fit(documents.where(~held_out()).select("lang", "text"))
    found = label(documents, model, penalty)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
