"""Document fingerprints from the phrases of a Lempel-Ziv parse.

A text is parsed from left to right into the shortest phrases not seen before (LZ78).  The
phrases' 64-bit hashes make the document's set; the fingerprint is its ``size`` smallest
hashes, and the likeness of two fingerprints is the share of the smallest hashes of their
union that both have, which estimates the Jaccard similarity of the phrase sets (exact for
sets no larger than ``size``).  Equal texts have equal fingerprints.

``with_edits`` compares each document with an edited copy, whose last quarter came from
the next document in order of doc_id, and with that document.  Documents are dealt out by
ranges of doc_id, so neighbours meet in a task; a range's first document also goes to the
range before it.  Only texts cross the shuffle, each once.

Null texts count as empty; the empty text has an empty fingerprint, which is like itself
(1) and unlike any other (0).  Rows with a null doc_id come last; rows with one doc_id are
ordered by their text's hash (xxhash64, unsigned), so that however many of them there are, they spread
over ranges.  A lone document is its own next.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark, _text

#: Hashes in a fingerprint.
SIZE = 96
#: Ranges of ids: their edges are in the driver and in every task.
MAX_RANGES = 1 << 16


def parse(text: str, seen: set[str], at: int = 0) -> tuple[list[int], int]:
    """Adds the phrases of text from ``at`` on to ``seen``; where they end, and where the unfinished last one begins."""
    ends: list[int] = []
    begin = at
    phrase = ""
    for i, c in enumerate(text[at:] if at else text, at + 1):
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            ends.append(i)
            phrase = ""
            begin = i
    return ends, begin


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """Distinct hashes of the phrases of a whole text, an unfinished one at the end included."""
    if not text:
        return np.empty(0, np.uint64)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], np.int64)
    start = np.concatenate([[0], end[:-1]])
    return np.unique(_text.span_hash(cps, _text.symbol_keys(0x110000), start, end))


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return hashes[:size]


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    return sketch(phrase_hashes(text, parse(text, set())[0]), size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) == size or len(b) == size:
        both = both[:size]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, both[-1], "right") / len(both))


def to_text(f: np.ndarray) -> str:
    return f.astype(">u8").tobytes().hex()


class Parsed:
    """A text with its phrases; the parse can be taken up at three quarters."""

    __slots__ = ("text", "size", "cut", "sketch", "ends", "seen", "begin", "id")

    def __init__(self, doc_id, text: str, size: int):
        self.id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 4
        self.seen: set[str] | None = set()
        self.ends, self.begin = parse(text[: self.cut], self.seen)
        if self.cut < len(text):
            # the rest is parsed over a copy that is taken back, so that the edited end can start here too
            added, _ = _rest(text, self.begin, self.seen)
            whole = self.ends + added
        else:
            whole = self.ends
        self.sketch = sketch(phrase_hashes(text, whole), size)

    def edited(self, following: str, size: int) -> tuple[str, np.ndarray]:
        text = self.text[: self.cut] + following[: len(self.text) - self.cut]
        added, _ = _rest(text, self.begin, self.seen)
        ends = self.ends + added
        self.seen = None
        return text, sketch(phrase_hashes(text, ends), size)


def _rest(text: str, begin: int, seen: set[str]) -> tuple[list[int], int]:
    """The phrases from ``begin`` on; ``seen`` is as before afterwards."""
    ends, last = parse(text, seen, begin)
    a = begin
    for b in ends:
        seen.discard(text[a:b])
        a = b
    return ends, last


def with_edits(documents: DataFrame, size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    doc_id is of an integer type.  ``ranges``: four for each shuffle partition if not given,
    at most MAX_RANGES; a range is read as a stream, so its size costs time only.  Edges of ranges come from
    percentiles, so an id that many rows share is an edge several times and gets as many ranges.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", _spark.empty_text().alias("text")).withColumn("gm_h", F.xxhash64("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or min(MAX_RANGES, 4 * partitions)
    facts = docs.agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("edges")).first()
    edges = np.array(sorted(facts["edges"] or []) if n > 1 else [], np.int64)
    spare = max(1, -(-facts["nulls"] * n // max(1, facts["rows"])))  # ranges of null ids

    def place(ids: pa.Array, h: np.ndarray) -> np.ndarray:
        """The range of each row; an id that takes several ranges by itself, and null ids, are spread by their texts' hashes."""
        key = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        part = (h.view(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        lo, hi = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
        at = np.where(hi > lo, lo + 1 + (part * np.maximum(hi - lo, 1)).astype(np.int64), lo)
        return np.where(np.asarray(ids.is_null()), len(edges) + 1 + (part * spare).astype(np.int64), at).astype(np.int32)

    def signed(batch: pa.RecordBatch, name: str) -> np.ndarray:
        # the order of the ranges is that of unsigned hashes
        return batch.column(batch.schema.get_field_index(name)).to_numpy() ^ np.int64(-(1 << 63))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lowest id and hash of each range in a batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, h = batch.column(0), signed(batch, "gm_h")
            at = place(ids, batch.column(1).to_numpy())
            key = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((h, key, at))
            head = order[np.append(True, at[order][1:] != at[order][:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(at[head]), pa.array(key[head]), pa.array(h[head])], names=["r", "i", "h"])

    first = docs.select("doc_id", "gm_h").mapInArrow(lowest, "r int, i long, h long").groupBy("r").agg(F.min(F.struct("i", "h")).alias("x")).select("r", "x.*").orderBy("r").collect()
    order = [r["r"] for r in first]
    before = {b: a for a, b in zip(order[-1:] + order, order)}
    heads = {(r["r"], r["i"], r["h"]): before[r["r"]] for r in first}  # a range's first row, and the range before

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row goes to its range; a range's first row also to the range before (the first's to the last)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, h = batch.column(0), signed(batch, "gm_h")
            at = place(ids, batch.column(2).to_numpy())
            key = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            guests = [(k, to) for k, x in enumerate(zip(at.tolist(), key.tolist(), h.tolist())) if (to := heads.get(x)) is not None]
            rows = pa.array([*range(batch.num_rows), *(k for k, _ in guests)])
            to = pa.array([*at.tolist(), *(r for _, r in guests)], pa.int32())
            guest = pa.array([False] * batch.num_rows + [True] * len(guests))
            yield pa.RecordBatch.from_arrays([ids.take(rows), batch.column(1).take(rows), pa.array(h).take(rows), to, guest], names=["doc_id", "text", "gm_h", "gm_range", "gm_guest"])

    # every partition has the same number of ranges, one beside the other
    total = len(edges) + 1 + spare
    wide = min(total, partitions)
    dealt = (
        _spark.map_arrow(docs, deal, "gm_h long, gm_range int, gm_guest boolean", keep=("doc_id", "text"), read=("doc_id", "text", "gm_h"))
        .repartitionById(wide, F.floor(F.col("gm_range").cast("long") * wide / total).cast("int"))
        .sortWithinPartitions("gm_range", "gm_guest", F.col("doc_id").asc_nulls_last(), "gm_h", "text")
        .select("doc_id", "text", "gm_range", "gm_guest")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        now, last, done = None, None, True
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text, r, guest in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != now:
                    now, last, done = r, None, False
                if done:  # only the first guest is the next document
                    continue
                parsed = Parsed(doc_id, text, size)
                if last is not None:
                    out.append(_row(last, parsed, size))
                last, done = parsed, guest
                if len(out) >= 1000:
                    yield _batch(out, kind)
                    out = []
        if out:
            yield _batch(out, kind)

    return dealt.mapInArrow(run, T.StructType(_spark.fields(docs, "doc_id") + T._parse_datatype_string(_ADDED).fields))


_ADDED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc: Parsed, following: Parsed, size: int) -> tuple:
    text, edited = doc.edited(following.text, size)
    return (
        doc.id,
        len(doc.text),
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        to_text(doc.sketch),
        to_text(edited),
        likeness(doc.sketch, edited, size),
        likeness(doc.sketch, following.sketch, size),
    )


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
