"""Recursive chunking with overlap, as one Column expression.

A text longer than ``size`` is split at the coarsest separator, and what is still too long at
the next; last come hard cuts.  Pieces are then put together with blanks up to ``size``; a
chunk that is full is emitted, and the next begins with its last ``overlap`` characters, fewer
if the next piece leaves no room.  No chunk is longer than ``size``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PY_SPACE, collapse

SIZE, OVERLAP = 1000, 200
#: Characters of windows that one Arrow batch holds, or a single text's.
PASS_CHARS = 1 << 21
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _splitter(pattern: str, size: int):
    return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.split(p, pattern, -1))


def pieces(text: Column, size: int = SIZE) -> Column:
    """The pieces of a text, none empty or longer than ``size``."""
    out = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array(text))
    for sep in SEPARATORS:
        out = F.filter(F.flatten(F.transform(out, _splitter(sep.replace(".", "\\."), size))), lambda p: F.length(p) > 0)
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substr(p, i * size + 1, F.lit(size)))
    return F.flatten(F.transform(out, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a text, in order; none for the empty text, null for null."""
    if overlap >= size:
        raise ValueError(f"the overlap ({overlap}) has to be less than the chunk size ({size})")

    def step(state: Column, piece: Column) -> Column:
        now, done = state["now"], state["done"]
        fits = F.length(now) + F.when(F.length(now) > 0, 1).otherwise(0) + F.length(piece) <= size
        joined = F.when(F.length(now) > 0, F.concat(now, F.lit(" "), piece)).otherwise(piece)
        room = F.greatest(F.lit(0), F.least(F.lit(overlap), F.lit(size - 1) - F.length(piece), F.length(now)))
        tail = F.when(room > 0, F.substr(now, F.length(now) - room + 1, room)).otherwise("")
        opened = F.when(F.length(tail) > 0, F.concat(tail, F.lit(" "), piece)).otherwise(piece)
        emitted = F.when(F.length(now) > 0, F.concat(done, F.array(now))).otherwise(done)
        return F.struct(F.when(fits, done).otherwise(emitted).alias("done"), F.when(fits, joined).otherwise(opened).alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(pieces(text, size), start, step, lambda s: F.when(F.length(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def _last(length: Column, size: int, overlap: int) -> Column:
    """The number of the last window."""
    return F.floor((F.greatest(F.lit(1), length - overlap) - 1) / (size - overlap)).cast("int")


def window_count(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """How many windows a text has."""
    return F.when(text.isNotNull(), _last(F.length(collapse(text, PY_SPACE)), size, overlap) + 1)


def window_rows(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of ``windows``, with chunk_index and the window as text, and the row's other columns; made over Arrow batches."""
    keep = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            index: list[int] = []
            made: list[str] = []
            held = 0

            def full() -> pa.RecordBatch:
                where = pa.array(of, pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(where) for c in batch.columns[:-1]), pa.array(index, pa.int32()), pa.array(made, pa.string())], names=schema.names)  # noqa: B023

            for i, t in enumerate(batch.column(batch.num_columns - 1)):
                if not t.is_valid:
                    continue
                flat = " ".join(t.as_py().split())  # str.split knows the white space of PY_SPACE
                for n, at in enumerate(range(0, max(1, len(flat) - overlap), step)):
                    of.append(i)
                    index.append(n)
                    made.append(flat[at : at + size])
                held += len(flat)
                if held > PASS_CHARS:
                    yield full()
                    of, index, made, held = [], [], [], 0
            if of:
                yield full()

    return rows.select(*keep, "text").mapInArrow(run, schema)


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Fixed windows of the collapsed text, ``size - overlap`` apart.

    The text is collapsed and cut into steps once; a window is put together from the steps that it
    covers, so the cost follows the text's length.
    """
    step = size - overlap
    covered = -(-size // step)

    def cut(flat: Column) -> Column:
        steps = F.regexp_extract_all(flat, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        window = lambda of: lambda i: F.substr(F.array_join(F.slice(of, i + 1, F.lit(covered)), ""), F.lit(1), F.lit(size))
        return F.transform(F.array(steps), lambda of: F.transform(F.sequence(F.lit(0), _last(F.length(flat), size, overlap)), window(of)))[0]

    return F.when(text.isNotNull(), F.transform(F.array(collapse(text, PY_SPACE)), cut)[0])
