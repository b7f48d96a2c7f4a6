"""Terms of texts counted over Arrow batches.

Words of a batch become numbers by one dictionary; stop words are left out, words stemmed and
wanted terms chosen once for each word of the dictionary, and counts come out of a sort of numbers,
so no Python object exists per word and no row per word crosses a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text

#: Words that one numpy pass works on; a longer single text makes a pass of its own.
PASS_WORDS = 1 << 19


def raw_words(c: Column) -> Column:
    """What may be a lexical token; ``text.tokens`` are those of two characters or more that are no stop words."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), 0)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Parts of a batch with a bounded number of words: rows, words of each row, all words."""
    lists = batch.column(batch.num_columns - 1)
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PASS_WORDS, "right")) - 1)
        yield batch.slice(i, j - i), n[i:j], lists.slice(i, j - i).flatten()
        i = j


def _vocabulary(words: pa.Array, stop: pa.Array, least: int, form: Callable[[str], str] | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word whether it stays, the number of its term, and the terms."""
    coded = words.dictionary_encode()
    every, code = coded.dictionary, np.asarray(coded.indices, np.int64)
    if not len(every):
        return np.zeros(0, bool), code, every
    stays = ~np.asarray(pc.is_in(every, value_set=stop)) & (np.asarray(pc.utf8_length(every)) >= least)
    kept = stays[code]
    if form is not None:
        # words that share a form share its number
        formed = pa.array([form(w) if s else "" for w, s in zip(every.to_pylist(), stays)], pa.string()).dictionary_encode()
        every, code = formed.dictionary, np.asarray(formed.indices, np.int64)[code]
    return kept, code, every


def counted(
    rows: DataFrame,
    words: Column,
    stop: list[str] | None = None,
    least: int = 2,
    form: Callable[[str], str] | None = None,
    wanted: list[str] | None = None,
    exploded: bool = False,
) -> DataFrame:
    """The rows with length (words that stay; null for a null text) and their terms with counts.

    ``exploded``: a row for each term (term, tf), none for rows without any; else a row stays one row, with the
    arrays terms and tfs.  ``form`` makes a word's term; ``wanted``: other terms count for the length only.
    """
    out = "length int, term string, tf long" if exploded else "length int, terms array<string>, tfs array<int>"
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "text"), *T._parse_datatype_string(out).fields])
    stop_words = list(text.STOP_WORDS if stop is None else stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop_, chosen = pa.array(stop_words, pa.string()), None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            for part, n, flat in _parts(batch):
                stays, code, every = _vocabulary(flat.cast(pa.string()), stop_, least, form)
                row = np.repeat(np.arange(len(n)), n)[stays]
                code, size = code[stays], max(1, len(every))
                length = pa.array(np.bincount(row, minlength=len(n)).astype(np.int32), pa.int32(), mask=np.asarray(part.column(part.num_columns - 1).is_null()))
                if chosen is not None:
                    ok = np.asarray(pc.is_in(every, value_set=chosen), bool)[code]
                    row, code = row[ok], code[ok]
                key, tf = np.unique(row * size + code, return_counts=True)
                row, terms = key // size, every.take(pa.array(key % size, pa.int64()))
                keep = part.columns[:-1]
                if exploded:
                    if len(row):
                        where = pa.array(row, pa.int64())
                        yield pa.RecordBatch.from_arrays([*(k.take(where) for k in keep), length.take(where), terms, pa.array(tf.astype(np.int64))], names=schema.names)
                    continue
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*keep, length, *lists], names=schema.names)

    return rows.select(*[c for c in rows.columns if c != "text"], words.alias("gm_words")).mapInArrow(run, schema)
