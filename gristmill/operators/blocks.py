"""Exact rankings of many queries over the chunks of their tenant, a block of queries by a block of chunks.

All pairs of a tenant are its ground truth, and their number grows with the square of the rows.  So chunks and
queries are dealt into blocks of bounded size, every pair of blocks is one group of a shuffle (a frequent
tenant has many), numpy scores it, and only each query's k best of a block go on.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight (bytes, or so) of a block of chunks, queries of a block of queries, and scores held at once.
BLOCK_BYTES, BLOCK_QUERIES, SCORES = 1 << 25, 1 << 12, 1 << 22
#: What a score by matrix product may be off, and more.
SLACK = 1e-9


def dealt(chunks: DataFrame, queries: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with gm_block and gm_part, so that each chunk meets each query of its tenant once; weights: tenant and weight of its chunks, a row or more each."""
    asked = queries.groupBy("tenant").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("gm_parts"))
    sizes = weights.groupBy("tenant").agg(F.ceil(F.sum("weight") / BLOCK_BYTES).cast("int").alias("gm_blocks"))
    both = sizes.join(asked, "tenant").select("tenant", F.greatest("gm_blocks", F.lit(1)).alias("gm_blocks"), "gm_parts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    c = chunks.join(both, "tenant").withColumn("gm_block", of("chunk_id", "gm_blocks")).withColumn("gm_part", every("gm_parts")).drop("gm_blocks", "gm_parts")
    q = queries.join(both, "tenant").withColumn("gm_part", of("query_id", "gm_parts")).withColumn("gm_block", every("gm_blocks")).drop("gm_blocks", "gm_parts")
    return c, q


def _joined(chunks: DataFrame, queries: DataFrame, weights: DataFrame, score, added: str) -> DataFrame:
    c, q = dealt(chunks, queries, weights)
    by = ("tenant", "gm_block", "gm_part")
    q = q.select(*[F.col(x).alias(f"q_{x}") for x in q.columns])  # both sides may be of one table
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), *T._parse_datatype_string(added).fields])
    return c.groupBy(*by).cogroup(q.groupBy(*[f"q_{x}" for x in by])).applyInArrow(score(schema.names, _empty(schema)), schema)


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _plain(v: Any) -> Any:
    """An id that sorts as Spark sorts it: a struct by its fields, null first."""
    return (v is not None, tuple(_plain(x) for x in v.values()) if isinstance(v, dict) else v)


def places(ids: pa.Array) -> np.ndarray:
    """Of each id its place in ascending order."""
    n = len(ids)
    if pa.types.is_integer(ids.type) and not ids.null_count:
        order = np.argsort(np.asarray(ids), kind="stable")
    else:
        plain = [_plain(v) for v in ids.to_pylist()]
        order = np.array(sorted(range(n), key=plain.__getitem__), np.int64)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    return at


def by_terms(chunks: DataFrame, queries: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, matches and length of each block's k best: most matching positions over the logarithm of the length, at nine digits, then the lesser id.

    chunks: tenant, chunk_id, length, terms, tfs; queries: tenant, query_id, terms (distinct).
    """

    def score(names: list[str], none: pa.Table):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return none
            ids, length = _column(left, "chunk_id"), np.asarray(_column(left, "length"), np.float64)
            place, scale, n = places(ids), np.log(length + 1.0), left.num_rows
            lists = _column(left, "terms")
            coded = lists.flatten().dictionary_encode()
            code, every = np.asarray(coded.indices), coded.dictionary
            # the block's index: by term, the chunks that have it and how often
            order = np.argsort(code, kind="stable")
            docs = np.repeat(np.arange(n, dtype=np.int64), np.asarray(pc.list_value_length(lists)))[order]
            tfs = np.asarray(_column(left, "tfs").flatten(), np.float64)[order]
            start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(every)))])
            asked = _column(right, "q_terms")
            at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(asked)))])
            wanted = np.asarray(pc.fill_null(pc.index_in(asked.flatten(), value_set=every), -1))
            found: list[tuple[np.ndarray, ...]] = []
            for i in range(right.num_rows):
                terms = [t for t in wanted[at[i] : at[i + 1]] if t >= 0]
                if not terms:
                    continue
                hit = np.concatenate([docs[start[t] : start[t + 1]] for t in terms])
                sums = np.bincount(hit, np.concatenate([tfs[start[t] : start[t + 1]] for t in terms]), n)
                some = np.flatnonzero(sums)
                key = np.floor(sums[some] / scale[some] * 1e9 + 0.5)
                if len(some) > k:
                    best = key >= np.partition(key, -k)[-k]
                    some, key = some[best], key[best]
                some = some[np.lexsort((place[some], -key))[:k]]
                found.append((np.full(len(some), i), some, sums[some]))
            if not found:
                return none
            q, c, s = (np.concatenate(x) for x in zip(*found))
            return pa.Table.from_arrays([_column(right, "q_query_id").take(pa.array(q)), ids.take(pa.array(c)), pa.array(s.astype(np.int64)), pa.array(length[c].astype(np.int32))], names=names)

        return run

    return _joined(chunks, queries, weights, score, "matches long, length int")


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros, and their numbers of elements; -1 for one with a null in it."""
    size = np.asarray(pc.list_value_length(lists), np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(pc.fill_null(flat, 0.0), np.float64)
    if flat.null_count:
        size[row[np.asarray(flat.is_null())]] = -1
    return out, size


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first element to the last, as a fold over the arrays would."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def by_cosine(chunks: DataFrame, queries: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id and similarity of each block's k nearest by cosine; null for vectors of other sizes or with a null, NaN (which comes first) beside one of zeros.

    A matrix product finds who may be among the nearest; their similarities are then computed in a fixed
    order, so that equal vectors tie.  chunks: tenant, chunk_id, embedding; queries: tenant, query_id, embedding.
    """

    def score(names: list[str], none: pa.Table):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return none
            ids, n = _column(left, "chunk_id"), left.num_rows
            place = places(ids)
            (c, c_size), (q, q_size) = _matrix(_column(left, "embedding")), _matrix(_column(right, "q_embedding"))
            width = max(c.shape[1], q.shape[1])
            c, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (c, q))
            c_norm, q_norm = _dots(c, c), _dots(q, q)
            odd = len({*c_size.tolist(), *q_size.tolist()}) > 1 or -1 in c_size or not (c_norm.all() and q_norm.all()) or not (np.isfinite(c_norm).all() and np.isfinite(q_norm).all())
            with np.errstate(all="ignore"):
                unit, asked, found = c / np.sqrt(c_norm)[:, None], q / np.sqrt(q_norm)[:, None], []
                for i in range(0, len(q), step := max(1, SCORES // n)):
                    near = asked[i : i + step] @ unit.T
                    if odd:  # NaN is above all numbers, and no similarity below them
                        near[np.isnan(near)] = np.inf
                        near[(q_size[i : i + step, None] != c_size) | (c_size < 0)] = -np.inf
                    if n > k:
                        may = near >= np.partition(near, n - k, axis=1)[:, n - k, None] - SLACK
                    else:
                        may = np.ones(near.shape, bool)
                    a, b = np.nonzero(may)
                    exact = np.empty(len(a))
                    for j in range(0, len(a), part := SCORES // 8):
                        x, y = a[j : j + part] + i, b[j : j + part]
                        exact[j : j + part] = np.clip(_dots(q[x], c[y]) / np.sqrt(q_norm[x] * c_norm[y]), -1.0, 1.0)
                    if odd:
                        exact[np.isnan(exact)] = np.inf
                        exact[near[a, b] == -np.inf] = -np.inf
                    order = np.lexsort((place[b], -exact, a))
                    a, b, exact = a[order], b[order], exact[order]
                    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(near)))])
                    top = np.arange(len(a)) - first[a] < k
                    found.append((a[top] + i, b[top], exact[top]))
            a, b, s = (np.concatenate(x) for x in zip(*found))
            shown = pa.array(np.where(np.isposinf(s), np.nan, s), mask=np.isneginf(s), from_pandas=False)
            return pa.Table.from_arrays([_column(right, "q_query_id").take(pa.array(a)), ids.take(pa.array(b)), shown], names=names)

        return run

    return _joined(chunks, queries, weights, score, "similarity double")


def text_weights(chunks: DataFrame, content: Column) -> DataFrame:
    """What texts weigh, by tenant."""
    return chunks.select("tenant", (F.coalesce(F.octet_length(content), F.lit(0)).cast("long") + 256).alias("weight"))
