"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    """The columns' fields, all nullable."""
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str, keep: tuple[str, ...] = ("doc_id",), read: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``mapInArrow`` over only the columns that are read; its rows have the kept columns and the added ones."""
    schema = T.StructType(fields(df, *keep) + T._parse_datatype_string(added).fields)
    return df.select(*read).mapInArrow(f, schema)


def record(batch: pa.RecordBatch, keep: tuple[str, ...], **columns: object) -> pa.RecordBatch:
    """The kept columns of a batch beside new ones."""
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    arrays += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *columns])


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says; only a local session without the setting (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder: lineage ends here and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle and checkpoint files of rows that nothing refers to any more.

    Spark deletes them once the driver's garbage is collected, which may be long after an
    iterative job has left them behind.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def empty_text(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def filter_arrow(df: DataFrame, keep: Callable[[], Callable[[pa.Array], "pa.Array"]], limit: int = 1 << 20) -> DataFrame:
    """The rows, with all their columns, whose text passes; ``keep`` is called once in each task and gives a mask for texts."""
    from . import _text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep()
        for batch, texts in _text.slices(batches, limit=limit):
            yield batch.filter(pa.array(passes(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)
