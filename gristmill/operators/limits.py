"""Admission: rate windows anchored at their first hit, and ordered checks with named reasons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text

MB = 1 << 20
MAX_BYTES, MAX_NAME, MAX_CHUNKS, MAX_DOCUMENTS, MAX_QUESTION = 10 * MB, 255, 500, 100, 2000


def rate_window(calls: DataFrame, limit: int, window_ms: int, count_rejected: bool = False) -> DataFrame:
    """Each call with ok, remaining and retry_after (seconds); calls: key, call_id, at_ms.

    A key's window opens with its first call and ends ``window_ms`` later; the next call opens
    another.  Calls beyond the limit are rejected and (unless ``count_rejected``) not counted;
    what is accepted is the same either way.  A key's calls lie sorted in one task and are read as a
    stream with two numbers of state, whatever their number.
    """
    rows = calls.select("key", F.col("call_id").cast("long").alias("call_id"), F.col("at_ms").cast("long").alias("at_ms"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = fold  # no key yet
        reset = count = 0
        for batch in batches:
            ok, remaining, retry = [], [], []
            for key, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now or reset <= at:
                    now, reset, count = key, at + window_ms, 0
                fits = count < limit
                ok.append(fits)
                remaining.append(limit - count - 1 if fits else None)
                retry.append(None if fits else -(-(reset - at) // 1000))
                count += fits or count_rejected
            added = (pa.array(ok, pa.bool_()), pa.array(remaining, pa.int32()), pa.array(retry, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "ok", "remaining", "retry_after"])

    schema = T.StructType(rows.schema.fields + T._parse_datatype_string("ok boolean, remaining int, retry_after long").fields)
    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "call_id").mapInArrow(fold, schema)


def open_rate_window(calls: DataFrame, limit: int, window_ms: int, failed: Column) -> DataFrame:
    """``rate_window`` where rejected calls count too and calls that the store couldn't answer (``failed``) pass: they are let in uncounted."""
    marked = calls.withColumn("gm_failed", F.coalesce(failed, F.lit(False)))
    judged = rate_window(marked.where("not gm_failed"), limit, window_ms, count_rejected=True)
    through = marked.where("gm_failed").select("key", F.col("call_id").cast("long").alias("call_id"), F.col("at_ms").cast("long").alias("at_ms"))
    return judged.unionByName(through.select("*", F.lit(True).alias("ok"), F.lit(limit).alias("remaining"), F.lit(None).cast("long").alias("retry_after")))


def two_tiers(calls: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """call_id and the tier that rejects it (minute or day, null if none); days are charged for calls that pass the minute only."""
    minute = rate_window(calls, per_minute, 60_000)
    day = rate_window(minute.where("ok").select("key", "call_id", "at_ms"), per_day, 86_400_000)
    late = day.where("not ok").select("call_id", F.lit("day").alias("tier"))
    return minute.join(late, "call_id", "left").select("key", "call_id", "at_ms", F.when(~F.col("ok"), "minute").otherwise(F.col("tier")).alias("rejected_by"))


def upload_problem(n_bytes: Column, media_type: Column, content: Column, n_chunks: Column, owned: Column, dims: Column | None = None, wanted_dims: int = 1536) -> Column:
    """The first reason against an upload; null if it may come in.  ``dims``: length of its chunks' vectors, if there are any yet."""
    return (
        F.when(owned >= MAX_DOCUMENTS, "quota")
        .when(n_bytes == 0, "empty")
        .when(n_bytes > MAX_BYTES, "too_large")
        .when(~media_type.isin(*text.SUPPORTED_TYPES), "unsupported_type")
        .when(text.blank(content), "no_text")
        .when(n_chunks == 0, "no_chunks")
        .when(n_chunks > MAX_CHUNKS, "too_many_chunks")
        .when(F.lit(False) if dims is None else dims != wanted_dims, "bad_dimensions")
    )


def chat_problem(n_messages: Column, conversation_id: Column, question: Column) -> Column:
    """The first reason against a chat request; null if there is none."""
    return (
        F.when(n_messages < 1, "no_messages")
        .when(conversation_id.isNotNull() & ~F.rlike(conversation_id, F.lit(r"^[a-z0-9]{10,64}\z")), "bad_conversation_id")
        .when(text.blank(question), "no_question")
        .when(F.length(question) > MAX_QUESTION, "question_too_long")
    )
