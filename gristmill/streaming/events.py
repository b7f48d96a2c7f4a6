"""Streams of reply deltas and of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(deltas: DataFrame) -> DataFrame:
    """Whole replies of deltas (reply_id, seq, at_ms, delta, started_ms): text, ttft_ms and total_ms; batch or stream (complete mode)."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    return deltas.groupBy("reply_id").agg(
        F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("reply"),
        (F.min("at_ms") - F.min("started_ms")).alias("ttft_ms"),
        (F.max("at_ms") - F.min("started_ms")).alias("total_ms"),
    )


def canned(text: str) -> list[dict]:
    """The events of a reply that was ready."""
    return [{"type": "start"}, {"type": "delta", "delta": text}, {"type": "end"}]


def persist_turns(turns: DataFrame, path: str, checkpoint: str):
    """Writes finished turns (conv_id, turn, user_text, reply, at_ms) once, the user's message always before the reply to it.

    Both are written in one file of one batch, the reply a millisecond later; a turn without a reply (an error, or
    one that was broken off) leaves the user's message.
    """
    user = F.struct(F.lit("user").alias("role"), F.col("user_text").alias("text"), F.col("at_ms").alias("at_ms"))
    reply = F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("text"), (F.col("at_ms") + 1).alias("at_ms"))
    both = turns.select("conv_id", "turn", F.explode(F.when(F.length("reply") > 0, F.array(user, reply)).otherwise(F.array(user))).alias("m"))
    return append_batches(both.select("conv_id", "turn", "m.*"), path, checkpoint)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums in event-time windows; late rows are dropped after the watermark.  Not of the reference, a plain addition."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Sessions of a user by a gap between events."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch once: a batch's folder is named by its number and overwritten if it is tried again."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
