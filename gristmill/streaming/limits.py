"""The anchored rate window over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "key string, call_id long, at_ms long, ok boolean, remaining int, retry_after long"


def decide(calls: list[tuple[int, int]], reset: int, count: int, limit: int, window_ms: int) -> tuple[list[tuple], int, int]:
    """Verdicts of calls (at_ms, call_id) in order, and the window's end and count after them."""
    out = []
    for at, call in sorted(calls):
        if count < 0 or reset <= at:
            reset, count = at + window_ms, 0
        if count < limit:
            count += 1
            out.append((call, at, True, limit - count, None))
        else:
            out.append((call, at, False, None, -(-(reset - at) // 1000)))
    return out, reset, count


def rate_window(calls: DataFrame, limit: int, window_ms: int, late: str = "1 hour") -> DataFrame:
    """Streaming twin of the batch fold; calls: key, call_id, at_ms.  Calls of a key are taken in order within a micro-batch.

    Each key keeps two numbers.  They are dropped once the watermark, ``late`` behind the newest call, has
    passed the window's end: by the calls' own time, so a slow replay decides as the batch fold does.
    Calls that come later than the watermark get no verdict.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, count = state.get if state.exists else (0, -1)
        rows = [(int(a), int(c)) for b in batches for a, c in zip(b["at_ms"], b["call_id"])]
        out, reset, count = decide(rows, reset, count, limit, window_ms)
        state.update((reset, count))
        state.setTimeoutTimestamp(max(reset + 1, state.getCurrentWatermarkMs() + 1))
        df = pd.DataFrame(out, columns=["call_id", "at_ms", "ok", "remaining", "retry_after"])
        df.insert(0, "key", key[0])
        df["remaining"], df["retry_after"] = df["remaining"].astype("Int32"), df["retry_after"].astype("Int64")
        yield df

    # a millisecond on: Spark's first watermark is 0, and what isn't later than the watermark is dropped
    timed = calls.withColumn("gm_at", F.timestamp_millis(F.col("at_ms") + 1)).withWatermark("gm_at", late)
    return timed.groupBy("key").applyInPandasWithState(step, OUT, "reset long, count int", "append", "EventTimeTimeout")
