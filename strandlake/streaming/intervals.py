"""Operators over unbounded tables: event-time windows, and runs of overlapping intervals that close when time has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(stream: DataFrame, time: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(by, window_start, window_end, n) of tumbling or sliding windows; rows later than `late` are dropped, state is bounded by it."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = stream.withWatermark(time, late).groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def session_counts(stream: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of rows no further apart than `gap`; sessions that touch are one, unlike runs of intervals."""
    counts = stream.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def runs(stream: DataFrame, key: str, time: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, run_start, run_end, n) of runs of overlapping intervals [time, time + seconds), by key; touching ones are apart.

    The state of a key is its open runs, which the watermark closes. Times are seconds since the epoch in the result.
    """
    schema = f"{key} bigint, run_start bigint, run_end bigint, n bigint"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_: list[tuple[int, int, int]] = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            for s in sorted(b["__s"].tolist()):
                new, rest = (s, s + seconds, 1), []
                for r in open_:
                    if r[0] < new[1] and new[0] < r[1]:
                        new = (min(r[0], new[0]), max(r[1], new[1]), r[2] + new[2])
                    else:
                        rest.append(r)
                open_ = [*rest, new]
        mark = state.getCurrentWatermarkMs() // 1000
        closed = sorted(r for r in open_ if r[1] <= mark)
        open_ = [r for r in open_ if r[1] > mark]
        if open_:
            state.update(tuple(list(x) for x in zip(*open_, strict=True)))
            state.setTimeoutTimestamp(max(min(r[1] for r in open_) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k[0], *r) for r in closed], columns=[key, "run_start", "run_end", "n"])

    rows = stream.withWatermark(time, late).withColumn("__s", F.unix_seconds(time))
    return rows.groupBy(key).applyInPandasWithState(update, schema, "s array<bigint>, e array<bigint>, n array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
