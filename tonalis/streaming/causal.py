"""Causal operators on Structured Streaming: time bins, moving means, peaks, sessions.

Event times must be ``timestamp``; a ``timestamp_ntz`` column is cast (session zone UTC).  Rows
later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files with an event time ``ts``."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def binned(events: DataFrame, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Sum and count of values per time window: key, start, x, rows.  Append mode."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.sum(value).alias("x"), F.count("*").alias("rows")).select(key, F.col("w.start").alias("start"), "x", "rows")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Bursts of events without a longer gap: key, start, end, rows, mean.  Append mode."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(key, s.alias("s")).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows", "mean")


def local_average(samples: DataFrame, M: int, key: str = "track_id") -> DataFrame:
    """Centred moving mean of samples (key, n, x) that come in order: key, n, avg, with a delay of M samples.

    The divisor is always 2 M + 1; before the first sample the signal counts as 0.  The state
    holds the last 2 M + 1 samples.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, values = state.get if state.exists else (-1, [])
        values, rows = list(values), []
        for pdf in batches:
            for n, x in zip(*(pdf.sort_values("n")[c] for c in ("n", "x")), strict=True):
                last = int(n)
                values = [*values, float(x)][-(2 * M + 1) :]
                if last >= M:
                    rows.append((k[0], last - M, sum(values) / (2 * M + 1)))
        state.update((last, values))
        yield pd.DataFrame(rows, columns=[key, "n", "avg"])

    return samples.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, avg double", "last long, x array<double>", "append", GroupStateTimeout.NoTimeout)


def rising_peaks(samples: DataFrame, rel: float, key: str = "track_id") -> DataFrame:
    """Peaks of samples (key, n, x) in order, reported once the signal has risen and then fallen by ``rel``: key, n, x."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, top, at = state.get if state.exists else (float("inf"), float("-inf"), -1)
        rows = []
        for pdf in batches:
            for n, x in zip(*(pdf.sort_values("n")[c] for c in ("n", "x")), strict=True):
                x = float(x)
                if at < 0:
                    low = min(low, x)
                    if x - low >= rel:
                        top, at = x, int(n)
                elif x > top:
                    top, at = x, int(n)
                elif top - x >= rel:
                    rows.append((k[0], at, top))
                    low, top, at = x, float("-inf"), -1
        state.update((low, top, at))
        yield pd.DataFrame(rows, columns=[key, "n", "x"])

    return samples.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, x double", "low double, top double, at long", "append", GroupStateTimeout.NoTimeout)


def novelty(bins: DataFrame, key: str = "track_id", gamma: float = 10.0) -> DataFrame:
    """Rectified difference of compressed bin energies (key, n, x) in order: key, n, x, for each bin after the first."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import math

        before = state.get[0] if state.exists else None
        rows = []
        for pdf in batches:
            for n, x in zip(*(pdf.sort_values("n")[c] for c in ("n", "x")), strict=True):
                now = math.log1p(gamma * float(x))
                if before is not None:
                    rows.append((k[0], int(n) - 1, max(0.0, now - before)))
                before = now
        state.update((before if before is not None else 0.0,))
        yield pd.DataFrame(rows, columns=[key, "n", "x"])

    return bins.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, x double", "before double", "append", GroupStateTimeout.NoTimeout)
