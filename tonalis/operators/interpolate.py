"""Interpolation and resampling between a track's samples (bracketing by windows, no inequality join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import fir, gaussian, normalize_by_max

BY = ("track_id",)


def at_times(samples: DataFrame, grid: DataFrame, t: str = "t", x: str = "x", by=BY, kind: str = "linear", extrapolate: bool = True) -> DataFrame:
    """Values at the grid's times: the grid's columns and ``x``.

    Samples (track, t, x) and grid rows (track, t, ...) are united and each grid row looks up the
    samples around it.  ``linear`` extends the border segments if ``extrapolate``, else null
    outside; ``nearest`` takes the closer sample, the earlier one on a tie.
    """
    extra = [c for c in grid.columns if c not in (*by, t)]
    w = Window.partitionBy(*by).orderBy(t)
    knots = samples.select(*by, F.col(t), F.struct(F.col(t).alias("t"), F.col(x).alias("x")).alias("_s"))
    seg = knots.withColumns({"_n": F.lead("_s").over(w), "_p": F.lag("_s").over(w), "_pp": F.lag("_s", 2).over(w)})
    seg = seg.select(*by, t, F.struct("_s", "_n", "_p", "_pp").alias("_k"), *[F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("_kind"))
    asked = grid.select(*by, t, F.lit(None).cast(seg.schema["_k"].dataType).alias("_k"), *extra, F.lit(1).alias("_kind"))
    both = seg.unionByName(asked)
    order = Window.partitionBy(*by).orderBy(t, "_kind")
    before = F.last("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # only needed ahead of the first sample, which is the track's first: a frame over the whole track is computed once
    after = F.first("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = both.withColumns({"_b": before, "_a": after}).where("_kind = 1")
    left = F.coalesce(F.when(F.col("_b._n").isNotNull(), F.col("_b._s")), F.col("_b._p"), F.col("_b._s"), F.col("_a._s"))
    right = F.coalesce(F.when(F.col("_b._n").isNotNull(), F.col("_b._n")), F.when(F.col("_b").isNotNull(), F.col("_b._s")), F.col("_a._n"), F.col("_a._s"))
    at = F.col(t)
    if kind == "nearest":
        value = F.when(F.abs(at - left["t"]) <= F.abs(right["t"] - at), left["x"]).otherwise(right["x"])
    else:
        slope = F.coalesce(F.try_divide(right["x"] - left["x"], right["t"] - left["t"]), F.lit(0.0))
        value = left["x"] + slope * (at - left["t"])
        if not extrapolate:
            inside = F.col("_b").isNotNull() & (F.col("_b._n").isNotNull() | (F.col("_b._s.t") == at))
            value = F.when(inside, value)
    return out.withColumn(x, value).select(*by, t, *extra, x)


def time_grid(samples: DataFrame, count: Column, step, by=BY, out: str = "t") -> DataFrame:
    """Rows (track, n, t) with t = n * step; ``count`` is an aggregate of the track's samples."""
    sizes = samples.groupBy(*by).agg(count.cast("long").alias("_count"))
    return sizes.where("_count > 0").select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)).alias("n")).withColumn(out, F.col("n") * step)


def sampling_equidistant(samples: DataFrame, Fs_2: float, dur: float | None = None, by=BY) -> DataFrame:
    """Resample (track, t, x) to a rate by linear interpolation with extrapolation: track, n, t, x."""
    count = F.lit(int(Fs_2 * dur)) if dur is not None else F.floor(F.count("*") * F.element_at(F.array_sort(F.collect_list("t")), 2) * Fs_2)
    return at_times(samples, time_grid(samples, count, 1.0 / Fs_2, by), by=by).select(*by, "n", "t", "x")


def reconstruction_sinc(samples: DataFrame, grid: DataFrame, Fs: float, by=BY) -> DataFrame:
    """Whittaker-Shannon reconstruction at the grid's times; every sample of a track counts at each."""
    import math

    z = (F.col("t") * Fs - F.col("_n")) * math.pi
    weight = F.when(z == 0, 1.0).otherwise(F.sin(z) / z)
    own = samples.select(*by, F.col("n").alias("_n"), F.col("x").alias("_x"))
    return grid.join(own, [*by]).groupBy(*grid.columns).agg(F.sum(F.col("_x") * weight).alias("x"))


def resample_signal(df: DataFrame, Fs_in: float, Fs_out: float = 100, norm: bool = True, time_max_sec: float | None = None, sigma: float | None = None, x: str = "x", by=BY) -> DataFrame:
    """Optional Gaussian smoothing, linear interpolation to the new rate, zero at the end of a longer axis."""
    if sigma is not None:
        df = fir(df, gaussian(sigma), x, x, by, "n", "reflect")
    times = df.select(*by, (F.col("n") / float(Fs_in)).alias("t"), F.col(x).alias("x"))
    end = F.max("t") if time_max_sec is None else F.lit(float(time_max_sec))
    grid = time_grid(times, F.ceil(end * Fs_out), 1.0 / Fs_out, by).withColumn("t", F.col("n") / float(Fs_out))
    beyond = grid.groupBy(*by).agg(F.max("t").alias("_g")).join(times.groupBy(*by).agg(F.max("t").alias("_t")), [*by]).where("_g > _t")
    samples = times.unionByName(beyond.select(*by, F.col("_g").alias("t"), F.lit(0.0).alias("x")))
    out = at_times(samples, grid, by=by).select(*by, "n", "x")
    return out.withColumn("x", normalize_by_max("x", by)) if norm else out


def average_novelty(df: DataFrame, rates: dict[str, float], time_max_sec: float, Fs_out: float = 100, norm: bool = True, sigma: float | None = None, curve: str = "track_id") -> DataFrame:
    """Resample curves of different rates to one grid; adds their mean as the curve ``average``."""
    parts = None
    for name, rate in rates.items():
        one = resample_signal(df.where(F.col(curve) == name), rate, Fs_out, norm, time_max_sec, sigma, by=(curve,))
        parts = one if parts is None else parts.unionByName(one)
    mean = parts.groupBy("n").agg(F.avg("x").alias("x")).select(F.lit("average").alias(curve), "n", "x")
    return parts.unionByName(mean)


def scale_tempo_sequence(frames: DataFrame, factor: float = 1.0, by=("track_id", "k")) -> DataFrame:
    """Stretch each bin linearly to round(N * factor) frames (half to even)."""
    sizes = frames.groupBy(*by).agg((F.max("n") + 1).alias("_N"))
    grid = sizes.withColumn("_M", F.rint(F.col("_N") * factor).cast("long")).where("_M > 0").select(*by, "_N", "_M", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_M") - 1)).alias("n"))
    t = F.when(F.col("_M") > 1, F.col("n") * (F.col("_N") - 1) / (F.col("_M") - 1)).otherwise(F.lit(0.0))
    samples = frames.select(*by, F.col("n").cast("double").alias("t"), F.col("v").alias("x"))
    return at_times(samples, grid.select(*by, "n", t.alias("t")), by=by).select(*by, "n", F.col("x").alias("v"))


def compute_f_coef_linear(spark, N: int, Fs: float, rho: int = 1) -> DataFrame:
    L = rho * N
    return spark.range(L // 2 + 1).select(F.col("id").cast("int").alias("k"), (F.col("id") * Fs / L).alias("freq"))


def compute_f_coef_log(spark, R: float, F_min: float, F_max: float) -> DataFrame:
    import math

    count = math.ceil(1200 * math.log2(F_max / F_min) / R)
    return spark.range(count).select(F.col("id").cast("int").alias("k"), (F.pow(F.lit(2.0), F.col("id") * R / 1200) * F_min).alias("freq"), (F.col("id") * float(R)).alias("cents"))
