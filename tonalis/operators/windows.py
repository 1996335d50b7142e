"""Moving and cumulative operators on signals and frames as window expressions.

Signals are dense: a row for each sample index.  Windows are partitioned by track (and bin), so
tracks run in parallel; for one very long track use ``chunked``, which cuts it into chunks with
a halo as wide as the window reaches.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("track_id",)


def over(by=BY, order: str = "n"):
    return Window.partitionBy(*by).orderBy(order)


def whole(by=BY):
    return Window.partitionBy(*by)


def same_frame(length: int) -> tuple[int, int]:
    """Rows before and after that a centred kernel of this length covers."""
    return -(length // 2), (length - 1) // 2


def moving_sum(x, length: int, by=BY, order: str = "n") -> Column:
    """Zero-extended moving sum, centred as a 'same' convolution."""
    return F.sum(x).over(over(by, order).rowsBetween(*same_frame(length)))


def local_average(df: DataFrame, M: int, x: str = "x", out: str = "avg", by=BY, order: str = "n") -> DataFrame:
    """Mean over M samples on either side; the divisor stays 2M + 1 at the borders."""
    return df.withColumn(out, F.sum(x).over(over(by, order).rowsBetween(-M, M)) / (2 * M + 1))


def power_db(df: DataFrame, Fs: float, win_len_sec: float = 0.1, power_ref: float = 1e-12, x: str = "x", by=BY, order: str = "n") -> DataFrame:
    """Sliding signal power in decibels."""
    from ..functions.columns import power_to_db

    length = round(win_len_sec * Fs)
    return df.withColumn("power_db", power_to_db(moving_sum(F.col(x) * F.col(x), length, by, order) / length, power_ref))


def envelope(df: DataFrame, win_len_sec: float = 0.01, Fs: float = 4000, x: str = "x", by=BY, order: str = "n") -> DataFrame:
    """Sliding maximum of the magnitude, maximum and minimum over [n - h, n + h)."""
    half = round(win_len_sec * Fs * 0.5)
    if half < 1:
        raise ValueError("the window is shorter than two samples")
    w = over(by, order).rowsBetween(-half, half - 1)
    return df.withColumns({"env": F.max(F.abs(x)).over(w), "env_upper": F.max(x).over(w), "env_lower": F.min(x).over(w)})


def fir(df: DataFrame, kernel, x: str = "x", out: str = "y", by=BY, order: str = "n", edge: str = "zero") -> DataFrame:
    """Weighted moving sum with a kernel centred at (M - 1) // 2.

    ``edge``: ``zero`` extends with zeros, ``reflect`` mirrors the samples with the border repeated.
    """
    kernel = [float(k) for k in kernel]
    before, after = same_frame(len(kernel))
    if edge == "reflect":
        wide = reflected(df, max(-before, after), by, order)
        return fir(wide, kernel, x, out, by, "_pos").where("_own").drop("_pos", "_own")
    w = over(by, order)
    # convolution flips the kernel: the sample at n + d has weight kernel[center - d]
    total, center = None, (len(kernel) - 1) // 2
    for d in range(before, after + 1):
        if 0 <= center - d < len(kernel) and kernel[center - d]:
            part = F.coalesce(F.lag(x, -d).over(w) if d <= 0 else F.lead(x, d).over(w), F.lit(0.0)) * kernel[center - d]
            total = part if total is None else total + part
    return df.withColumn(out, F.lit(0.0) if total is None else total)


def reflected(df: DataFrame, reach: int, by, order: str = "n") -> DataFrame:
    """A dense signal with ``reach`` mirrored samples on both sides (the border repeated).

    Adds the place ``_pos`` and ``_own`` (not mirrored); short signals are mirrored repeatedly.
    """
    size = F.max(order).over(whole(by)) + 1
    turns = F.sequence(-F.floor((F.lit(reach) + F.col("_N") * 2) / (F.col("_N") * 2)), F.floor((F.lit(reach) + F.col("_N") * 2) / (F.col("_N") * 2)))
    places = F.flatten(F.transform(turns, lambda j: F.array(F.col(order) + j * F.col("_N") * 2, j * F.col("_N") * 2 - 1 - F.col(order))))
    out = df.withColumn("_N", size).withColumn("_pos", F.explode(places)).where(f"_pos >= {-reach} and _pos < _N + {reach}")
    return out.withColumn("_own", F.col("_pos") == F.col(order)).drop("_N")


def moving_median(df: DataFrame, length: int, v: str = "v", out: str = "median", by=("track_id", "k"), order: str = "n", edge: str = "zero") -> DataFrame:
    """Median over a centred window on a dense grid.

    ``zero`` pads with zeros (odd lengths); ``reflect`` mirrors and takes the upper middle.
    """
    before, after = length // 2, (length - 1) // 2 if length % 2 == 0 else length // 2
    w = over(by, order)
    if edge == "zero":
        got = F.collect_list(v).over(w.rowsBetween(-before, after))
        padded = F.concat(got, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(got)))
        return df.withColumn(out, F.get(F.array_sort(padded), F.lit(length // 2)))
    wide = reflected(df, max(before, after), by, order)
    got = F.collect_list(v).over(over(by, "_pos").rowsBetween(-before, after))
    return wide.withColumn(out, F.get(F.array_sort(got), F.lit(length // 2))).where("_own").drop("_pos", "_own")


def hann_periodic(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)


def hann_symmetric(n: int) -> np.ndarray:
    return np.hanning(n)


def smooth_downsample(df: DataFrame, filt_len: int = 41, down_sampling: int = 10, w_type: str = "boxcar", v: str = "v", by=("track_id", "k"), order: str = "n") -> DataFrame:
    """Smooth each bin along time (divided by the length whatever the window) and keep every d-th frame."""
    if w_type == "boxcar":
        out = df.withColumn(v, moving_sum(v, filt_len, by, order) / filt_len)
    elif w_type in ("hann", "hanning"):
        out = fir(df, hann_periodic(filt_len) / filt_len, v, v, by, order)
    else:
        raise ValueError(f"no window of type {w_type}")
    return downsample(out, down_sampling, order)


def median_downsample(df: DataFrame, filt_len: int = 41, down_sampling: int = 10, v: str = "v", by=("track_id", "k"), order: str = "n") -> DataFrame:
    if filt_len % 2 == 0:
        raise ValueError("the median filter's length must be odd")
    return downsample(moving_median(df, filt_len, v, v, by, order), down_sampling, order)


def downsample(df: DataFrame, factor: int, order: str = "n") -> DataFrame:
    return df.where(F.col(order) % factor == 0).withColumn(order, F.expr(f"`{order}` div {factor}"))


def half_wave(x) -> Column:
    return F.greatest(F.lit(0.0), x)


def difference(x: str, by=BY, order: str = "n") -> Column:
    """Forward difference; 0 at the last sample."""
    return F.coalesce(F.lead(x).over(over(by, order)) - F.col(x), F.lit(0.0))


def normalize_by_max(x, by=BY) -> Column:
    """Divide by the track's maximum if that is above 0."""
    top = F.max(x).over(whole(by))
    return F.when(top > 0, F.col(x) / top).otherwise(F.col(x))


def exclusive_prefix_sum(x, by=BY, order: str = "n") -> Column:
    return F.coalesce(F.sum(x).over(over(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def peaks_simple(df: DataFrame, threshold: float | None = None, x: str = "x", by=BY, order: str = "n") -> DataFrame:
    """Strict local maxima of at least ``threshold`` (default: the minimum); border samples are none."""
    w = over(by, order)
    out = df.withColumns({"_p": F.lag(x).over(w), "_q": F.lead(x).over(w)}).where(f"_p < `{x}` and _q < `{x}`").drop("_p", "_q")
    return out if threshold is None else out.where(F.col(x) >= threshold)


def _origin_frame(pre: float, post: float, fps: float) -> tuple[int, int, int]:
    size = int((pre + post) * fps) + 1
    low = size // 2 + int((pre - post) * fps / 2)
    return size, low, size - 1 - low


def peaks_boeck(df: DataFrame, threshold: float = 0.5, fps: float = 100, combine: int = 0, pre_avg: float = 12, post_avg: float = 6, pre_max: float = 6, post_max: float = 6, x: str = "x", by=BY, order: str = "n") -> DataFrame:
    """Samples that equal the moving maximum and exceed the moving mean by ``threshold``.

    Windows are given in seconds before and after and are padded with zeros.  ``combine``:
    frames after a reported onset in which no other is reported.  Adds ``time`` and ``score``.
    """
    w = over(by, order)
    size, low, high = _origin_frame(pre_max, post_max, fps)
    rows = F.count("*").over(w.rowsBetween(-low, high))
    top = F.max(x).over(w.rowsBetween(-low, high))
    top = F.when(rows < size, F.greatest(top, F.lit(0.0))).otherwise(top)
    span, alow, ahigh = _origin_frame(pre_avg, post_avg, fps)
    mean = F.sum(x).over(w.rowsBetween(-alow, ahigh)) / span if span > 1 else F.lit(0.0)
    marked = df.withColumns({"_top": top if size > 1 else F.col(x), "_mean": mean})
    found = marked.where(f"`{x}` = _top and `{x}` >= _mean + {float(threshold)} and `{x}` != 0")
    found = found.withColumns({"time": F.col(order) / float(fps), "score": F.col(x) - F.col("_mean")}).drop("_top", "_mean")
    return greedy_gap(found, combine, by, order) if combine else found


def greedy_gap(df: DataFrame, gap: int, by=BY, order: str = "n") -> DataFrame:
    """Keep a position only if it is more than ``gap`` after the last one kept (0 at first)."""
    places = df.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, n: F.when(n > s["last"] + gap, F.struct(n.cast("long").alias("last"), F.concat(s["kept"], F.array(n.cast("long"))).alias("kept"))).otherwise(s)
    kept = places.select(*by, F.explode(F.aggregate("_all", start, step, lambda s: s["kept"])).alias(order))
    return df.join(kept, [*by, order], "left_semi")


def gaussian(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def peaks_msaf(df: DataFrame, median_len: int = 16, offset_rel: float = 0.05, sigma: float = 4.0, x: str = "x", by=BY, order: str = "n") -> DataFrame:
    """Gaussian smoothing, then strict maxima above a local median plus a share of the mean."""
    smooth = fir(df, gaussian(sigma), x, "_s", by, order, "reflect").withColumn("_o", F.avg("_s").over(whole(by)) * offset_rel)
    local = moving_median(smooth, median_len, "_s", "_m", by, order, "reflect")
    w = over(by, order)
    found = local.withColumns({"_p": F.lag("_s").over(w), "_q": F.lead("_s").over(w)}).where("_p < _s and _q < _s and _s > _m + _o")
    return found.drop("_p", "_q", "_m", "_o", "_s")


def chunked(df: DataFrame, size: int, halo: int, by=BY, order: str = "n") -> DataFrame:
    """Cut long tracks into chunks with a halo on both sides: adds ``chunk`` and ``own``.

    Run a window operator by (track, chunk), then keep the rows with ``own``; ``halo`` must be
    at least as far as the operator's window reaches.
    """
    n = F.col(order)
    low, high = F.floor((n - halo) / size), F.floor((n + halo) / size)
    out = df.withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    return out.withColumn("own", F.floor(n / size) == F.col("chunk"))


def frame_count(length: int, N: int, H: int) -> int:
    return math.floor((length - N) / H) + 1


def frames_of(df: DataFrame, N: int, H: int, x: str = "x", by=BY, order: str = "n", pad: int = 0) -> DataFrame:
    """Sliding frames: a row (track, frame, i, x) for each sample a frame covers, frames whole only.

    ``pad`` zeros count before and after the signal; zero samples are not made into rows.
    """
    at = F.col(order) + pad
    total = F.max(order).over(whole(by)) + 1 + 2 * pad
    last = F.floor((total - N) / H)
    low = F.greatest(F.ceil((at - N + 1) / H), F.lit(0))
    high = F.least(F.floor(at / H), last)
    out = df.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("frame", F.explode(F.sequence("_low", "_high")))
    return out.withColumn("i", F.col(order) + pad - F.col("frame") * H).drop("_low", "_high")
