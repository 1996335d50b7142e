"""Cost and similarity matrices in long form (pair, n, m, v) and what is computed on them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .windows import over, whole

PAIR = ("pair_id",)


def vectors(frames: DataFrame, keys=("track_id",)) -> DataFrame:
    """Long frames to one array per frame: keys, n, vec (ascending k)."""
    return frames.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("vec"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pairwise(x: DataFrame, y: DataFrame, metric: str = "euclidean", pairs: DataFrame | None = None) -> DataFrame:
    """All frames of X against all of Y for each pair of tracks: pair_id, n, m, v.

    ``x`` and ``y``: (track_id, n, vec).  Without ``pairs`` (pair_id, x_id, y_id) tracks pair
    with the track of the same name.  Cells are made in bands of rows (``blocks``) and not moved.
    """
    return B.pairwise(x, y, metric, pairs)


def filter_diag(cells: DataFrame, L: int, direction: int = 0, by=PAIR) -> DataFrame:
    """Mean along each diagonal over L cells ahead (0) or behind (1); zeros beyond the matrix."""
    w = Window.partitionBy(*by, "_d").orderBy("n")
    w = w.rowsBetween(0, L - 1) if direction == 0 else w.rowsBetween(-(L - 1), 0)
    return cells.withColumn("_d", F.col("m") - F.col("n")).withColumn("v", F.sum("v").over(w) / L).drop("_d")


def tempo_rel_set(tempo_min: float, tempo_max: float, num: int) -> list[float]:
    low, high = math.log(tempo_min), math.log(tempo_max)
    return [math.exp(low + (high - low) * i / max(1, num - 1)) for i in range(num)]


def filter_diag_mult(cells: DataFrame, L: int = 1, tempi: list[float] = (1.0,), direction: int = 0, by=PAIR) -> DataFrame:
    """Diagonal smoothing along several slopes: columns resampled per tempo, smoothed, sampled back; the maximum counts."""
    sized = cells.withColumn("_M", F.max("m").over(whole(by)) + 1)
    out = None
    for tempo in tempi:
        if tempo == 1:  # columns stay in place
            one = (filter_diag(cells, L, direction, by) if L > 1 else cells).select(*by, "n", "m", "v")
            out = one if out is None else out.unionByName(one)
            continue
        wide = F.ceil(F.col("_M") / float(tempo))
        columns = sized.select(*by, "_M").distinct().select(*by, "_M", wide.alias("_W"))
        # column r of the stretched matrix shows column max(0, round((r + 1) / W * M) - 1)
        source = columns.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_W") - 1)))
        source = source.withColumn("m", F.greatest(F.rint((F.col("_r") + 1) / F.col("_W") * F.col("_M")) - 1, F.lit(0.0)).cast("long"))
        stretched = cells.join(source.select(*by, "m", "_r"), [*by, "m"]).select(*by, "n", F.col("_r").alias("m"), "v")
        smooth = filter_diag(stretched, L, direction, by).withColumnRenamed("m", "_r")
        back = columns.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_M") - 1)))
        back = back.withColumn("_r", F.greatest(F.rint((F.col("m") + 1) / F.col("_M") * F.col("_W")) - 1, F.lit(0.0)).cast("long"))
        one = smooth.join(back.select(*by, "m", "_r"), [*by, "_r"]).select(*by, "n", "m", "v")
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*by, "n", "m").agg(F.greatest(F.max("v"), F.lit(0.0)).alias("v"))


def shift_vectors(x: DataFrame, shift: int | Column) -> DataFrame:
    """Roll each frame's array so that bin k moves to k + shift."""
    s = F.pmod(F.lit(shift) if isinstance(shift, int) else shift, F.size("vec"))
    return x.withColumn("vec", F.concat(F.slice("vec", F.size("vec") - s + 1, s), F.slice("vec", F.lit(1), F.size("vec") - s)))


def sm_ti(x: DataFrame, y: DataFrame, L: int = 1, tempi: list[float] = (1.0,), shifts: list[int] = (0,), direction: int = 2) -> DataFrame:
    """Transposition-invariant similarity: maximum over shifts of the smoothed matrices, and its first shift: pair_id, n, m, v, shift."""
    directions = (0, 1) if direction == 2 else (direction,)
    return B.smoothed(x, y, L, tuple(map(float, tempi)), tuple(int(t) for t in shifts), directions)


def _order_statistic(cells: DataFrame, index: Column, part, out: str) -> DataFrame:
    """Adds the value at a place of the ascending order within a partition; null beyond its end."""
    w = Window.partitionBy(*part)
    rank = F.row_number().over(w.orderBy("v")) - 1
    ranked = cells.withColumns({"_rank": rank, "_size": F.count("*").over(w)})
    return ranked.withColumn(out, F.max(F.when(F.col("_rank") == index, F.col("v"))).over(w)).drop("_rank", "_size")


def threshold(cells: DataFrame, thresh, strategy: str = "absolute", scale: bool = False, penalty: float = 0.0, binarize: bool = False, by=PAIR) -> DataFrame:
    """Cells below the threshold become 0; optional scaling of the rest to [0, 1], a penalty for zeros, binarising.

    ``absolute``: a value; ``relative``: the share of cells kept; ``local``: shares of each row and column.
    """
    v = F.col("v")
    if strategy == "absolute":
        out = cells.withColumn("v", F.when(v < thresh, 0.0).otherwise(v))
    elif strategy == "relative":
        t = _order_statistic(cells, F.rint(F.col("_size") * (1 - thresh)), by, "_t")
        out = t.withColumn("v", F.when(v >= F.col("_t"), v).otherwise(0.0)).drop("_t")
    elif strategy == "local":
        t = _order_statistic(cells, F.rint(F.col("_size") * (1 - thresh[0])), (*by, "n"), "_r")
        t = _order_statistic(t, F.rint(F.col("_size") * (1 - thresh[1])), (*by, "m"), "_c")
        out = t.withColumn("v", F.when((v >= F.col("_r")) & (v >= F.col("_c")), v).otherwise(0.0)).drop("_r", "_c")
    else:
        raise ValueError(f"no strategy {strategy}")
    if scale:
        w = whole(by)
        low, high = F.coalesce(F.min(F.when(v > 0, v)).over(w), F.lit(0.0)), F.max("v").over(w)
        out = out.withColumns({"_l": low, "_h": high})
        scaled = F.when(v == 0, float(penalty)).otherwise((v - F.col("_l")) / (F.col("_h") - F.col("_l")))
        out = out.withColumn("v", F.when(F.col("_h") > F.col("_l"), scaled).otherwise(v)).drop("_l", "_h")
    return out.withColumn("v", F.when(v > 0, 1.0).when(v < 0, 0.0).otherwise(v)) if binarize else out


def normalize_diagonal(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", F.when(F.col("n") == F.col("m"), 1.0).otherwise(F.col("v")))


def time_lag(cells: DataFrame, circular: bool = True, by=PAIR) -> DataFrame:
    """Re-key a square matrix by lag: pair_id, lag, m, v."""
    size = F.max("n").over(whole(by)) + 1
    lag = F.col("n") - F.col("m")
    lag = F.pmod(lag, size) if circular else lag + size - 1
    return cells.select(*by, lag.alias("lag"), "m", "v")


def novelty_structure(lags: DataFrame, padding: bool = True, by=PAIR) -> DataFrame:
    """Norm of the difference of consecutive columns of a time-lag matrix; 0 at the last if padded: pair_id, n, x."""
    nxt = F.lead("v").over(Window.partitionBy(*by, "lag").orderBy("m"))
    rows = lags.withColumn("_d", nxt - F.col("v"))
    out = rows.groupBy(*by, F.col("m").alias("n")).agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("x"))
    return out.withColumn("x", F.coalesce("x", F.lit(0.0))) if padding else out.where("x is not null")


def checkerboard_box(spark, L: int) -> DataFrame:
    axis = F.sequence(F.lit(-L), F.lit(L))
    rows = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j"))
    return rows.withColumn("v", F.signum(F.col("i").cast("double")) * F.signum(F.col("j").cast("double")))


def checkerboard_gaussian(spark, L: int, var: float = 1.0, normalize: bool = True) -> DataFrame:
    taper = math.sqrt(0.5) / (L * var)
    box = checkerboard_box(spark, L)
    out = box.withColumn("v", F.col("v") * F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) * (taper * taper)))
    if not normalize:
        return out
    total = sum(abs(_sign(i) * _sign(j)) * math.exp(-(taper**2) * (i * i + j * j)) for i in range(-L, L + 1) for j in range(-L, L + 1))
    return out.withColumn("v", F.col("v") / total)


def gaussian_weights(L: int, var: float = 1.0) -> np.ndarray:
    """The normalised kernel as an array."""
    i = np.arange(-L, L + 1)
    w = np.sign(i)[:, None] * np.sign(i)[None] * np.exp(-((math.sqrt(0.5) / (L * var)) ** 2) * (i[:, None] ** 2 + i[None] ** 2))
    return w / np.abs(w).sum()


def _sign(i: int) -> int:
    return (i > 0) - (i < 0)


def novelty_checkerboard(cells: DataFrame, kernel: DataFrame | None = None, L: int = 10, var: float = 0.5, exclude: bool = False, by=PAIR) -> DataFrame:
    """Kernel correlation along the main diagonal, zero-padded: pair_id, n, x.

    Only cells of the band around the diagonal are sent to the centres they touch.
    """
    kernel = checkerboard_gaussian(cells.sparkSession, L, var) if kernel is None else kernel
    band = cells.where(F.abs(F.col("n") - F.col("m")) <= 2 * L)
    sized = cells.groupBy(*by).agg((F.max("n") + 1).alias("_N"))
    c = F.explode(F.sequence(F.greatest("n", "m") - L, F.least("n", "m") + L)).alias("c")
    sent = band.where(F.abs(F.col("n") - F.col("m")) <= 2 * L).select(*by, "n", "m", "v", c).withColumns({"i": (F.col("n") - F.col("c")).cast("int"), "j": (F.col("m") - F.col("c")).cast("int")})
    k = kernel.select("i", "j", F.col("v").alias("_w"))  # (2 L + 1)^2 rows
    got = sent.join(F.broadcast(k), ["i", "j"]).groupBy(*by, F.col("c").alias("n")).agg(F.sum(F.col("v") * F.col("_w")).alias("x"))
    out = got.join(sized, [*by]).where("n >= 0 and n < _N")
    if exclude:
        inside = f"n >= {min(L, 10**9)} and n < _N - {L}"
        out = out.withColumn("x", F.when(F.expr(inside), F.col("x")).otherwise(0.0))
    return out.select(*by, "n", "x")


def constellation(frames: DataFrame, dist_freq: int = 7, dist_time: int = 7, thresh: float = 0.01) -> DataFrame:
    """Cells that are the maximum of their neighbourhood and exceed the threshold: track, n, k.

    Two separable window maxima; needs a dense grid.
    """
    f = frames.withColumn("_f", F.max("v").over(over(("track_id", "n"), "k").rowsBetween(-dist_freq, dist_freq)))
    f = f.withColumn("_m", F.max("_f").over(over(("track_id", "k"), "n").rowsBetween(-dist_time, dist_time)))
    return f.where(f"v = _m and v > {float(thresh)}").select("track_id", "n", "k")


def _dilate(peaks: DataFrame, tol_freq: int, tol_time: int) -> DataFrame:
    out = peaks.withColumn("k", F.explode(F.sequence(F.col("k") - tol_freq, F.col("k") + tol_freq)))
    return out.withColumn("n", F.explode(F.sequence(F.col("n") - tol_time, F.col("n") + tol_time)))


def match_peaks(ref: DataFrame, est: DataFrame, tol_freq: int = 0, tol_time: int = 0) -> DataFrame:
    """TP (reference peaks near an estimated one), FN, FP per track: a semi-join on dilated peaks."""
    near = ref.select("track_id", "n", "k").join(_dilate(est.select("track_id", "n", "k"), tol_freq, tol_time).distinct(), ["track_id", "n", "k"], "left_semi")
    counts = ref.groupBy("track_id").agg(F.count("*").alias("_r")).join(est.groupBy("track_id").agg(F.count("*").alias("_e")), "track_id", "full")
    out = counts.join(near.groupBy("track_id").agg(F.count("*").alias("_t")), "track_id", "left").na.fill(0)
    return out.select("track_id", F.col("_t").alias("tp"), (F.col("_r") - F.col("_t")).alias("fn"), (F.col("_e") - F.col("_t")).alias("fp"))


def matching_function(docs: DataFrame, query: DataFrame, lengths: DataFrame, query_length: int, tol_freq: int = 1, tol_time: int = 1) -> DataFrame:
    """Hits of the query's peaks at each shift m of each document: track, m, hits, best.

    ``docs``: peaks (track_id, n, k); ``query``: peaks (n, k); ``lengths``: (track_id, L).
    An offset histogram: dilated query peaks meet document peaks of the same bin, and the
    time difference is the shift.  Dilation stays within the query's frames.
    """
    q = _dilate(query.select("n", "k"), tol_freq, tol_time).distinct().where(f"n >= 0 and n < {query_length}").select(F.col("n").alias("_q"), "k")
    hits = docs.join(q, "k").withColumn("m", F.col("n") - F.col("_q")).join(lengths, "track_id").where(f"m >= 0 and m <= L - {query_length}")
    got = hits.groupBy("track_id", "m").agg(F.count_distinct("n", "k").alias("hits"))
    grid = lengths.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("L") - 1)).alias("m"))
    out = grid.join(got, ["track_id", "m"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("best", F.col("m") == F.min_by("m", F.struct(-F.col("hits"), "m")).over(whole()))


def matching_diag(cost: DataFrame, cyclic: bool = False, by=PAIR) -> DataFrame:
    """Mean cost along each diagonal: pair_id, m, delta; infinite where the query would overhang (not cyclic)."""
    sizes = cost.groupBy(*by).agg((F.max("n") + 1).alias("_N"), (F.max("m") + 1).alias("_M"))
    got = cost.join(sizes, [*by]).groupBy(*by, F.pmod(F.col("m") - F.col("n"), F.col("_M")).alias("m"), "_N", "_M").agg((F.sum("v") / F.first("_N")).alias("delta"))
    if not cyclic:
        got = got.withColumn("delta", F.when(F.col("m") > F.col("_M") - F.col("_N"), F.lit(float("inf"))).otherwise(F.col("delta")))
    return got.select(*by, "m", "delta")


def matching_diag_multiple(x: DataFrame, y: DataFrame, tempi: list[float], cyclic: bool = False) -> DataFrame:
    """Minimum over tempo-scaled queries: pair_id, m, delta, length (of the query that won; ties to the first).

    ``x``: long frames of the query; ``y``: (track_id, n, vec) of the documents, paired by name.
    """
    from .interpolate import scale_tempo_sequence

    out = None
    for order, tempo in enumerate(tempi):
        q = vectors(scale_tempo_sequence(x, tempo))
        size = q.groupBy(F.col("track_id").alias("pair_id")).agg(F.count("*").alias("length"))
        one = matching_diag(pairwise(q, y, "cost_dot"), cyclic).join(size, "pair_id").withColumn("_o", F.lit(order))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("pair_id", "m").agg(F.min(F.struct("delta", "_o", "length")).alias("s"))
    return best.select("pair_id", "m", "s.delta", "s.length")


def matches_diag(positions: DataFrame, length: Column) -> DataFrame:
    """Segments (start, end) of matches at positions m, both ends included."""
    return positions.withColumns({"start": F.col("m"), "end": F.col("m") + length - 1})


def synthetic_ssm(segments: DataFrame, score_path: float = 1.0, score_block: float = 0.5, main_diagonal: bool = True, with_path: bool = True, with_block: bool = True, by=("track_id",)) -> DataFrame:
    """Matrix of an annotation (integer, closed segments): blocks and paths of equal labels: track, n, m, v.

    Later segment pairs overwrite earlier ones, a pair's path its block, the diagonal all.
    """
    kind = dict(segments.dtypes)
    if [kind[c] for c in ("start", "end")].count("double"):
        raise ValueError("segments need integer places")
    lists = segments.where("label is not null and start is not null and end is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "label"))).alias("g"))
    lists = lists.repartition(8 * lists.sparkSession.sparkContext.defaultParallelism, *by)
    keys = len(by)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                g = b.column(keys)[r].as_py()
                for n, m, V, has in _painted([(x["s"], x["e"], x["label"]) for x in g], score_path, score_block, main_diagonal, with_path, with_block):
                    at = pa.array(np.arange(0, V.size + 1, V.shape[1], dtype=np.int32))
                    flat = pa.array(V.ravel(), mask=~has.ravel())
                    one = pa.array(np.zeros(len(V), np.int64))
                    yield pa.RecordBatch.from_arrays([b.column(i).slice(r, 1).take(one) for i in range(keys)] + [pa.array(n), pa.array(np.full(len(V), m)), pa.ListArray.from_arrays(at, flat)], names=[*by, "n", "_m", "_v"])

    out = lists.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in by) + ", n long, _m long, _v array<double>")
    out = out.select(*by, "n", "_m", F.posexplode("_v").alias("_p", "v")).where("v is not null")
    place = "long" if "bigint" in (kind["start"], kind["end"]) or main_diagonal or with_path else "int"
    return out.select(*by, F.col("n").cast(place).alias("n"), (F.col("_m") + F.col("_p")).cast(place).alias("m"), "v")


def _painted(segments, score_path, score_block, main_diagonal, with_path, with_block):
    """Strips of rows of a synthetic matrix: places of the rows, of the first column, values, and which cells are there.

    Segments are in order.  Only the segments that reach into a strip are painted, in the order of the pairs.
    """
    if not segments:
        return
    end = max(e for _, e, _ in segments)
    low, high = min([s for s, _, _ in segments] + [0] * main_diagonal), max([e for _, e, _ in segments] + [0] * main_diagonal)
    width = high - low + 1
    like: dict = {}
    for s, e, label in segments:
        like.setdefault(label, []).append((s, e))
    step = max(1, B.CELLS // width)
    for top in range(low, high + 1, step):
        below = min(top + step, high + 1)
        V = np.full((below - top, width), np.nan)
        flat, all_rows = V.ravel(), below - top == high + 1 - low
        for s, e, label in segments:
            a, b = max(s, top), min(e + 1, below)
            if a >= b:
                continue
            for s2, e2 in like[label]:
                if s2 > e2:
                    continue
                if with_block:
                    V[a - top : b - top, s2 - low : e2 + 1 - low] = score_block
                if with_path:
                    i, j = _path_steps(e - s + 1, e2 - s2 + 1)
                    if not all_rows:
                        ok = (i >= a - s) & (i < b - s)
                        i, j = i[ok], j[ok]
                    flat[i * width + (j + ((s - top) * width + s2 - low))] = score_path
        if main_diagonal:
            n = np.arange(max(top, 0), min(below, end + 1))
            V[n - top, n - low] = score_path
        yield np.arange(top, below), low, V, ~np.isnan(V)


@lru_cache(4096)
def _path_steps(one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a path through a block."""
    i = np.arange(max(one, two))
    return (i, (i * (two / one)).astype(np.int64)) if one >= two else ((i * (one / two)).astype(np.int64), i)
