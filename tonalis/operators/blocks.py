"""All frames of one track against all of another, a band of rows at a time.

A track's frames are packed in a row of bytes.  A unit of work is a band of BAND rows with the
whole other track (linear in its frames); its cells are made in NumPy, some rows at a time, and
leave the task at once.  So cells are never shuffled or gathered, whatever is computed on them.
Sums run in the order of the bins, as the same in Spark's expressions does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND = 512  # rows in a unit of work
CELLS = 1 << 18  # cells made at a time
TILE = 1 << 15  # cells of one step, which stay in the cache
RUN = 1 << 14  # columns in one row that leaves a task


# ---------------------------------------------------------------- packing


def _pack(n: np.ndarray, vecs: pa.Array) -> tuple[bytes, bytes, bytes, int]:
    """Places, components and, if they differ, sizes of frames (-1: with a null) as bytes, in the order of n; and their bins."""
    order = np.argsort(n, kind="stable")
    sizes = vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vecs.flatten()
    if len(sizes) and sizes.min() == sizes.max() >= 0 and not flat.null_count:
        return n[order].tobytes(), flat.to_numpy().reshape(len(n), -1)[order].tobytes(), b"", int(sizes[0])
    rows = vecs.to_pylist()
    bins = max([len(r) for r in rows if r is not None], default=0)
    X, size = np.zeros((len(n), bins)), np.full(len(n), -1, np.int32)
    for i, r in enumerate(rows):
        if r is not None and None not in r:
            X[i, : len(r)], size[i] = r, len(r)
    return n[order].tobytes(), X[order].tobytes(), size[order].tobytes(), bins


def packed(x: DataFrame, band: bool = False, before: int = 0, after: int = 0, key: str = "track_id") -> DataFrame:
    """Frames (track_id, n, vec) in a row for each track, or for each band with ``before`` and ``after`` more of its neighbours: track_id[, band], n, x, size, bins."""
    x = x.where(F.col(key).isNotNull() & F.col("n").isNotNull()).select(key, F.col("n").cast("long").alias("n"), F.col("vec").cast("array<double>").alias("vec"))
    if band:
        low, high = (F.floor((F.col("n") + shift) / BAND) for shift in (-after, before))
        x = x.withColumn("band", F.explode(F.sequence(low, high)))
    keys = [key, "band"] if band else [key]
    lists = x.groupBy(*keys).agg(F.collect_list(F.struct("n", "vec")).alias("s"))
    schema = ", ".join(f"{k} {t}" for k, t in lists.dtypes if k != "s")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                s = b.column(len(keys))[r].values
                got = _pack(s.field(0).to_numpy(), s.field(1))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(r, 1) for i in range(len(keys))] + [pa.array([v]) for v in got], names=[*keys, "n", "x", "size", "bins"])

    return lists.mapInArrow(run, f"{schema}, n binary, x binary, size binary, bins long")


class Track:
    """Packed frames: places n, components X (frames by bins)."""

    def __init__(self, n: bytes, x: bytes, size: bytes, bins: int):
        self.n = np.frombuffer(n, np.int64)
        self.X = np.frombuffer(x).reshape(len(self.n), bins)
        self.size = np.frombuffer(size, np.int32) if size else None

    def __len__(self):
        return len(self.n)

    def sizes(self) -> np.ndarray:
        return np.full(len(self), self.X.shape[1], np.int32) if self.size is None else self.size


def even(x: Track, y: Track):
    if x.size is not None or y.size is not None or x.X.shape[1] != y.X.shape[1]:
        raise ValueError("frames differ in their number of bins, or have nulls")


def sides(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Packed tracks of each pair in one row."""
    names = ("n", "x", "size", "bins")
    a = a.withColumnsRenamed({c: f"a_{c}" for c in names})
    b = b.withColumnsRenamed({c: f"b_{c}" for c in names})
    if pairs is None:
        a, b = a.withColumnRenamed("track_id", "pair_id"), b.withColumnRenamed("track_id", "pair_id")
    else:
        a = a.join(pairs.select("pair_id", F.col("x_id").alias("track_id")), "track_id").drop("track_id")
        b = b.join(pairs.select("pair_id", F.col("y_id").alias("track_id")), "track_id").drop("track_id")
    return a.join(b, "pair_id")


def _parts(df: DataFrame) -> int:
    return 8 * df.sparkSession.sparkContext.defaultParallelism


def bands(x: DataFrame, y: DataFrame, pairs: DataFrame | None = None, before: int = 0, after: int = 0, more: DataFrame | None = None) -> DataFrame:
    """Units of work: a band of X with the whole of Y, dealt over many tasks; ``more`` adds columns of the pair."""
    jobs = sides(packed(x, True, before, after), packed(y), pairs)
    if more is not None:
        jobs = jobs.join(more, "pair_id")
    return jobs.withColumn("width", F.lit(BAND)).repartition(_parts(jobs), "pair_id", "band")


def whole(x: DataFrame, y: DataFrame, pairs: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Units of work: both tracks of a pair, dealt over many tasks; ``more`` adds columns of the pair."""
    jobs = sides(packed(x), packed(y), pairs)
    if more is not None:
        jobs = jobs.join(more, "pair_id")
    return jobs.repartition(_parts(jobs), "pair_id")


Cell = Callable[[dict, Track, Track], Iterator]


def units(batches) -> Iterator[tuple[pa.Array, dict, Track, Track]]:
    for b in batches:
        for r in range(b.num_rows):
            row = {name: b.column(i)[r].as_py() for i, name in enumerate(b.schema.names)}
            sides = [Track(*(row.pop(f"{s}_{c}") for c in ("n", "x", "size", "bins"))) for s in "ab"]
            yield b.column(b.schema.get_field_index("pair_id")).slice(r, 1), row, *sides


def _repeat(one: pa.Array, times: int) -> pa.Array:
    return one.take(pa.array(np.zeros(times, np.int64)))


def core(row: dict, x: Track) -> tuple[int, int]:
    """Where a band's own rows lie among its frames."""
    return int(np.searchsorted(x.n, row["band"] * row["width"])), int(np.searchsorted(x.n, (row["band"] + 1) * row["width"]))


def _runs(m: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of consecutive columns, none longer than RUN."""
    cuts = np.flatnonzero(np.diff(m) != 1) + 1
    edges = [0, *cuts.tolist(), len(m)]
    return [(s, min(s + RUN, b)) for a, b in zip(edges, edges[1:], strict=False) for s in range(a, b, RUN)]


def cells(jobs: DataFrame, fn: Cell, extra: bool = False, lag: bool = False) -> DataFrame:
    """Cells (pair_id, n, m, v[, shift]), with ``lag`` those of a square matrix by circular lag (pair_id, lag, m, v), that ``fn(row, x, y)`` yields: first and last row within x, values [, shifts, null mask]."""
    kind = dict(jobs.dtypes)["pair_id"]

    def run(batches):
        for pair, row, x, y in units(batches):
            runs = _runs(y.n)
            for a, b, V, S, null in fn(row, x, y):
                for s, e in runs:
                    flat = pa.array(V[:, s:e].ravel(), mask=None if null is None else null[:, s:e].ravel())
                    at = pa.array(np.arange(0, (b - a) * (e - s) + 1, e - s, dtype=np.int32))
                    out = [_repeat(pair, b - a), pa.array(x.n[a:b]), pa.array(np.full(b - a, y.n[s])), pa.array(np.full(b - a, y.n[-1] + 1)), pa.ListArray.from_arrays(at, flat)]
                    if extra:
                        out.append(pa.ListArray.from_arrays(at, pa.array(S[:, s:e].ravel().astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=["pair_id", "n", "_m", "_N", "_v", "_s"][: len(out)])

    out = jobs.mapInArrow(run, f"pair_id {kind}, n long, _m long, _N long, _v array<double>" + ", _s array<int>" * extra)
    out = out.select("pair_id", "n", "_m", "_N", *["_s"] * extra, F.posexplode("_v").alias("_p", "v"))
    if lag:
        m = F.col("_m") + F.col("_p")
        return out.select("pair_id", (F.col("n") - m + F.when(m > F.col("n"), F.col("_N")).otherwise(0)).alias("lag"), m.alias("m"), "v")
    return out.select("pair_id", "n", (F.col("_m") + F.col("_p")).alias("m"), "v", *[F.get("_s", F.col("_p")).alias("shift")] * extra)


def rows(jobs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Results of ``fn(row, x, y)``: the pair's key and arrays in the order of ``schema``."""
    kind = dict(jobs.dtypes)["pair_id"]
    names = ["pair_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches):
        for pair, row, x, y in units(batches):
            got = [v if isinstance(v, pa.Array) else pa.array(v) for v in fn(row, x, y)]
            yield pa.RecordBatch.from_arrays([_repeat(pair, len(got[0])), *got], names=names)

    return jobs.mapInArrow(run, f"pair_id {kind}, {schema}")


# ---------------------------------------------------------------- values


def _dot(X, YT):
    out, tmp = np.zeros((len(X), YT.shape[1])), np.empty((len(X), YT.shape[1]))
    for k in range(X.shape[1]):
        out += np.multiply(X[:, k, None], YT[k], out=tmp)
    return out


def _fold(X, YT, each, merge=np.add):
    out, tmp = np.zeros((len(X), YT.shape[1])), np.empty((len(X), YT.shape[1]))
    for k in range(X.shape[1]):
        merge(out, each(np.subtract(X[:, k, None], YT[k], out=tmp), tmp), out=out)
    return out


def _square(d, out):
    return np.multiply(d, d, out=out)


def _cosine(X, YT):
    own = lambda V: _dot_rows(V, V)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - _dot(X, YT) / np.sqrt(own(X)[:, None] * own(YT.T))


def _dot_rows(X, Y):
    out = np.zeros(len(X))
    for k in range(X.shape[1]):
        out += X[:, k] * Y[:, k]
    return out


METRICS = {
    "euclidean": lambda X, YT: np.sqrt(_fold(X, YT, _square)),
    "sqeuclidean": lambda X, YT: _fold(X, YT, _square),
    "cityblock": lambda X, YT: _fold(X, YT, np.abs),
    "chebyshev": lambda X, YT: _fold(X, YT, np.abs, np.maximum),
    "cosine": _cosine,
    "dot": _dot,
    "cost_dot": lambda X, YT: 1.0 - _dot(X, YT),
}


def values(X: np.ndarray, YT: np.ndarray, metric: str = "dot") -> np.ndarray:
    """Rows of X (frames by bins) against the columns of YT (bins by frames), in tiles."""
    width = max(64, TILE // max(1, len(X)))
    if YT.shape[1] <= width:
        return METRICS[metric](X, YT)
    out = np.empty((len(X), YT.shape[1]))
    for s in range(0, YT.shape[1], width):
        out[:, s : s + width] = METRICS[metric](X, YT[:, s : s + width])
    return out


def strips(a: int, b: int, width: int, least: int = 1) -> Iterator[tuple[int, int]]:
    """Rows from a to b, so many at a time as make about CELLS cells."""
    step = max(least, CELLS // max(1, width))
    return ((s, min(s + step, b)) for s in range(a, b, step))


def bins_first(y: Track) -> np.ndarray:
    return np.ascontiguousarray(y.X.T)


def round6(v: np.ndarray) -> np.ndarray:
    """To six digits, halves of the shortest decimal up, as Spark rounds."""
    t = np.abs(v)
    top = float(np.nanmax(t, initial=0.0))
    t *= 1e6
    k = np.floor(t + 0.5)
    out = k / 1e6
    np.copysign(out, v, out=out)
    t -= np.floor(t)
    t -= 0.5
    near = np.abs(t, out=t) < max(1e-9, 1e-9 * top)
    if top > 1e6 or not np.isfinite(top):
        near |= ~(np.abs(v) <= 1e6)
    if near.any():
        exact = lambda x: float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if abs(x) < 1e15 else x
        out[near] = [exact(x) for x in v[near]]
    return out + 0.0


def pairwise(x: DataFrame, y: DataFrame, metric: str, pairs: DataFrame | None = None, lag: bool = False) -> DataFrame:
    def run(row, x, y):
        YT, M = bins_first(y), len(y)
        X = x.X
        if X.shape[1] != len(YT):  # the side with fewer bins has zeros, and its cells are null
            K = max(X.shape[1], len(YT))
            X, YT = np.pad(X, ((0, 0), (0, K - X.shape[1]))), np.pad(YT, ((0, K - len(YT)), (0, 0)))
        ragged = x.size is not None or y.size is not None or x.X.shape[1] != y.X.shape[1]
        sx, sy = x.sizes(), y.sizes()
        for a, b in strips(*core(row, x), M):
            V, null = values(X[a:b], YT, metric), None
            if ragged:
                null = (sx[a:b, None] != sy[None]) | (sx[a:b, None] < 0)
            if metric == "cosine":
                zero = (_dot_rows(X[a:b], X[a:b])[:, None] * _dot_rows(YT.T, YT.T)) == 0
                null = zero if null is None else null | zero
            yield a, b, V, None, null

    return cells(bands(x, y, pairs), run, lag=lag)


# ---------------------------------------------------------------- diagonals and shifts


def _slopes(tempi, M: int) -> list[tuple[np.ndarray, np.ndarray, int] | None]:
    """For each tempo the place of each column in the stretched matrix, the column that each place shows, and the places; None for 1."""
    out = []
    for tempo in tempi:
        if tempo == 1:
            out.append(None)
            continue
        wide = int(np.ceil(M / float(tempo)))
        source = np.maximum(np.rint((np.arange(wide) + 1) / wide * M) - 1, 0).astype(np.int64)
        back = np.maximum(np.rint((np.arange(M) + 1) / M * wide) - 1, 0).astype(np.int64)
        out.append((source, back, wide))
    return out


def _smooth(G: np.ndarray, first: int, rows: int, L: int, direction: int, slope, V: np.ndarray):
    """Sums over L cells of a diagonal from (0) or up to (1) each cell, in its order; rows of V lie at ``first`` in G."""
    M = V.shape[1]
    V.fill(0.0)
    for l in range(L) if direction == 0 else range(1 - L, 1):
        low, high = max(0, -(first + l)), min(rows, len(G) - first - l)  # rows whose cell is inside
        if low >= high:
            continue
        part = G[first + l + low : first + l + high]
        if slope is None:
            if abs(l) < M:
                a, b = max(0, -l), M - max(0, l)
                V[low:high, a:b] += part[:, a + l : b + l]
        else:
            source, back, wide = slope
            at = back + l
            ok = (at >= 0) & (at < wide)
            V[low:high, ok] += part[:, source[at[ok]]]
    V /= L


def smoothed(x: DataFrame, y: DataFrame, L: int, tempi=(1.0,), shifts=(0,), directions=(0,), clip: bool = True) -> DataFrame:
    """Similarity smoothed along diagonals: the maximum over shifts, directions and tempi, and its first shift: pair_id, n, m, v, shift.

    Frames are n = 0, 1, ... without gaps.  ``clip``: not below 0.
    """
    before, after = (L - 1) * (1 in directions), (L - 1) * (0 in directions)

    def run(row, x, y):
        even(x, y)
        M = len(y)
        turned = [np.ascontiguousarray(np.roll(y.X, s, 1).T) for s in shifts]
        slopes = _slopes(tempi, M)
        for a, b in strips(*core(row, x), M, 4 * L):
            low, high = max(0, a - before), min(len(x), b + after)
            best, V = np.full((b - a, M), 0.0 if clip else -np.inf), np.empty((b - a, M))
            shift = np.full((b - a, M), shifts[0], np.int32)
            for i, s in enumerate(shifts):
                G = values(x.X[low:high], turned[i])
                for d in directions:
                    for slope in slopes:
                        if L > 1 or slope is not None:
                            _smooth(G, a - low, b - a, L, d, slope, V)
                        one = V if L > 1 or slope is not None else G
                        if len(shifts) > 1:
                            shift[one > best] = s
                        np.maximum(best, one, out=best)
            yield a, b, best, shift, None

    return cells(bands(x, y, None, before, after), run, True)


# ---------------------------------------------------------------- thresholds on cells rounded to six digits


def _local_limit(V: np.ndarray, share: float) -> np.ndarray:
    """The value at the place of each row's order from which a share of cells is kept; infinite beyond its end."""
    at = int(np.rint(V.shape[1] * (1 - share)))
    return np.partition(V, at, 1)[:, at] if at < V.shape[1] else np.full(len(V), np.inf)


def threshold_local(x: DataFrame, y: DataFrame, shares, metric: str = "dot") -> DataFrame:
    """Cells rounded to six digits, 0 unless among the largest of their row and of their column: pair_id, n, m, v."""

    def limits(row, y, x):  # a band of columns
        even(x, y)
        XT, (first, last) = bins_first(x), core(row, y)
        t = [_local_limit(round6(values(y.X[a:b], XT, metric)), shares[1]) for a, b in strips(first, last, len(x))]
        return y.n[first:last], np.concatenate(t) if t else np.zeros(0)

    columns = rows(bands(y, x), limits, "m long, t double").groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "t"))), lambda s: s["t"]).alias("t"))

    def run(row, x, y):
        YT, t = bins_first(y), np.array(row["t"], float)
        for a, b in strips(*core(row, x), len(y)):
            V = round6(values(x.X[a:b], YT, metric))
            V[(V < _local_limit(V, shares[0])[:, None]) | (V < t)] = 0.0
            yield a, b, V, None, None

    return cells(bands(x, y, more=columns), run)


COARSE = 1024  # units of 1e-6 in a coarse class


def _classes(x: DataFrame, y: DataFrame, pairs, metric: str, more: DataFrame | None = None) -> DataFrame:
    """Counts of cells by coarse class of their value, or, given the pair's class ``_c``, by value in it: pair_id, k, c, and the least positive and the largest value."""
    fine = more is not None

    def run(row, x, y):
        even(x, y)
        YT, keys, counts, low, high = bins_first(y), [], [], np.inf, -np.inf
        for a, b in strips(*core(row, x), len(y)):
            V = round6(values(x.X[a:b], YT, metric))
            k = np.rint(V * 1e6).astype(np.int64).ravel()
            c = k // COARSE
            if fine:
                k = k[c == row["_c"]]
            else:
                high, low, k = max(high, V.max()), min(low, V[V > 0].min(initial=np.inf)), c
            if len(k):
                base = k.min()
                got = np.bincount(k - base) if k.max() - base < 1 << 22 else None
                u, n = (np.flatnonzero(got) + base, got[got > 0]) if got is not None else np.unique(k, return_counts=True)
                keys.append(u)
                counts.append(n)
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        return u, np.bincount(at, np.concatenate(counts)).astype(np.int64), np.full(len(u), low), np.full(len(u), high)

    got = rows(bands(x, y, pairs, more=more), run, "k long, c long, low double, high double")
    return got.groupBy("pair_id", "k").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))


def relative_limits(x: DataFrame, y: DataFrame, share: float, metric: str = "dot", pairs: DataFrame | None = None) -> DataFrame:
    """For each pair the value from which a share of its cells is kept (cells rounded to six digits; infinite if none is), the least
    positive value kept (0 if none) and the largest kept: pair_id, t, low, high.  Exact: the class of the value is found first, then the value in it."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id")
    coarse = _classes(x, y, pairs, metric).withColumns({"_all": F.sum("c").over(w), "_to": F.sum("c").over(w.orderBy("k")), "low": F.min("low").over(w), "high": F.max("high").over(w)})
    coarse = coarse.withColumn("_at", F.rint(F.col("_all") * (1 - share)).cast("long"))
    # a place beyond the end takes the last class, so that the pair stays
    hit = coarse.withColumn("_last", F.max("k").over(w)).where("(_to > _at and _to - c <= _at) or (_at >= _all and k = _last)")
    hit = hit.select("pair_id", F.col("k").alias("_c"), (F.col("_at") - (F.col("_to") - F.col("c"))).alias("_at"), "low", "high")
    fine = _classes(x, y, pairs, metric, hit.select("pair_id", "_c")).select("pair_id", "k", "c").join(hit, "pair_id")
    fine = fine.withColumns({"_to": F.sum("c").over(w.orderBy("k")), "_all": F.sum("c").over(w), "_last": F.max("k").over(w)})
    fine = fine.where("(_to > _at and _to - c <= _at) or (_at >= _all and k = _last)")
    t = F.when(F.col("_at") < F.col("_all"), F.col("k") / 1e6).otherwise(float("inf"))
    out = fine.select("pair_id", t.alias("t"), "low", "high")
    none = F.col("t") == float("inf")
    low = F.when(none | F.isnan("low") | (F.col("low") == float("inf")), 0.0).when(F.col("t") > 0, F.col("t")).otherwise(F.col("low"))
    return out.select("pair_id", "t", low.alias("low"), F.when(none, 0.0).otherwise(F.col("high")).alias("high"))


def limit(V: np.ndarray, t: float, low: float, high: float, scale: bool, penalty: float) -> np.ndarray:
    """Values below t become 0; with ``scale`` the rest goes from [low, high] to [0, 1], and zeros become the penalty.  In place."""
    V[V < t] = 0.0
    if scale and high > low:
        zero = V == 0
        V -= low
        V /= high - low
        V[zero] = penalty
    return V


def threshold_relative(x: DataFrame, y: DataFrame, share: float, scale: bool = False, penalty: float = 0.0, metric: str = "dot") -> DataFrame:
    """Cells rounded to six digits, 0 unless among the largest of their matrix, optionally scaled: pair_id, n, m, v."""

    def run(row, x, y):
        YT = bins_first(y)
        for a, b in strips(*core(row, x), len(y)):
            yield a, b, limit(round6(values(x.X[a:b], YT, metric)), row["t"], row["low"], row["high"], scale, penalty), None, None

    return cells(bands(x, y, more=relative_limits(x, y, share, metric)), run)


# ---------------------------------------------------------------- novelty, without the matrix


def _direct(X: np.ndarray, Z: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    d = Z @ z - X @ y
    return float(d @ d)


def novelty_structure(x: DataFrame, y: DataFrame) -> DataFrame:
    """Norm of the difference of consecutive columns of the circular time-lag matrix, 0 at the last: pair_id, n, x.

    The difference at (n, m) is x'.dy + dx.y with x' the next frame (the first after the last), so
    that its sum of squares follows from three small matrices of X: time linear in the frames.
    Columns whose terms cancel are computed from all rows.
    """

    def run(row, x, y):
        even(x, y)
        X, Z, Y = x.X, np.roll(x.X, -1, 0), y.X
        dx, dy = Z - X, np.diff(Y, axis=0)
        terms = [np.einsum("mi,ij,mj->m", p, M, q, optimize=True) for p, M, q in ((dy, Z.T @ Z, dy), (dy, 2 * (Z.T @ dx), Y[:-1]), (Y[:-1], dx.T @ dx, Y[:-1]))]
        square = np.maximum(sum(terms), 0.0)
        size = sum(map(np.abs, terms)) if len(dy) else square
        for m in np.flatnonzero((np.sqrt(square) < 1e-7 * size) & (size > 0)):
            square[m] = _direct(X, Z, Y[m], Y[m + 1])
        return y.n, np.append(np.sqrt(square), np.zeros(min(1, len(Y))))

    return rows(whole(x, y), run, "n long, x double")


def novelty_checkerboard(x: DataFrame, y: DataFrame, weights: np.ndarray) -> DataFrame:
    """Correlation of a kernel (2 L + 1 rows and columns) along the main diagonal, zero-padded: pair_id, n, x.  Only the band around it is made."""
    L = len(weights) // 2

    def run(row, x, y):
        even(x, y)
        N, M = len(x), len(y)
        out = np.zeros(N)
        for k in range(-2 * L, 2 * L + 1):  # one diagonal m = n + k at a time
            a, b = max(0, -k), min(N, M - k)
            if a >= b:
                continue
            d = _dot_rows(x.X[a:b], y.X[a + k : b + k])
            for i in range(max(-L, -L - k), min(L, L - k) + 1):  # row n = c + i, column m = c + i + k
                w = weights[i + L, i + k + L]
                low, high = max(a, i), min(b, N + i)
                if w and low < high:
                    out[low - i : high - i] += d[low - a : high - a] * w
        kept = np.arange(N) - L <= M - 1
        return x.n[kept], out[kept]

    return rows(whole(x, y), run, "n long, x double")
