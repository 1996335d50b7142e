"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are integers floor(scale * x).  A vector is cut into segments, coarse ones and then
finer ones, each with its mean and standard deviation.  By Cauchy and Schwarz the inner product
of a query q and a candidate x is at most the sum over segments of L (mean_q mean_x + dev_q
dev_x), which bounds the squared distance from below; both terms are small matrix products.
Pairs whose bound stays below the query's k-th best score so far are dropped at the coarsest
level that rules them out; survivors get the exact integer product.

Queries are written to the shared folder in blocks of about ``block`` rows.  A task holds a
bounded part of its candidates in memory at a time and reads the blocks one after the other, so
neither the driver nor a task ever has all queries or all candidates; k rows per query and part
are left over, of which the best k are taken.  A query row is no candidate of itself (rows with
its id).  Ties go to the smaller id.  Vectors that are null, empty or hold null or non-finite
components take no part; vectors of other lengths than the query are no candidates.  Scores are
exact: where squared lengths leave the range in which doubles hold all integers, products are
taken in whole numbers, and scores beyond 64 bits are given as the nearest 64-bit number.  Of
query rows that repeat an id the one whose packed vector sorts first is asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import float_rows, new_path

#: Squared lengths up to which products and their partial sums are exact in doubles.
EXACT = 2.0**52
LEAST, MOST = -(1 << 63) + 2, (1 << 63) - 1


def quantiser(scale: float):
    """Column function: array -> packed doubles that hold its integers; null if the vector takes no part."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            rows = [None if x is None else np.clip(np.floor(scale * x) + 0.0, -1e300, 1e300) for x in float_rows(vectors)]
        out = [None if x is None else x.astype("<f8").tobytes() for x in rows]
        return pa.array(out, pa.binary())

    return pack


def unpacked(packed: list[bytes], ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors and ids by the vectors' length."""
    size = np.array([len(v) // 8 for v in packed], np.int64)
    return {int(n): (np.frombuffer(b"".join(packed[i] for i in np.flatnonzero(size == n)), "<f8").reshape(-1, n), ids[size == n]) for n in np.unique(size)}


def products(q: np.ndarray, x: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Inner products row by row; those marked ``wide`` in whole numbers."""
    out = np.zeros(len(q), np.int64)
    near = np.flatnonzero(~wide)
    for at in range(0, len(near), 65536):
        own = near[at : at + 65536]
        out[own] = np.rint(np.einsum("ij,ij->i", q[own], x[own])).astype(np.int64)
    for i in np.flatnonzero(wide).tolist():
        out[i] = max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[i].tolist(), strict=True))))
    return out


class Levels:
    """Means and deviations of vectors for the numbers of segments in ``cuts``."""

    def __init__(self, x: np.ndarray, cuts: tuple[int, ...]):
        self.stats = []
        for cut in cuts:
            edges = np.linspace(0, x.shape[1], min(cut, x.shape[1]) + 1).astype(int)
            size = np.diff(edges)
            with np.errstate(all="ignore"):
                mean = np.add.reduceat(x, edges[:-1], axis=1) / size
                square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
                # rounding of the difference is made up for, as deviations only bound
                dev = np.sqrt(np.maximum(square - mean * mean, 0) + 1e-12 * square)
            self.stats.append(np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([size, size])))


def best_of(q: np.ndarray, q_ids: np.ndarray, q_levels: Levels, x: np.ndarray, ids: np.ndarray, cuts: tuple[int, ...], k: int, kept: tuple[np.ndarray, np.ndarray], chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Merge candidates into ``kept`` (scores, ids; k columns, best first) of each query."""
    scores, names = kept
    with np.errstate(over="ignore"):
        q_wide = ~((q * q).sum(1) <= EXACT)
    for at in range(0, len(x), chunk):
        part, own = x[at : at + chunk], ids[at : at + chunk]
        levels = Levels(part, cuts)
        floor = scores[:, -1]
        left = np.ones((len(q), len(part)), bool)
        rows = np.arange(len(q))
        for mine, theirs in zip(q_levels.stats, levels.stats, strict=True):
            with np.errstate(all="ignore"):
                bound = mine[rows] @ theirs.T
                bound += 1e-9 * np.abs(bound) + 1e-6
                left[rows] &= ~(bound < floor[rows, None])  # a bound beyond all numbers drops nothing
            rows = rows[left[rows].any(1)]
            if not len(rows):
                break
        left &= q_ids[:, None] != own[None, :]
        i, j = np.nonzero(left)
        if not len(i):
            continue
        with np.errstate(over="ignore"):
            wide = ~((part * part).sum(1) <= EXACT)
        if len(i) > 0.2 * left.size and not wide.any() and not q_wide.any():
            exact = np.rint((q @ part.T)[i, j]).astype(np.int64)
        else:
            exact = products(q[i], part[j], q_wide[i] | wide[j])
        better = exact >= floor[i]
        i, j, exact = i[better], j[better], exact[better]
        touched = np.unique(i)
        owner = np.concatenate([np.repeat(touched, k), i])
        value = np.concatenate([scores[touched].ravel(), exact])
        name = np.concatenate([names[touched].ravel(), own[j]])
        order = np.lexsort((name, -value, owner))
        owner, value, name = owner[order], value[order], name[order]
        first = np.searchsorted(owner, touched)
        pick = first[:, None] + np.arange(k)
        scores[touched], names[touched] = value[pick], name[pick]
    return scores, names


NONE = np.iinfo(np.int64).min + 1  # its negative is an integer too


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16_384, cuts: tuple[int, ...] = (4, 16), hold_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``.

    ``hold_bytes``: candidates that a task holds at a time.
    """
    spark: SparkSession = rows.sparkSession
    table = rows.select(F.col(id_col).cast("long").alias("id"), quantiser(scale)(F.col(vector_col).cast("array<double>")).alias("v"))
    queries = table.where((F.pmod("id", F.lit(every)) == 0) & F.col("v").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    folder = new_path(spark, "queries")
    dealt = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    dealt.write.option("maxRecordsPerFile", block).parquet(folder)
    files = sorted(spark.read.parquet(folder).inputFiles())

    def asked() -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The queries by length, a block (or several small files) at a time."""
        packed, ids = [], []
        for path in files:
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                got = pq.read_table(f, columns=["id", "v"])
            packed += got.column("v").to_pylist()
            ids.append(got.column("id").to_numpy())
            if len(packed) >= block:
                yield unpacked(packed, np.concatenate(ids))
                packed, ids = [], []
        if packed:
            yield unpacked(packed, np.concatenate(ids))

    def search(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for queries in asked():
            for size, (q, q_ids) in queries.items():
                if size not in held:
                    continue
                levels = Levels(q, cuts)
                kept = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
                for x, names in held[size]:
                    kept = best_of(q, q_ids, levels, x, names, cuts, k, kept)
                i, j = np.nonzero(kept[0] != NONE)
                yield pa.record_batch([pa.array(q_ids[i]), pa.array(kept[1][i, j]), pa.array(kept[0][i, j])], names=["query_id", "vec_id", "score"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        room = hold_bytes
        for batch in batches:
            for size, group in unpacked(batch.column("v").to_pylist(), batch.column("id").to_numpy()).items():
                held.setdefault(size, []).append(group)
                room -= group[0].nbytes
            if room < 0:
                yield from search(held)
                held, room = {}, hold_bytes
        if held:
            yield from search(held)

    found = table.where("id is not null and v is not null").mapInArrow(walk, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
