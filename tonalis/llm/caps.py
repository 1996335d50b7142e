"""Embedding near-duplicates by spherical-cap filters from random product codes.

Vectors are normalised, turned by a fixed random rotation and cut in two halves.  Each half has
a code of ``width`` random unit directions; a filter is a pair of them.  A vector passes all
filters whose inner product with it exceeds a threshold (at least its ``least`` best), found by
list decoding: halves whose best partner can't reach the threshold are dropped first.  Vectors
that share a filter meet in its run and are verified in double precision, so a link is never
wrong; the filters' number is tuned so that hardly any link is missed (see the recall test).

Equal vectors are one class with a size, so copies are never expanded into pairs.  A pair of
classes is counted only in the first filter that both pass, and a run yields link counts and at
most one component link per class, never the pairs.  Hot filters are split into pairs of chunks.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link.  Rows without id keep a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import built_once, float_rows, materialize
from .components import Union, connected_components
from .runs import per_run, split_hot


def packer(kind: str):
    """Column function: array -> packed components of type ``kind``; null if the vector takes no part."""

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        rows = float_rows(vectors)
        out = [None if x is None or not x.any() else (x + 0.0).astype(kind).tobytes() for x in rows]  # -0.0 becomes 0.0
        return pa.array(out, pa.binary())

    return pack


def unit(packed: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Code:
    """Rotation and both halves' directions for vectors of ``dim`` components."""

    def __init__(self, dim: int, width: int, seed: int):
        rng = np.random.default_rng([seed, dim, width])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        cut = (dim + 1) // 2
        self.halves = []
        for size in (cut, dim - cut):
            c = rng.standard_normal((width, size)) if size else np.zeros((width, 0))
            self.halves.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * math.sqrt(0.5))
        self.cut, self.width = cut, width

    def decode(self, x: np.ndarray, threshold: float, least: int) -> list[np.ndarray]:
        """Filters of each row of unit vectors, in ascending order."""
        y = x @ self.turn
        one, two = y[:, : self.cut] @ self.halves[0].T, y[:, self.cut :] @ self.halves[1].T
        best = two.max(1)
        out = []
        for a, b, top in zip(one, two, best, strict=True):
            rows = np.flatnonzero(a + top >= threshold)
            sums = a[rows][:, None] + b[None, :]
            i, j = np.nonzero(sums >= threshold)
            if len(i) < least:  # few directions nearby: take the best pairs of the best halves
                p, q = np.argsort(-a)[:least], np.argsort(-b)[:least]
                s = a[p][:, None] + b[q][None, :]
                pick = np.argsort(-s, axis=None)[:least]
                out.append(np.sort(p[pick // len(q)] * self.width + q[pick % len(q)]))
            else:
                out.append(np.sort(rows[i] * self.width + j))
        return out


def plan(n: int, wanted: float = 9.0, per_filter: float = 60.0) -> tuple[int, float]:
    """Directions per half, and the threshold in standard deviations, for ``n`` vectors.

    ``wanted`` filters per vector and about ``per_filter`` unrelated vectors per filter.
    """
    filters = max(64.0, n * wanted / per_filter)
    width = math.ceil(math.sqrt(filters))
    chance = wanted / width**2
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) / 2 > chance else (low, mid)
    return width, low


def measured_recall(dim: int, width: int, sds: float, least: int, cosine: float, seed: int, pairs: int = 1000) -> float:
    """The share of random pairs at ``cosine`` with a common filter."""
    rng = np.random.default_rng([seed, 1])
    x, z = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    code = Code(dim, width, seed)
    one, two = (code.decode(v, sds / math.sqrt(dim), least) for v in (x, y))
    return sum(len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two, strict=True)) / pairs


def tuned(n: int, dim: int, cosine: float = 0.95, wanted: float = 9.0, least: int = 4, target: float = 0.985, seed: int = 20) -> tuple[int, float, int]:
    """Directions per half, threshold and least filters for ``n`` vectors of ``dim`` components.

    Filters per vector grow, from ``wanted`` and ``least`` on, until the recall measured at
    ``cosine`` meets ``target``; with more vectors the threshold is higher and more are needed.
    """
    while True:
        width, sds = plan(n, wanted)
        if dim < 2 or cosine >= 1 or measured_recall(dim, width, sds, least, cosine, seed) >= target:
            return width, sds, least
        wanted, least = wanted * 1.25, math.ceil(least * 1.25)


def links_in_run(x: np.ndarray, size: np.ndarray, filters: list[np.ndarray], own: int, chunk: np.ndarray, cosine: float, block: int = 1024) -> tuple[np.ndarray, Union]:
    """Link counts of a run's classes for pairs whose first common filter is ``own``, and their components.

    With two chunks only pairs across them count: pairs within one have a run of their own.
    """
    n = len(x)
    across = len(np.unique(chunk)) > 1
    counts, union, shared = np.zeros(n, np.int64), Union(n), None
    for at in range(0, n, block):
        close = x[at : at + block] @ x.T >= cosine
        close[np.arange(close.shape[0]), np.arange(at, at + close.shape[0])] = False
        if across:
            close &= chunk[at : at + block][:, None] != chunk[None, :]
        if not close.any():
            continue
        i, j = np.nonzero(close)
        union.add(i + at, j)
        if shared is None:  # a 0/1 table of the earlier filters, for which pairs have been counted elsewhere
            earlier = [f[f < own] for f in filters]
            names, where = np.unique(np.concatenate(earlier), return_inverse=True)
            shared = np.zeros((n, len(names)), np.float32)
            shared[np.repeat(np.arange(n), [len(f) for f in earlier]), where] = 1
        if shared.shape[1]:
            near = np.unique(i)  # rows without a link need no look
            close[near] &= shared[at + near] @ shared.T == 0
        counts[at : at + block] += close @ size
    return counts, union


def near_duplicates(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", wanted: float = 9.0, least: int = 4, most: int = 4000, seed: int = 20) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``wanted``: filters per vector on average; ``least``: filters at least (both grow with the
    table, see ``tuned``); ``most``: rows of a
    filter beyond which it is split.
    """
    spark: SparkSession = rows.sparkSession
    element = getattr(rows.schema[vector_col].dataType, "elementType", None)
    kind = "<f4" if element is not None and element.typeName() == "float" else "<f8"  # floats stay floats, as doubles hold them exactly
    width_bytes = int(kind[-1])
    packed = materialize(rows.select(F.col(id_col).cast("long").alias("vec_id"), packer(kind)(F.col(vector_col).cast("array<double>")).alias("packed")).withColumn("key", F.sha2("packed", 256)), "vectors")
    ids = packed.select("vec_id", "key")
    classes = materialize(packed.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("packed").alias("packed")), "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy((F.length("packed") / width_bytes).cast("int").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans = {dim: tuned(n, dim, cosine, wanted, least, seed=seed) for dim, n in sizes.items()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            groups: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                groups.setdefault(len(v) // width_bytes, []).append(i)
            for dim, own in groups.items():
                width, sds, at_least = plans[dim]
                code = built_once(("caps", dim, width, seed), lambda dim=dim, width=width: Code(dim, width, seed))
                found = code.decode(unit([vectors[i] for i in own], kind), sds / math.sqrt(dim), at_least)
                yield pa.record_batch([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array([dim] * len(own), pa.int32()), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], names=["node", "size", "packed", "dim", "filters"])

    decoded = classes.select("node", "size", "packed").mapInArrow(decode, "node long, size long, packed binary, dim int, filters array<int>")
    keyed = decoded.select("*", F.explode("filters").alias("filter")).withColumn("key", F.concat_ws("-", "dim", "filter"))
    runs = split_hot(keyed, "key", "node", most)

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node, lists = node[order], table.column("filters").combine_chunks()
        filters = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1]) if lists.offset == 0 and len(lists.values) == lists.offsets[-1].as_py() else [np.array(f) for f in lists.to_pylist()]
        vectors = table.column("packed").to_pylist()
        counts, union = links_in_run(unit([vectors[i] for i in order], kind), table.column("size").to_numpy()[order], [filters[i] for i in order], table.column("filter")[0].as_py(), table.column("chunk").to_numpy()[order], cosine)
        keep = np.flatnonzero((counts > 0) | (union.label != np.arange(len(node))))
        yield pa.record_batch([pa.array(node[keep]), pa.array(node[union.label[keep]]), pa.array(counts[keep])], names=["a", "b", "n"])

    found = materialize(per_run(runs.select("run", "node", "size", "packed", "filters", "filter", "chunk"), verify, "a long, b long, n long"), "links")
    parts = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.select("key", "node", "size").join(counts, "node", "left").join(parts, "node", "left")
    named = materialize(named.select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "node").alias("component")), "named")
    out = ids.join(named, "key", "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
