"""Runs of equal keys in sorted partitions, with hot keys split into pairs of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def split_hot(rows: DataFrame, key: str, part_of: str, most: int) -> DataFrame:
    """``rows`` with ``run`` (struct to group by) and ``chunk``: keys of more than ``most`` rows are cut.

    A hot key's rows are dealt by a hash of ``part_of`` into k chunks; the run (key, i, j) holds
    chunks i and j, so each pair of rows meets in a run and no run has over about 2 x ``most`` rows.
    Keys with one row are left out: they pair with nothing.
    """
    spread = materialize(rows, "keyed")
    sizes = materialize(spread.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    joined = spread.join(sizes, key)
    k = F.ceil(F.col("_n") / most).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(7), F.col(part_of)), k).cast("int")
    joined = joined.withColumn("_k", k).withColumn("chunk", chunk)
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    joined = joined.withColumn("_o", other)
    low, high = F.least("chunk", "_o"), F.greatest("chunk", "_o")
    return joined.withColumn("run", F.concat_ws(":", F.col(key), low, high)).drop("_n", "_k", "_o")


def per_run(rows: DataFrame, found: Callable[[pa.Table], Iterator[pa.RecordBatch] | None], schema: str, many: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None] | None = None, small: int = 32) -> DataFrame:
    """Apply ``found`` to the rows of each ``run``.

    With ``many``, runs of at most ``small`` rows are handed over together: a table and the
    start of each run in it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[pa.Table] = []

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            run = table.column("run").combine_chunks()
            n = len(run)
            if n < 2:
                return
            change = np.flatnonzero(pa.compute.not_equal(run.slice(1), run.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [n]]))
            if many is not None:
                little = (sizes > 1) & (sizes <= small)
                if little.any():
                    keep = np.repeat(little, sizes)
                    own = sizes[little]
                    if (out := many(table.filter(pa.array(keep)), np.cumsum(own) - own)) is not None:
                        yield out
            for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                if size > (small if many is not None else 1):
                    yield from found(table.slice(at, size).combine_chunks())

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            run = table.column("run")
            last = run[-1].as_py()
            first_of_last = pa.compute.index(run, last).as_py()
            if tail and first_of_last == 0 and tail[-1].column("run")[-1].as_py() == last:
                tail.append(table)
                continue
            if first_of_last:
                yield from whole(pa.concat_tables([*tail, table.slice(0, first_of_last)]))
                tail = [table.slice(first_of_last)]
            else:
                if tail:
                    yield from whole(pa.concat_tables(tail))
                tail = [table]
        if tail:
            yield from whole(pa.concat_tables(tail))

    import pyarrow.compute  # noqa: F401  (pa.compute)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "run").sortWithinPartitions("run").mapInArrow(walk, schema)
