"""Helpers shared by the training-data operators: shared folders, folds, Arrow text loops."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Where that is unset, a local master gets a
    temporary folder as its checkpoint folder; any other master has no folder and raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        now = tempfile.mkdtemp(prefix="tonalis-checkpoint-")
        spark.sparkContext.setCheckpointDir(now)
    return now.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm, path = df.sparkSession._jvm, df._written_to
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def crc_fold(id_col: Column) -> Column:
    """crc32 of the id written as text, modulo 4; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), F.lit(4))


def held_out(id_col: Column) -> Column:
    return crc_fold(id_col) == 2


_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = regex.compile(r"\p{L}+")
#: Number signs such as fractions, superscripts and Roman numerals: ``re`` takes them for word characters, but they are no letters.
_SIGN = re.compile("[" + "".join(x for x in map(chr, range(1 << 16)) if x.isalnum() and not x.isalpha() and not x.isdecimal()) + "]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def letter_runs(text: str) -> list[str]:
    """All runs of letters (Unicode's L) of a text."""
    plain = text.isascii() or not (_SIGN.search(text) or _ASTRAL.search(text))
    return (_LETTERS if plain else _RUN).findall(text)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def float_rows(vectors: pa.Array) -> list[np.ndarray | None]:
    """Vectors of an Arrow column as doubles; None for those that are null or empty or hold null or non-finite components."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values, ends = lists.flatten(), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
    flat = pa.compute.fill_null(values, float("nan")).to_numpy().astype(np.float64)
    rows = np.split(flat, ends[:-1]) if len(ends) else []
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))[np.append(0, ends)]
    return [None if not len(x) or b else x for x, b in zip(rows, np.diff(bad).tolist(), strict=True)]


def broadcast_file(spark: SparkSession, path: str, most: int = 64 << 20):
    """Broadcast a vocabulary file (read on the driver; at most ``most`` bytes)."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return spark.sparkContext.broadcast(data)


class Memo(dict):
    """A dict that makes missing values itself and starts over once it holds ``most`` keys.

    Keys of over ``longest`` characters are not kept, so a worker's memory is bounded in bytes, too.
    """

    longest = 256

    def __init__(self, most: int, make: Callable):
        super().__init__()
        self.most, self.make = most, make

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_BUILT: dict[tuple, object] = {}


def built_once(key: tuple, build):
    """An object built once in a Python worker; a worker (they are reused from task to task) keeps the last one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session's Arrow batches end at ``most`` bytes, unless it asks for less.

    Spark's limit is 64 MB, and a batch is held several times: in an executor's direct buffers and
    vectors, which grow by doubling, and in the Python worker.  The setting holds when a plan runs,
    so it stays; no row is cut, and a row above the limit is a batch of its own.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def struct_array(columns: Iterable[tuple[str, pa.Array]]) -> pa.StructArray:
    columns = list(columns)
    return pa.StructArray.from_arrays([c for _, c in columns], names=[n for n, _ in columns])
