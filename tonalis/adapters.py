"""Views of the driver's tables in the layouts of ``schemas``; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _dense(cells: DataFrame) -> DataFrame:
    """Sums of (track_id, n, x) on each track's grid, which starts on a multiple of 24."""
    summed = cells.groupBy("track_id", "n").agg(F.sum("x").alias("x"))
    span = summed.groupBy("track_id").agg(F.floor(F.min("n") / 24).alias("_d"), F.max("n").alias("_hi"))
    grid = span.select("track_id", "_d", F.explode(F.sequence(F.col("_d") * 24, F.col("_hi"))).alias("n"))
    return grid.join(summed, ["track_id", "n"], "left").select("track_id", (F.col("n") - F.col("_d") * 24).cast("long").alias("n"), F.coalesce("x", F.lit(0.0)).alias("x"))


def sig_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of event values: a signal per event type."""
    e = table(spark, sf_dir, "events")
    return _dense(e.select(F.col("event_type").alias("track_id"), F.floor(_micros("ts") / HOUR_US).alias("n"), F.col("value").alias("x")))


def sig_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order volume in thousands: a signal per priority."""
    o = table(spark, sf_dir, "orders")
    return _dense(o.select(F.col("o_orderpriority").alias("track_id"), F.floor(_micros("o_orderdate") / DAY_US).alias("n"), (F.col("o_totalprice") / 1000).alias("x")))


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames: a track per label, frames in the order of ids, components as bins."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.col("embedding").cast("array<double>").alias("e"))
    return v.select("track_id", "n", F.posexplode("e").alias("k", "v"))  # numbered before the explosion


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of vectors folded to 12 bins."""
    return feat(spark, sf_dir).groupBy("track_id", "n", (F.col("k") % 12).alias("k")).agg(F.sum(F.abs("v")).alias("v"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as notes: a track per supplier, days as seconds."""
    li = table(spark, sf_dir, "lineitem")
    day = F.floor(_micros("l_shipdate") / DAY_US)
    n = by_track(li, F.col("l_suppkey").cast("string").alias("track_id"), day.alias("_day"), F.col("l_quantity").alias("duration"), (F.col("l_partkey") % 88 + 21).cast("double").alias("pitch"), (1 - F.col("l_discount")).alias("velocity"), F.col("l_returnflag").alias("label"))
    first = F.min("_day").over(Window.partitionBy("track_id"))
    return n.select("track_id", (F.col("_day") - first).cast("double").alias("start"), "duration", "pitch", "velocity", "label")


PART_BYTES = 2_000_000  # of a table's files in a partition by track


def by_track(df: DataFrame, *columns) -> DataFrame:
    """Columns of a table, with ``track_id``, dealt by track.

    What later groups by the track and more stays in these partitions, so that its memory depends
    on their size, which is the same for any size of the table, and exploded cells aren't shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df.select(*columns).repartition(parts, "track_id")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's time from one event to the next, in hours since the first: labelled by the event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("track_id"), _micros("ts").alias("us"), "event_id", "event_type")
    w = Window.partitionBy("track_id").orderBy("us", "event_id")
    start = (F.col("us") - F.min("us").over(Window.partitionBy("track_id"))) / HOUR_US
    s = e.withColumn("start", start).withColumn("end", F.lead("start").over(w))
    return s.where("end is not null").select("track_id", "start", "end", F.concat("event_type", F.pmod("event_id", F.lit(3)).cast("string")).alias("label"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in time: status as the state, priority as the observation."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").cast("string").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("o"))


def _dense_sql(name: str, cells: str) -> str:
    return f"""{name}_s AS MATERIALIZED (SELECT track_id, n, sum(x) AS x FROM ({cells}) GROUP BY ALL),
{name}_g AS MATERIALIZED (SELECT track_id, d, unnest(range(d * 24, hi + 1)) AS n FROM (SELECT track_id, min(n) // 24 AS d, max(n) AS hi FROM {name}_s GROUP BY track_id)),
{name} AS MATERIALIZED (SELECT g.track_id, CAST(g.n - d * 24 AS BIGINT) AS n, coalesce(x, 0)::double AS x FROM {name}_g g LEFT JOIN {name}_s s USING (track_id, n))"""


SQL = {
    "sig_hour": _dense_sql("sig_hour", f"SELECT event_type AS track_id, epoch_us(ts) // {HOUR_US} AS n, value AS x FROM events"),
    "sig_day": _dense_sql("sig_day", f"SELECT o_orderpriority AS track_id, epoch_us(o_orderdate) // {DAY_US} AS n, o_totalprice / 1000 AS x FROM orders"),
    "feat": """feat AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS track_id, n, CAST(unnest(range(len(embedding))) AS INT) AS k, unnest(embedding)::double AS v
FROM (SELECT label, embedding, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS n FROM embeddings))""",
    "chroma": "chroma AS MATERIALIZED (SELECT track_id, n, CAST(k % 12 AS INT) AS k, sum(abs(v)) AS v FROM feat GROUP BY ALL)",
    "notes": f"""notes AS MATERIALIZED (SELECT CAST(l_suppkey AS VARCHAR) AS track_id, (epoch_us(l_shipdate) // {DAY_US} - min(epoch_us(l_shipdate) // {DAY_US}) OVER (PARTITION BY l_suppkey))::double AS start,
l_quantity AS duration, (l_partkey % 88 + 21)::double AS pitch, 1 - l_discount AS velocity, l_returnflag AS label FROM lineitem)""",
    "segments": f"""segments AS MATERIALIZED (SELECT track_id, start, "end", label FROM (SELECT track_id, start, lead(start) OVER (PARTITION BY track_id ORDER BY us, event_id) AS "end", label FROM
(SELECT CAST(user_id AS VARCHAR) AS track_id, epoch_us(ts) AS us, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::double / {HOUR_US} AS start, event_type || CAST(event_id % 3 AS VARCHAR) AS label FROM events)) WHERE "end" IS NOT NULL)""",
    "states": "states AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS track_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS n, o_orderstatus AS s, o_orderpriority AS o FROM orders)",
}
NEEDS = {"chroma": ["feat"]}
