"""Evaluation measures as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import measure_f, measure_p, measure_r

BY = ("track_id",)


def prf(counts: DataFrame) -> DataFrame:
    """Adds p, r, f to tp, fn, fp; a measure without cases is 0."""
    out = counts.withColumns({"p": measure_p("tp", "fp"), "r": measure_r("tp", "fn")})
    return out.withColumn("f", measure_f("p", "r"))


def prf_sets(items: DataFrame, ref: DataFrame, est: DataFrame, item: str = "item", by=BY) -> DataFrame:
    """Counts and measures of two sets of items within a base set, per track."""
    base = items.select(*by, item).distinct()
    r = ref.select(*by, item).distinct().withColumn("_r", F.lit(True))
    e = est.select(*by, item).distinct().withColumn("_e", F.lit(True))
    both = base.join(r, [*by, item], "left").join(e, [*by, item], "left")
    return prf(_counts(both, by, F.col("_r").isNotNull(), F.col("_e").isNotNull()))


def _counts(df: DataFrame, by, ref, est) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(ref & est).alias("tp"), F.count_if(ref & ~est).alias("fn"), F.count_if(~ref & est).alias("fp"))


def label_sequence(segments: DataFrame, by=BY) -> DataFrame:
    """A label for each frame of integer segments; gaps are closed: track, n, label."""
    # places without sorting all frames: lengths of the segments before
    w = Window.partitionBy(*by).orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    spans = segments.where("start < end").withColumn("_o", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))
    return spans.select(*by, F.posexplode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("_p", "_f"), "_o", "label").select(*by, (F.col("_o") + F.col("_p")).cast("long").alias("n"), "label")


def compare_pairwise(labels: DataFrame, by=BY) -> DataFrame:
    """Pairs n > m of frames with equal labels: track, n, m."""
    a = labels.select(*by, "n", "label")
    b = labels.select(*by, F.col("n").alias("m"), "label")
    return a.join(b, [*by, "label"]).where("m < n").select(*by, "n", "m")


def evaluate_pairwise(ref: DataFrame, est: DataFrame, by=BY) -> DataFrame:
    """Measures over pairs of frames with equal labels, from label counts and not from all pairs.

    ``ref`` and ``est``: (track, n, label).  Pairs in both: by counts of (ref label, est label).
    """
    both = ref.select(*by, "n", F.col("label").alias("_r")).join(est.select(*by, "n", F.col("label").alias("_e")), [*by, "n"], "full")
    pairs = lambda c: (c * (c - 1) / 2).cast("long")

    def total(keys, name):
        got = both.dropna(subset=keys).groupBy(*by, *keys).agg(F.count("*").alias("c"))
        return got.groupBy(*by).agg(F.sum(pairs(F.col("c"))).alias(name))

    out = total(["_r"], "r_").join(total(["_e"], "e_"), [*by], "full").join(total(["_r", "_e"], "tp"), [*by], "left").na.fill(0)
    return prf(out.select(*by, "tp", (F.col("r_") - F.col("tp")).alias("fn"), (F.col("e_") - F.col("tp")).alias("fp")))


def pairwise_codes(ref_pairs: DataFrame, est_pairs: DataFrame, by=BY) -> DataFrame:
    """Cell codes of two pair matrices: 1 in both, 2 only reference, 3 only estimate."""
    r, e = ref_pairs.withColumn("_r", F.lit(1)), est_pairs.withColumn("_e", F.lit(1))
    both = r.join(e, [*by, "n", "m"], "full")
    return both.select(*by, "n", "m", F.when(F.col("_r").isNull(), 3).when(F.col("_e").isNull(), 2).otherwise(1).alias("code"))


def evaluate_boundary(ref: DataFrame, est: DataFrame, tau: int, by=BY) -> DataFrame:
    """Boundary measures with a tolerance of tau frames, and per-track counts.

    Every estimate within reach of a reference counts as a TP, so TP may exceed the reference.
    """
    r, e = ref.select(*by, "n"), est.select(*by, "n")
    reach = r.select(*by, F.col("n").alias("_n"), F.explode(F.sequence(F.col("n") - tau, F.col("n") + tau)).alias("n"))
    hits = reach.join(e, [*by, "n"])
    counts = hits.groupBy(*by).agg(F.count("*").alias("tp"))
    missed = r.join(hits.select(*by, F.col("_n").alias("n")).distinct(), [*by, "n"], "left_anti").groupBy(*by).agg(F.count("*").alias("fn"))
    wrong = e.join(reach.select(*by, "n").distinct(), [*by, "n"], "left_anti").groupBy(*by).agg(F.count("*").alias("fp"))
    keys = r.select(*by).union(e.select(*by)).distinct()
    return prf(keys.join(counts, [*by], "left").join(missed, [*by], "left").join(wrong, [*by], "left").na.fill(0))


def eval_measures(ref: DataFrame, est: DataFrame, by=BY) -> DataFrame:
    """Measures of two sparse binary matrices of cells (track, n, k); all 0 without a TP."""
    r = ref.select(*by, "n", "k").distinct().withColumn("_r", F.lit(True))
    e = est.select(*by, "n", "k").distinct().withColumn("_e", F.lit(True))
    both = r.join(e, [*by, "n", "k"], "full")
    return prf(_counts(both, by, F.col("_r").isNotNull(), F.col("_e").isNotNull()))


def eval_cells(ref: DataFrame, est: DataFrame, by=BY) -> DataFrame:
    """Cell codes for display: TP, FN or FP."""
    r, e = ref.select(*by, "n", "k").withColumn("_r", F.lit(1)), est.select(*by, "n", "k").withColumn("_e", F.lit(1))
    both = r.join(e, [*by, "n", "k"], "full")
    return both.select(*by, "n", "k", F.when(F.col("_r").isNull(), "FP").when(F.col("_e").isNull(), "FN").otherwise("TP").alias("code"))


def ranking(scores: DataFrame, by=BY, score: str = "score", relevant: str = "relevant", tie: str = "doc_id") -> DataFrame:
    """Precision, recall and F at each rank of each query; ties go to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ranked = scores.withColumns({"rank": F.row_number().over(w), "hits": F.sum(F.col(relevant).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(F.col(relevant).cast("int")).over(Window.partitionBy(*by))})
    out = ranked.withColumns({"p": F.col("hits") / F.col("rank"), "r": F.coalesce(F.try_divide(F.col("hits"), F.col("total")), F.lit(0.0))})
    return out.withColumn("f", measure_f("p", "r"))


def ranking_summary(ranked: DataFrame, by=BY, relevant: str = "relevant") -> DataFrame:
    """Break-even point, largest F and average precision of each query."""
    rel = F.col(relevant).cast("int")
    out = ranked.groupBy(*by).agg(F.max(F.when(F.col("rank") == F.col("total"), F.col("p"))).alias("bep"), F.max("f").alias("f_max"), F.sum(F.col("p") * rel).alias("_s"), F.max("total").alias("_t"))
    return out.select(*by, F.coalesce("bep", F.lit(0.0)).alias("bep"), "f_max", F.coalesce(F.try_divide(F.col("_s"), F.col("_t")), F.lit(0.0)).alias("ap"))
