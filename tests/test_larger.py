"""Results of queries on values that the smallest tables lack, and operators that never hold or move all cells."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalis import queries as Q
from tonalis import queries_more  # noqa: F401  (registers more queries)
from tonalis.operators import blocks as B
from tonalis.operators import kernels as K
from tonalis.operators import sequences as S
from tonalis.operators import similarity as SM
from tonalis.operators import sweeps as SW

SF = "/root/testdata/sf0.01"


def close(got, want):
    """Equal rows in any order, doubles to six digits."""
    order = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns, key=lambda c: (d[c].dtype.kind == "f", c))).reset_index(drop=True)
    got, want = order(got), order(want)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], rtol=0, atol=1.5e-6, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


def test_value_scalars_of_zero(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, 2.5)], "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = Q.QUERIES["value_scalars"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(Q.ORACLE_SQL["value_scalars"]).df()
    assert got.set_index("event_id")["tempo"].to_dict() == want.set_index("event_id")["tempo"].to_dict() == {1: np.inf, 2: 2400.0}


def tracks(spark, sizes, bins=12, seed=0):
    """Non-negative unit frames of a track for each size, as arrays and as NumPy."""
    rng = np.random.default_rng(seed)
    X = {str(i): rng.random((N, bins)) for i, N in enumerate(sizes)}
    X = {t: x / np.linalg.norm(x, axis=1, keepdims=True) for t, x in X.items()}
    return spark.createDataFrame([(t, n, row.tolist()) for t, x in X.items() for n, row in enumerate(x)], "track_id string, n long, vec array<double>"), X


def nodes(df, name):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count(name)


def matrices(df):
    return {p: g.pivot(index="n", columns="m", values="v").to_numpy() for p, g in df.toPandas().groupby("pair_id")}


def test_rounding_equals_spark(spark):
    v = [0.0, -0.0, 0.5000005, 0.1234565, -0.1234565, 2.5e-6, 0.9999995, -1.0000005, 123456.7890125, 1e9 + 1e-7, 1e300, float("inf"), float("nan"), None]
    v += np.random.default_rng(1).normal(size=500).tolist() + (np.random.default_rng(2).integers(0, 10**6, 500) / 1e6 + 5e-7).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, v double")
    got = Q.rounded(df).join(df.select("i", (F.round("v", 6) + F.lit(0.0)).alias("want")), "i")
    assert got.where("not v <=> want").count() == 0
    finite = np.array([x for x in v if x is not None and np.isfinite(x)])
    assert (B.round6(finite) == np.array([r[0] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(finite)], "i long, v double").orderBy("i").select(F.round("v", 6) + F.lit(0.0)).collect()])).all()


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev", "cosine", "dot", "cost_dot"])
def test_cells_are_made_in_bands(spark, monkeypatch, metric):
    monkeypatch.setattr(B, "BAND", 16)
    v, X = tracks(spark, [37, 16, 1])
    df = SM.pairwise(v, v, metric)
    assert nodes(df, "MapInArrow") and not nodes(df, "lambdafunction(aggregate")
    want = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)), "cityblock": lambda a, b: abs(a - b).sum(-1), "chebyshev": lambda a, b: abs(a - b).max(-1), "cosine": lambda a, b: 1 - (a * b).sum(-1), "dot": lambda a, b: (a * b).sum(-1), "cost_dot": lambda a, b: 1 - (a * b).sum(-1)}[metric]
    got = matrices(df)
    assert {t: M.shape for t, M in got.items()} == {"0": (37, 37), "1": (16, 16), "2": (1, 1)}
    for t, x in X.items():
        assert np.allclose(got[t], want(x[:, None], x[None]), atol=1e-12)


def test_frames_of_unlike_sizes_give_nulls(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [1.0]), ("a", 5, [None, 1.0])], "track_id string, n long, vec array<double>")
    got = {(r["n"], r["m"]): r["v"] for r in SM.pairwise(v, v, "dot").collect()}
    assert got == {(0, 0): 5.0, (1, 1): 1.0} | {(a, b): None for a in (0, 1, 5) for b in (0, 1, 5) if (a, b) not in ((0, 0), (1, 1))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["filter_diag", "sm_ti_forward_backward", "sm_ti_shifts", "time_lag", "threshold_relative_scaled", "threshold_local", "novelty_structure", "novelty_checkerboard"])
def test_matrix_queries_in_bands(spark, monkeypatch, name):
    """Bands of few rows, coarse classes of few values: the SQL's rows, without a window over cells."""
    monkeypatch.setattr(B, "BAND", 16)
    df = Q.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    close(df.toPandas(), con.execute(Q.ORACLE_SQL[name]).df())
    assert nodes(df, "MapInArrow") >= 3 and nodes(df, "Window [sum(v") == nodes(df, "Window [max(n") == nodes(df, "Window [lead(v") == 0


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (40, 33), (25, 60)])
def test_sweeps_equal_whole_matrices(monkeypatch, shape):
    """Paths through many kept anti-diagonals, with ties, against the kernels that hold the matrix."""
    monkeypatch.setattr(SW, "EVERY", 7)
    rng = np.random.default_rng(sum(shape))
    for trial in range(6):
        X, Y = (rng.integers(0, 3, (n, 4)) / 2 if trial % 2 else rng.random((n, 4)) for n in shape)
        dots = SW.Dots(X, Y)
        C = np.array([[dots(n + m, n, n)[0] for m in range(shape[1])] for n in range(shape[0])])
        for steps in (K.CLASSIC, K.STEPS_21, K.STEPS_ALL):
            D = K.accumulate(1.0 - C, steps)
            assert SW.warping_path(X, Y, steps) == (K.warping_path(D, steps), D[-1, -1])
        score = lambda d, low, high: dots(d, low, high) - 0.8  # noqa: B023, E731
        D = K.common_subsequence(C - 0.8)
        assert SW.common_subsequence(*shape, score) == (K.common_subsequence_path(D), D.max())
        D, pairs = K.partial_matching(C - 0.8)
        assert SW.partial_matching(*shape, score) == (pairs, D[-1, -1])


def test_alignment_sends_frames_not_cells(spark):
    v, _ = tracks(spark, [30, 41])
    pairs = spark.createDataFrame([("p", "0", "1")], "pair_id string, x_id string, y_id string")
    cost = SM.pairwise(v, v, "cost_dot", pairs)
    df = S.dtw_frames(v, v, pairs)
    assert df.orderBy("idx").collect() == S.dtw(cost).orderBy("idx").collect()
    assert not nodes(df, "Generate") and not nodes(df, "FlatMapGroups")
    score = SM.threshold(Q.rounded(SM.pairwise(v, v, "dot", pairs)), 0.15, "relative", True, -2.0)
    for new, old in ((S.common_subsequence_frames, S.common_subsequence), (S.partial_matching_frames, S.partial_matching)):
        assert new(v, v, pairs, 0.15, -2.0).orderBy("idx").collect() == old(score).orderBy("idx").collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["template_pitch_onset", "score_chroma", "notes_to_pitch", "activation_score_onset", "nmf_activation", "notes_to_chroma", "template_pitch"])
def test_notes_stay_in_partitions_by_track(spark, monkeypatch, name):
    """One shuffle, of notes, into partitions of a fixed size; the SQL's rows."""
    monkeypatch.setattr(Q.A, "PART_BYTES", 20_000)
    df = Q.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    close(df.toPandas(), con.execute(Q.ORACLE_SQL[name]).df())
    import re

    exchanges = set(re.findall(r"Exchange ([a-z]+\(track_id)#\d+, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))
    assert {how for how, _ in exchanges} == {"hashpartitioning(track_id"} and all(int(p) > 8 for _, p in exchanges)


def test_synthetic_matrix_is_painted_per_track(spark, monkeypatch):
    """Pairs of segments in order, a path over its block, the diagonal over all; only segments are shuffled."""
    rng = np.random.default_rng(5)
    data = [(t, int(s), int(s + rng.integers(0, 6)), "ab"[int(rng.integers(0, 2))]) for t in "xy" for s in rng.integers(0, 30, 8)]
    df = SM.synthetic_ssm(spark.createDataFrame(data, "track_id string, start int, end int, label string"))
    assert nodes(df, "MapInArrow") == 1 and not nodes(df, "SortMergeJoin") and not nodes(df, "max(w")
    want = {}
    for t in "xy":
        mine = sorted(d[1:] for d in data if d[0] == t)
        for s, e, label in mine:
            for s2, e2, other in mine:
                if label == other:
                    want |= {(t, n, m): 0.5 for n in range(s, e + 1) for m in range(s2, e2 + 1)}
                    one, two = e - s + 1, e2 - s2 + 1
                    for i in range(max(one, two)):
                        want[(t, s + i, s2 + int(i * (two / one))) if one >= two else (t, s + int(i * (one / two)), s2 + i)] = 1.0
        want |= {(t, n, n): 1.0 for n in range(max(e for _, e, _ in mine) + 1)}
    monkeypatch.setattr(B, "CELLS", 64)
    assert {(r["track_id"], r["n"], r["m"]): r["v"] for r in df.collect()} == want
    got = [g for g in SM._painted(sorted(d[1:] for d in data if d[0] == "x"), 1.0, 0.5, True, True, True)]
    assert len(got) > 5 and {("x", int(n[i]), m + j): V[i, j] for n, m, V, has in got for i, j in zip(*np.nonzero(has), strict=True)} == {k: v for k, v in want.items() if k[0] == "x"}


def test_scape_plot_of_frames_equals_that_of_cells(spark):
    v, X = tracks(spark, [13, 1, 21])
    cells = SM.normalize_diagonal(SM.threshold(SM.pairwise(v, v, "dot"), 0.3, "relative", True, -2.0))
    rows = lambda df: df.orderBy("pair_id", "length_m1", "start").collect()
    df = S.scape_plot_frames(v, 0.3, -2.0)
    assert rows(df) == rows(S.scape_plot(cells)) and not nodes(df, "Window")
    for at in (0, 7, 440):
        dots = X["2"] @ X["2"].T - 0.5
        assert SW.order_statistic(lambda: (dots[i : i + 4] for i in range(0, 21, 4)), at) == np.sort(dots.ravel())[at]  # noqa: B023
