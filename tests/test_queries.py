"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from tonalis import queries as Q
from tonalis import queries_more, queries_sequences  # noqa: F401  (they register more queries and SQL)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
NAMES = ["flagship_novelty_peaks", "pitch_scalars", "mu_law_and_quantize", "moving_windows", "smooth_downsample_hann", "median_downsample", "normalize_z", "peaks_boeck", "cens", "novelty_spectrum", "hps_masks", "resample_linear", "threshold_local", "novelty_checkerboard", "matching_function", "matching_diag", "score_chroma", "chord_recognition_template", "boundary_eval", "ranking_prf", "hmm_transitions", "istft_roundtrip", "streaming_hourly", "dtw", "dtw_21", "common_subsequence", "partial_matching", "viterbi", "stft_power", "plp", "tempogram_autocorr", "streaming_sessions", "frequency_scalars", "shepard_glissando", "chirp_exp_equal_loudness", "instantaneous_frequency", "log_frequency_bins_if", "activation_score_onset", "pairwise_codes", "eval_measures"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    plain = lambda x: None if x is None or x != x else float(x) if isinstance(x, (float, np.floating)) else x
    return sorted((tuple(map(plain, t)) for t in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
