"""Composed analyses: from signals to chroma, matrices, chords, tempo, melody and versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate, features, interpolate, kernels, sequences, similarity, spectral, symbolic, windows

BY = ("track_id",)


def chromagram(signal: DataFrame, Fs: float = 22050, N: int = 4096, H: int = 2048, gamma: float | None = None, norm: str | None = "2") -> DataFrame:
    """STFT power pooled to pitches and folded to 12 classes: track, n, k, v."""
    power = spectral.power(spectral.stft(signal, N, H))
    out = features.densify(features.compute_chromagram(features.compute_spec_log_freq(power, Fs, N)), list(range(12)))
    if gamma:
        out = out.withColumn("v", C.log_compression("v", gamma))
    return features.normalize_feature_sequence(out, norm) if norm else out


def stft_power(signal: DataFrame, N: int, H: int, gamma: float = 0.0) -> DataFrame:
    return spectral.power(spectral.stft(signal, N, H), gamma)


def cens(signal: DataFrame, Fs: float = 22050, N: int = 4410, H: int = 2205, ell: int = 21, d: int = 5) -> DataFrame:
    return features.compute_cens(chromagram(signal, Fs, N, H, norm=None), ell, d)


def self_similarity(chroma: DataFrame, L: int = 21, H: int = 5, L_smooth: int = 16, tempi=(1.0,), shifts=(0,), strategy: str = "relative", scale: bool = True, thresh: float = 0.15, penalty: float = 0.0, binarize: bool = False) -> DataFrame:
    """Smoothed features to an enhanced and thresholded self-similarity matrix."""
    x = features.normalize_feature_sequence(windows.smooth_downsample(chroma, L, H), "2", 0.001)
    v = similarity.vectors(x)
    s = similarity.sm_ti(v, v, L_smooth, list(tempi), list(shifts), 2)
    return similarity.threshold(s, thresh, strategy, scale, penalty, binarize)


def version_matrix(x: DataFrame, y: DataFrame, ell: int = 21, d: int = 5, L_smooth: int = 12, tempi=(0.66, 0.81, 1, 1.22, 1.5), shifts=(0,), strategy: str = "relative", scale: bool = True, thresh: float = 0.15, penalty: float = -2.0, binarize: bool = False) -> DataFrame:
    """Score matrix of two chroma sequences per track, with a penalty for unlike cells."""
    a, b = (similarity.vectors(features.compute_cens(c, ell, d)) for c in (x, y))
    return similarity.threshold(similarity.sm_ti(a, b, L_smooth, list(tempi), list(shifts), 2), thresh, strategy, scale, penalty, binarize)


def chord_recognition(chroma: DataFrame, reference: DataFrame | None = None, p: float = 0.15, filt_len: int | None = None, filt_type: str = "mean") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Chords by templates and by decoding, each (track, n, k), and their measures against ``reference``."""
    if filt_len:
        smooth = windows.smooth_downsample if filt_type == "mean" else windows.median_downsample
        chroma = smooth(chroma, filt_len, 1)
    best = symbolic.chord_recognition(chroma).select(*BY, "n", F.col("chord_idx").alias("k"))
    A = np.full((24, 24), (1 - p) / 23)
    np.fill_diagonal(A, p)
    decoded = sequences.viterbi_likelihood(symbolic.chord_similarity(chroma), A, np.full(24, 1 / 24)).select(*BY, "n", F.col("state").alias("k"))
    if reference is None:
        return best, decoded, None
    scores = evaluate.eval_measures(reference, best).withColumn("method", F.lit("template")).unionByName(evaluate.eval_measures(reference, decoded).withColumn("method", F.lit("hmm")))
    return best, decoded, scores


def novelty(signal: DataFrame, kind: str = "spectrum", **params) -> DataFrame:
    """Novelty curve of a kind: energy, spectrum, phase or complex."""
    if kind == "energy":
        return features.novelty_energy(signal, **params)
    N, H = params.pop("N", 1024), params.pop("H", 256 if kind == "spectrum" else 64)
    spectrum = spectral.stft(signal, N, H)
    if kind == "spectrum":
        return features.novelty_spectrum(spectral.magnitude(spectrum), **params)
    return {"phase": features.novelty_phase, "complex": features.novelty_complex}[kind](spectrum, **params)


def tempogram_pulse(novelty: DataFrame, Fs: float, N: int = 500, H: int = 10, thetas=tuple(range(30, 601)), prominence: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fourier tempogram, predominant local pulse and its prominent peaks."""
    tempogram = features.tempogram_fourier(novelty, Fs, N, H, list(thetas))
    lengths = novelty.groupBy(*BY).agg((F.max("n") + 1).alias("L"))
    pulse = features.plp(tempogram, Fs, N, H, lengths)
    return tempogram, pulse, sequences.peaks_prominent(pulse, prominence)


def tempo_curve(notes: DataFrame, chroma: DataFrame, Fs_X: float, Fs_beat: float = 10, shift: int = 0, win_len_beat: float = 4) -> DataFrame:
    """Tempo over score time from the alignment of a score with a recording's chroma: track, n, beat, bpm."""
    x = similarity.vectors(features.cyclic_shift(chroma, shift)).withColumn("vec", F.col("vec"))
    score = features.densify(symbolic.score_chromagram(notes, Fs_beat), list(range(12)))
    last = score.groupBy(*BY).agg(F.max("n").alias("_l"))
    every = last.select(*BY, F.explode(F.sequence(F.lit(0).cast("long"), "_l")).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    score = every.join(score, [*BY, "n", "k"], "left").select(*BY, "n", "k", F.coalesce("v", F.lit(0.0)).alias("v"))
    cost = similarity.pairwise(x, similarity.vectors(score), "euclidean")
    path = sequences.strict_path(sequences.dtw(cost, kernels.STEPS_ALL))
    known = path.select(F.col("pair_id").alias("track_id"), (F.col("m") / float(Fs_beat)).alias("t"), (F.col("n") / float(Fs_X)).alias("x"))
    grid = score.select(*BY, "n").distinct().withColumn("t", F.col("n") / float(Fs_beat))
    sec = interpolate.at_times(known, grid).select(*BY, "n", "x")
    w = Window.partitionBy(*BY).orderBy("n")
    step = F.lead("x").over(w) - F.col("x")
    sec = sec.withColumn("_d", step).withColumn("x", F.coalesce("_d", F.lag("_d").over(w)) * Fs_beat).drop("_d")
    win = np.hanning(int(win_len_beat * Fs_beat))
    smooth = windows.fir(sec, win / win.sum(), "x", "y", BY, "n", "reflect")
    return smooth.select(*BY, "n", (F.col("n") / float(Fs_beat)).alias("beat"), F.try_divide(F.lit(60.0), F.col("y")).alias("bpm"))


def melody_trajectory(signal: DataFrame, Fs: float = 22050, N: int = 1024, H: int = 128, R: float = 10.0, F_min: float = 55.0, F_max: float = 1760.0, num_harm: int = 10, freq_smooth_len: int = 11, alpha: float = 0.9, gamma: float = 0.0, regions: DataFrame | None = None, tol: int = 5, low: float = 0.01, high: float = 1.0) -> DataFrame:
    """F0 trajectory: track, n, t, freq (0: unvoiced)."""
    z = features.compute_salience(spectral.stft(signal, N, H), Fs, N, H, R, F_min, F_max, num_harm, freq_smooth_len, alpha, gamma)
    path = sequences.trajectory(z, tol, low, high, features._bins(F_max, R, F_min), regions, Fs, H, R, F_min)
    freq = F.when(F.col("k") < 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("k") * R / 1200) * F_min)
    return path.select(*BY, "n", (F.col("n") * H / float(Fs)).alias("t"), freq.alias("freq"))


def melody_separation(signal: DataFrame, Fs: float, N: int, H: int, trajectory: DataFrame, harmonics: int = 10, tol_cent: float = 50.0) -> DataFrame:
    return spectral.separate_melody(signal, trajectory.select(*BY, "t", "freq"), Fs, N, H, harmonics, tol_cent)


def thumbnail(ssm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scape plot of each normalised matrix, and its fittest segment."""
    scape = sequences.scape_plot(similarity.normalize_diagonal(ssm))
    return scape, sequences.best_segment(scape)


def tuning(signal: DataFrame, Fs: float, N: int = 16384, gamma: float = 100.0, local: bool = True, filt: bool = True, filt_len: int = 101) -> DataFrame:
    """Similarity of the frequency distribution with combs for each offset in cents."""
    v = spectral.frequency_distribution(signal, Fs, N, gamma, local)
    v = features.local_rectify(v, filt_len) if filt else v.withColumn("v", windows.normalize_by_max("v", BY))
    return features.tuning_similarity(v, 8400)
