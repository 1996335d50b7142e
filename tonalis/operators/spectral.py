"""Spectra and signals: STFT, inverse STFT, splines, masks, source separation, per track in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .sequences import BY, matrix, per_group


def _signal(pdf: pd.DataFrame) -> np.ndarray:
    x = np.zeros(int(pdf["n"].max()) + 1)
    x[pdf["n"].to_numpy(np.int64)] = pdf["x"].to_numpy(float)
    return x


def _long(X: np.ndarray) -> pd.DataFrame:
    k, n = np.indices(X.shape)
    return pd.DataFrame({"n": n.ravel(), "k": k.ravel().astype(np.int32), "re": X.real.ravel(), "im": X.imag.ravel()})


def stft(signal: DataFrame, N: int = 2048, H: int = 512, kind: str = "hann", center: bool = True, zero_padding: int = 0, positive: bool = True) -> DataFrame:
    """track, n (frame), k, re, im of each signal."""
    w = K.window(kind, N)
    return per_group(signal, BY, lambda pdf: _long(K.stft(_signal(pdf), w, H, center, zero_padding, positive)), "n long, k int, re double, im double")


def stft_chunked(signal: DataFrame, N: int, H: int, kind: str = "hann", frames_per_task: int = 4096, center: bool = True) -> DataFrame:
    """STFT of very long signals: blocks of frames are tasks of their own, with the samples they share."""
    w, pad, block = K.window(kind, N), N // 2 if center else 0, frames_per_task * H
    total = signal.groupBy(BY).agg((F.max("n") + 1).alias("_L"))
    at = F.col("n") + pad
    blocks = F.sequence(F.greatest(F.floor((at - N + 1) / block), F.lit(0)), F.floor(at / block))
    spread = signal.join(total, BY).withColumn("_b", F.explode(blocks)).withColumn("_key", F.concat_ws(":", BY, "_b"))

    def run(pdf):
        b, L = int(pdf["_b"].iloc[0]), int(pdf["_L"].iloc[0]) + 2 * pad
        first, last = b * frames_per_task, min((b + 1) * frames_per_task, (L - N) // H + 1)
        if last <= first:
            return _long(np.zeros((N // 2 + 1, 0), complex)).assign(track=None)
        x = np.zeros((last - first - 1) * H + N)
        i = pdf["n"].to_numpy(np.int64) + pad - first * H
        ok = (i >= 0) & (i < len(x))
        x[i[ok]] = pdf["x"].to_numpy(float)[ok]
        out = _long(K.stft(x, w, H, center=False))
        return out.assign(n=out["n"] + first, track=pdf[BY].iloc[0])

    return per_group(spread, "_key", run, "n long, k int, re double, im double, track string").select(F.col("track").alias(BY), "n", "k", "re", "im")


def power(spectrum: DataFrame, gamma: float = 0.0) -> DataFrame:
    """Power of each coefficient, with log compression if gamma > 0: track, n, k, v."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return spectrum.select(BY, "n", "k", (F.log1p(p * gamma) if gamma > 0 else p).alias("v"))


def magnitude(spectrum: DataFrame) -> DataFrame:
    return spectrum.select(BY, "n", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))


def istft(spectrum: DataFrame, lengths: DataFrame, N: int, H: int, kind: str = "hann", center: bool = True, squared: bool = False, positive: bool = True) -> DataFrame:
    """track, n, x, x_sum, w_sum; ``lengths``: (track_id, L)."""
    w = K.window(kind, N)

    def run(pdf):
        X = _complex(pdf, N, positive)
        x, s, ws = K.istft(X, w, H, int(pdf["L"].iloc[0]), center, squared, positive)
        return pd.DataFrame({"n": np.arange(len(x)), "x": x, "x_sum": s, "w_sum": ws})

    return per_group(spectrum.join(lengths, BY), BY, run, "n long, x double, x_sum double, w_sum double")


def _complex(pdf: pd.DataFrame, N: int, positive: bool = True) -> np.ndarray:
    shape = (N // 2 + 1 if positive else N, int(pdf["n"].max()) + 1)
    return matrix(pdf, "k", "n", "re", shape) + 1j * matrix(pdf, "k", "n", "im", shape)


def fft(signal: DataFrame, inverse: bool = False, scale: bool = True) -> DataFrame:
    """Transform of each whole signal (x, or re and im): track, k, re, im; lengths must be powers of two.

    The inverse divides by N unless ``scale`` is false.
    """

    def run(pdf):
        p = pdf.sort_values("n")
        x = p["x"].to_numpy(float) if "x" in p else p["re"].to_numpy(float) + 1j * p["im"].to_numpy(float)
        if len(x) & (len(x) - 1):
            raise ValueError("the signal's length must be a power of two")
        X = np.fft.ifft(x) * (1 if scale else len(x)) if inverse else np.fft.fft(x)
        return pd.DataFrame({"k": np.arange(len(X)), "re": X.real, "im": X.imag})

    return per_group(signal, BY, run, "k long, re double, im double")


def interpolate_freq(frames: DataFrame, old: list[float], new: list[float]) -> DataFrame:
    """Cubic spline of each frame along frequency, to a new axis: track, n, k, v."""
    a, b = np.array(old, float), np.array(new, float)

    def run(pdf):
        base = int(pdf["n"].min())
        Y = matrix(pdf.assign(n=pdf["n"] - base), "k", "n", shape=(len(a), int(pdf["n"].max()) - base + 1))
        Z = K.cubic_spline(a, Y, b)
        k, n = np.indices(Z.shape)
        return pd.DataFrame({"n": n.ravel() + base, "k": k.ravel().astype(np.int32), "v": Z.ravel()})

    return per_group(frames, BY, run, "n long, k int, v double")


def frequency_distribution(signal: DataFrame, Fs: float, N: int = 16384, gamma: float = 100.0, local: bool = True) -> DataFrame:
    """Overall distribution on a 1-cent grid from C1 to C8: track, i, v (before local rectification)."""
    f = lambda p: 440.0 * 2 ** ((p - 69) / 12)
    count = int(np.ceil(1200 * np.log2(f(108) / f(24))))
    grid = f(24) * 2.0 ** (np.arange(count) / 1200)

    def run(pdf):
        x = _signal(pdf)
        if local:
            if N > len(x) // 2:
                raise ValueError("the signal must be twice as long as the window")
            Y = np.log1p(gamma * np.abs(K.stft(x, K.window("hann", N), N // 2)) ** 2).sum(1)
            axis = np.arange(len(Y)) * Fs / N
        else:
            Y = np.log1p(gamma * np.abs(np.fft.rfft(x)) / Fs)
            axis = np.arange(len(Y)) * Fs / len(x)
        return pd.DataFrame({"i": np.arange(count), "v": K.cubic_spline(axis, Y, grid)})

    return per_group(signal, BY, run, "i long, v double")


def hps(signal: DataFrame, Fs: float, N: int, H: int, L_h: float, L_p: float, physical: bool = True, mask: str = "binary", eps: float = 1e-5, beta: float | None = None) -> DataFrame:
    """Harmonic and percussive parts (and with ``beta`` a residual) of each signal: track, n, h, p[, r].

    Spectrum, masks and resynthesis stay in one task, so spectra are never shuffled.
    """
    width_h = int(np.ceil(L_h * Fs / H)) if physical else int(L_h)
    width_p = int(np.ceil(L_p * N / Fs)) if physical else int(L_p)
    width_h, width_p = width_h + 1 - width_h % 2, width_p + 1 - width_p % 2
    names = ["h", "p"] + (["r"] if beta is not None else [])

    def medians(Y, size, axis):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(Y, pad), size, axis=axis), axis=-1)

    def run(pdf):
        x, w = _signal(pdf), K.window("hann", N)
        X = K.stft(x, w, H)
        Y = np.abs(X) ** 2
        h, p = medians(Y, width_h, 1), medians(Y, width_p, 0)
        if beta is not None:
            masks = [(h >= beta * p).astype(float), (p > beta * h).astype(float)]
            masks.append(1 - masks[0] - masks[1])
        elif mask == "binary":
            masks = [(h >= p).astype(float), (h < p).astype(float)]
        else:
            masks = [(h + eps / 2) / (h + p + eps), (p + eps / 2) / (h + p + eps)]
        out = {"n": np.arange(len(x))}
        for name, m in zip(names, masks, strict=True):
            out[name] = K.istft(X * m, w, H, len(x), squared=True)[0]
        return pd.DataFrame(out)

    return per_group(signal, BY, run, "n long, " + ", ".join(f"{c} double" for c in names))


def sweep(signal: DataFrame, Fs: float, params: list[dict]) -> DataFrame:
    """hps for each set of parameters (with their own N and H): adds ``setting``."""
    out = None
    for i, p in enumerate(params):
        one = hps(signal, Fs, **p).withColumn("setting", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def separate_melody(signal: DataFrame, trajectory: DataFrame, Fs: float, N: int, H: int, harmonics: int = 10, tol_cent: float = 50.0) -> DataFrame:
    """Melody and accompaniment by a mask around a trajectory (track, t, freq): track, n, melody, accompaniment."""
    traj = trajectory.groupBy(BY).agg(F.array_sort(F.collect_list(F.struct("t", "freq"))).alias("_t"))

    def run(pdf):
        x, w = _signal(pdf), K.window("hann", N)
        X = K.stft(x, w, H)
        got = pdf["_t"].iloc[0]
        t, f = np.array([r["t"] for r in got]), np.array([r["freq"] for r in got])
        frames = np.arange(X.shape[1]) * H / Fs
        j = np.clip(np.searchsorted(t, frames), 1, max(1, len(t) - 1))
        near = np.where((frames - t[j - 1]) <= (t[np.minimum(j, len(t) - 1)] - frames), j - 1, np.minimum(j, len(t) - 1))
        m = K.trajectory_mask(f[near], np.arange(X.shape[0]) * Fs / N, harmonics, None, tol_cent)
        mel, acc = (K.istft(X * a, w, H, len(x), squared=True)[0] for a in (m, 1 - m))
        return pd.DataFrame({"n": np.arange(len(x)), "melody": mel, "accompaniment": acc})

    return per_group(signal.join(traj, BY), BY, run, "n long, melody double, accompaniment double")


def trajectory_mask(trajectory: DataFrame, Fs: float, N: int, harmonics: int = 1, tol_bin: int | None = None, tol_cent: float = 0.0) -> DataFrame:
    """Cells (track, n, k) around the harmonics of a trajectory (track, n, freq)."""
    axis = np.arange(N // 2 + 1) * Fs / N

    def run(pdf):
        p = pdf.sort_values("n")
        k, n = np.nonzero(K.trajectory_mask(p["freq"].to_numpy(float), axis, harmonics, tol_bin, tol_cent))
        return pd.DataFrame({"n": p["n"].to_numpy()[n], "k": k.astype(np.int32)})

    return per_group(trajectory, BY, run, "n long, k int")


def sonify_trajectory(trajectory: DataFrame, length: int, Fs: float = 22050, amplitude: float = 0.3, smooth_len: int = 11) -> DataFrame:
    def run(pdf):
        p = pdf.sort_values("t")
        x = K.sonify_trajectory(p["t"].to_numpy(float), p["freq"].to_numpy(float), length, Fs, amplitude, smooth_len)
        return pd.DataFrame({"n": np.arange(length), "x": x})

    return per_group(trajectory, BY, run, "n long, x double")


def sonify_frames(frames: DataFrame, length: int, frame_rate: float, Fs: float, chroma: bool = True, min_pitch: int = 1, harmonics=(1.0,), fading_msec: float = 5) -> DataFrame:
    """Sound of chroma or pitch activations (track, n, k, v): track, n, x."""

    def run(pdf):
        P = matrix(pdf, "k", "n", shape=(12 if chroma else int(pdf["k"].max()) + 1, int(pdf["n"].max()) + 1))
        x = K.sonify_chroma(P, length, frame_rate, Fs, fading_msec) if chroma else K.sonify_pitches(P, length, frame_rate, Fs, min_pitch, 440, harmonics, fading_msec)
        return pd.DataFrame({"n": np.arange(length), "x": x})

    return per_group(frames, BY, run, "n long, x double")


def mix_with_signal(sound: DataFrame, signal: DataFrame, peak: bool = True) -> DataFrame:
    """Loudness-matched sound beside the signal: track, n, left (signal), right (sound), mono."""
    from pyspark.sql import Window

    w = Window.partitionBy(BY)
    both = signal.select(BY, "n", F.col("x").alias("left")).join(sound.select(BY, "n", F.col("x").alias("_s")), [BY, "n"])
    ratio = F.sqrt(F.avg(F.col("left") * F.col("left")).over(w)) / F.sqrt(F.avg(F.col("_s") * F.col("_s")).over(w))
    out = both.withColumn("right", F.col("_s") * F.coalesce(ratio, F.lit(0.0))).drop("_s").withColumn("mono", F.col("left") + F.col("right"))
    if not peak:
        return out
    top = F.greatest(F.max(F.abs("left")).over(w), F.max(F.abs("right")).over(w))
    mono = F.max(F.abs("mono")).over(w)
    return out.withColumns({"left": F.try_divide("left", top), "right": F.try_divide("right", top), "mono": F.try_divide("mono", mono)})
