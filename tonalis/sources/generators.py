"""Signals from nothing: sinusoids, chirps, tones, envelopes, as expressions over ``range``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.features import phase_of_frequency

TAU = 2 * math.pi


def axis(spark: SparkSession, dur: float, Fs: float, track: str = "t0") -> DataFrame:
    """track_id, n, t."""
    return spark.range(int(Fs * dur)).select(F.lit(track).alias("track_id"), F.col("id").alias("n"), (F.col("id") / float(Fs)).alias("t"))


def _scaled(df: DataFrame, amp: float = 1.0, magnitude: bool = False) -> DataFrame:
    w = Window.partitionBy("track_id")
    top = F.max(F.abs("x") if magnitude else F.col("x")).over(w)
    return df.withColumn("x", F.coalesce(F.try_divide("x", top), F.lit(0.0)) * amp)


def _sum_of(waves: list[Column]) -> Column:
    out = waves[0]
    for w in waves[1:]:
        out = out + w
    return out


def sinusoid(spark, dur: float = 5, Fs: float = 1000, amp: float = 1, freq: float = 1, phase: float = 0, track: str = "t0") -> DataFrame:
    return axis(spark, dur, Fs, track).withColumn("x", F.sin((F.col("t") * freq - phase) * TAU) * amp)


def sinusoid_pitches(spark, pitches: list[float] = (69,), dur: float = 0.5, Fs: float = 4000, amp: float = 1, track: str = "t0") -> DataFrame:
    """One sinusoid after the other, scaled by the maximum."""
    N = int(dur * Fs)
    f = F.get(F.array(*[F.lit(440.0 * 2 ** ((p - 69) / 12)) for p in pitches]), (F.expr(f"id div {max(1, N)}")).cast("int"))
    out = spark.range(N * len(pitches)).select(F.lit(track).alias("track_id"), F.col("id").alias("n"), F.sin(f * (F.col("id") % N) * (TAU / Fs)).alias("x"))
    return _scaled(out, amp)


def sinusoid_scale(spark, pitches=(69,), duration: float = 0.5, Fs: float = 4000, amplitude_max: float = 0.5, track: str = "t0") -> DataFrame:
    return sinusoid_pitches(spark, pitches, duration, Fs, amplitude_max, track)


def sinusoid_chord(spark, pitches=(69,), duration: float = 1, Fs: float = 4000, amplitude_max: float = 0.5, track: str = "t0") -> DataFrame:
    waves = [F.sin(F.col("t") * (TAU * 440.0 * 2 ** ((p - 69) / 12))) for p in pitches]
    return _scaled(axis(spark, duration, Fs, track).withColumn("x", _sum_of(waves)), amplitude_max)


def shepard_tone(spark, freq: float = 440, dur: float = 0.5, Fs: float = 44100, amp: float = 1, track: str = "t0") -> DataFrame:
    """All octaves of a frequency between 20 Hz and 20 kHz."""
    octaves = [freq]
    while octaves[0] / 2 > 20:
        octaves.insert(0, octaves[0] / 2)
    while octaves[-1] * 2 < 20000:
        octaves.append(octaves[-1] * 2)
    return _scaled(axis(spark, dur, Fs, track).withColumn("x", _sum_of([F.sin(F.col("t") * (TAU * f)) for f in octaves])), amp)


def chroma_shepard_tone(spark, chroma: int, Fs: float, N: int, weight: float = 1, Fc: float = 440, sigma: float = 15, phase: float = 0, track: str = "t0") -> DataFrame:
    """Octaves of a chroma under a bell-shaped spectral envelope around pitch 60."""
    first = 24 + chroma - (12 if 24 + chroma > 32 else 0)
    t = F.col("t") + phase
    waves = [F.sin(t * (TAU * Fc * 2 ** ((p - 69) / 12))) * (weight * math.exp(-((p - 60) ** 2) / (2 * sigma**2)) / (math.sqrt(TAU) * sigma)) for p in range(first, 108, 12)]
    base = spark.range(N).select(F.lit(track).alias("track_id"), F.col("id").alias("n"), (F.col("id") / float(Fs)).alias("t"))
    return base.withColumn("x", _sum_of(waves))


def _octave_chirp(freq: float, dur: float) -> Column:
    return F.sin(F.pow(F.lit(2.0), F.col("t") / dur) * (TAU * freq * dur / math.log(2)))


def chirp_exp_octave(spark, freq_start: float = 440, dur: float = 8, Fs: float = 44100, amp: float = 1, track: str = "t0") -> DataFrame:
    return _scaled(axis(spark, dur, Fs, track).withColumn("x", _octave_chirp(freq_start, dur)), amp)


def shepard_glissando(spark, num_octaves: int = 3, dur_octave: float = 8, Fs: float = 44100, track: str = "t0") -> DataFrame:
    """Eleven octave chirps, each scaled to a maximum of 1, their mean repeated."""
    base = axis(spark, dur_octave, Fs, track)
    w = Window.partitionBy("track_id")
    for i in range(11):
        base = base.withColumn(f"_{i}", _octave_chirp(10.0 * 2**i, dur_octave))
    one = base.withColumn("x", _sum_of([F.col(f"_{i}") / F.max(f"_{i}").over(w) for i in range(11)]) / 11).select("track_id", "n", "x")
    N = int(Fs * dur_octave)
    return one.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(num_octaves - 1)))).select("track_id", (F.col("n") + F.col("_o") * N).alias("n"), "x").withColumn("t", F.col("n") / float(Fs))


def chirp_linear(spark, dur: float, freq_start: float, freq_end: float, amp: float = 1.0, Fs: float = 22050, track: str = "t0") -> DataFrame:
    a = (freq_end - freq_start) / dur / 2
    return axis(spark, dur, Fs, track).withColumn("x", F.sin((F.col("t") * F.col("t") * a + F.col("t") * freq_start) * TAU) * amp)


def _exp_freq(dur: float, freq_start: float, freq_end: float, Fs: float) -> Column:
    last = max(1, int(Fs * dur) - 1)
    return F.exp(F.col("n") * (math.log(freq_end / freq_start) / last)) * freq_start


def chirp_exp(spark, dur: float, freq_start: float, freq_end: float, Fs: float = 22050, track: str = "t0") -> DataFrame:
    """Phase is the exclusive prefix sum of the frequency: track_id, n, t, freq, x."""
    out = axis(spark, dur, Fs, track).withColumn("freq", _exp_freq(dur, freq_start, freq_end, Fs))
    return out.withColumn("x", F.sin(phase_of_frequency("freq", Fs)))


def chirp_exp_equal_loudness(spark, dur: float, freq_start: float, freq_end: float, Fs: float = 22050, track: str = "t0") -> DataFrame:
    out = chirp_exp(spark, dur, freq_start, freq_end, Fs, track).withColumn("loudness", C.equal_loudness("freq"))
    return out.withColumn("x", F.col("x") * F.pow(F.lit(10.0), F.col("loudness") / 20))


def equal_loudness_contour(spark, freq_min: float = 30, freq_max: float = 15000, num_points: int = 100) -> DataFrame:
    step = math.log10(freq_max / freq_min) / max(1, num_points - 1)
    out = spark.range(num_points).select(F.col("id").alias("i"), (F.pow(F.lit(10.0), F.col("id") * step) * freq_min).alias("freq"))
    return out.withColumn("loudness", C.equal_loudness("freq"))


def adsr(spark, len_A: int = 10, len_D: int = 10, len_S: int = 60, len_R: int = 10, height_A: float = 1.0, height_S: float = 0.5, track: str = "t0") -> DataFrame:
    """Attack, decay, sustain and release; attack and decay stop short of their ends, the release reaches 0."""
    d, s, r = len_A, len_A + len_D, len_A + len_D + len_S
    at = F.col("id")
    x = F.when(at < d, at * (height_A / max(1, len_A)))
    x = x.when(at < s, F.lit(float(height_A)) - (at - d) * ((height_A - height_S) / max(1, len_D)))
    x = x.when(at < r, F.lit(float(height_S))).otherwise(F.lit(float(height_S)) * (F.lit(1.0) - (at - r + 1) / max(1, len_R)))
    return spark.range(r + len_R).select(F.lit(track).alias("track_id"), F.col("id").alias("n"), x.alias("x"))


def vibrato(spark, dur: float = 5, Fs: float = 1000, amp: float = 0.5, freq: float = 440, vib_amp: float = 1, vib_rate: float = 5, track: str = "t0") -> DataFrame:
    out = axis(spark, dur, Fs, track).withColumn("freq", F.sin(F.col("t") * (TAU * vib_rate)) * vib_amp + freq)
    return out.withColumn("x", F.sin(phase_of_frequency("freq", Fs)) * amp)


def tremolo(spark, dur: float = 5, Fs: float = 1000, amp: float = 0.5, freq: float = 440, trem_amp: float = 0.1, trem_rate: float = 5, track: str = "t0") -> DataFrame:
    level = F.sin(F.col("t") * (TAU * trem_rate)) * trem_amp + amp
    return axis(spark, dur, Fs, track).withColumn("x", level * F.sin(F.col("t") * (TAU * freq)))


def tone(spark, p: float = 60, weights: list[float] = (1.0,) * 16, Fs: float = 11025, dur: float = 2, track: str = "t0") -> DataFrame:
    f = 440.0 * 2 ** ((p - 69) / 12)
    return axis(spark, dur, Fs, track).withColumn("x", _sum_of([F.sin(F.col("t") * (TAU * f * (h + 1))) * float(w) for h, w in enumerate(weights)]))


def three_sinusoids(spark, Fs: float, dur: float = 1, track: str = "t0") -> DataFrame:
    """Sum of three fixed sinusoids for trying out sampling and quantising."""
    t = F.col("t")
    x = F.sin(t * (2 * TAU)) + F.sin((t * 6 - 0.1) * TAU) * 0.5 + F.sin((t * 20 - 0.2) * TAU) * 0.1
    return axis(spark, dur, Fs, track).withColumn("x", x)


def interference(x1: DataFrame, x2: DataFrame) -> DataFrame:
    """Two signals and their sum."""
    b = x2.select("track_id", "n", F.col("x").alias("x2"))
    return x1.select("track_id", "n", F.col("x").alias("x1")).join(b, ["track_id", "n"]).withColumn("total", F.col("x1") + F.col("x2"))


def clicks(positions: DataFrame, length: int, Fs: float, freq: float = 1000.0, dur: float = 0.1) -> DataFrame:
    """Decaying clicks at times: track_id, n, x (silent samples have no row)."""
    N = int(dur * Fs)
    i = F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("i")
    rows = positions.select("track_id", F.rint(F.col("pos") * Fs).cast("long").alias("_s"), i)
    x = F.sin(F.col("i") * (TAU * freq / Fs)) * F.pow(F.lit(2.0), F.col("i") * (-10.0 / max(1, N - 1)))
    return rows.groupBy("track_id", (F.col("_s") + F.col("i")).alias("n")).agg(F.sum(x).alias("x")).where(f"n < {length}")
