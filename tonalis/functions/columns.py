"""Scalar functions of music analysis as Column expressions (JVM only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROMA = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def f_pitch(p, pitch_ref: float = 69, freq_ref: float = 440.0) -> Column:
    """MIDI pitch to Hz."""
    return F.pow(F.lit(2.0), (col(p) - pitch_ref) / 12) * freq_ref


def log2_ratio(a, b) -> Column:
    return F.log2(col(a) / col(b))


def difference_cents(freq_1, freq_2) -> Column:
    return log2_ratio(freq_1, freq_2) * 1200


def hz_to_cents(freq, freq_ref: float = 55.0) -> Column:
    return F.log2(col(freq) / freq_ref) * 1200


def cents_to_hz(cents, freq_ref: float = 55.0) -> Column:
    return F.pow(F.lit(2.0), col(cents) / 1200) * freq_ref


def note_name(p) -> Column:
    """Pitch name with octave, as C4 for 60; sharps for the black keys."""
    names = F.array(*[F.lit(x) for x in CHROMA])
    p = col(p)
    return F.concat(F.get(names, F.pmod(p, F.lit(12)).cast("int")), (F.floor(p / 12) - 1).cast("string"))


def chroma_name(k) -> Column:
    return F.get(F.array(*[F.lit(x) for x in CHROMA]), F.pmod(col(k), F.lit(12)).cast("int"))


def frequency_to_bin_index(freq, R: float = 10.0, F_ref: float = 55.0) -> Column:
    """Nearest log-frequency bin (half up); null for frequencies of 0 or less."""
    return F.floor(F.log2(col(freq) / F_ref) * (1200 / R) + 0.5)


def in_bin(bin_index, freq, R: float = 10.0, F_ref: float = 55.0) -> Column:
    """Whether a frequency (also an instantaneous one) falls in a bin: p_bin and p_bin_if."""
    return F.coalesce(frequency_to_bin_index(freq, R, F_ref) == col(bin_index), F.lit(False))


def f_coef(k, Fs: float, N: int) -> Column:
    """Frequency of a Fourier coefficient."""
    return col(k) * (Fs / N)


def t_coef(n, Fs: float, H: int) -> Column:
    return col(n) * H / Fs


def encoding_mu_law(v, mu: float = 255.0) -> Column:
    v = col(v)
    return F.signum(v) * (F.log1p(F.abs(v) * mu) / math.log1p(mu))


def decoding_mu_law(v, mu: float = 255.0) -> Column:
    v = col(v)
    return F.signum(v) * (F.pow(F.lit(1 + mu), F.abs(v)) - 1) / mu


def quantize_uniform(x, quant_min: float = -1.0, quant_max: float = 1.0, quant_level: int = 5) -> Column:
    """Clamp to the range and round to the nearest of ``quant_level`` levels (half to even)."""
    scaled = (col(x) - quant_min) * (quant_level - 1) / (quant_max - quant_min)
    level = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(float(quant_level - 1)), scaled)))
    return level * (quant_max - quant_min) / (quant_level - 1) + quant_min


def quantize_nonuniform_mu(x, mu: float = 255.0, quant_level: int = 256) -> Column:
    return decoding_mu_law(quantize_uniform(encoding_mu_law(x, mu), -1, 1, quant_level), mu)


def log_compression(v, gamma: float = 1.0) -> Column:
    return F.log1p(col(v) * gamma)


def principal_argument(v) -> Column:
    """Phase in turns wrapped to [-0.5, 0.5)."""
    return F.pmod(col(v) + 0.5, F.lit(1.0)) - 0.5


def power_to_db(power, ref: float = 1e-12) -> Column:
    """Decibels; negative infinity for no power."""
    p = col(power) / ref
    return F.when(p > 0, F.log10(p) * 10).otherwise(F.lit(float("-inf")))


def beat_period_to_tempo(beat, Fs: float) -> Column:
    """BPM of a period in samples; null for a period of 0."""
    return F.try_divide(F.lit(60.0 * Fs), col(beat))


def beat_penalty(t, beat_ref: float) -> Column:
    """Penalty of a beat distance; 0 at distance 0."""
    t = col(t)
    return F.when(t > 0, -F.pow(F.log2(t / beat_ref), 2)).otherwise(F.lit(0.0))


def make_integer_odd(n) -> Column:
    n = col(n).cast("int")
    return n + (1 - F.pmod(n, F.lit(2)))


def seconds_to_frames(sec, Fs: float = 22050, H: int = 512) -> Column:
    return F.ceil(col(sec) * (Fs / H)).cast("int")


def hertz_to_bins(hz, Fs: float = 22050, N: int = 1024) -> Column:
    return F.ceil(col(hz) * (N / Fs)).cast("int")


def equal_loudness(freq, ref: float = 1000.0) -> Column:
    """Equal loudness contour in dB relative to 1 kHz (rational weighting curve)."""

    def curve(f):
        s = f * f
        top = (1037918.48 - s) * (1037918.48 - s) + s * 1080768.16
        low = (9837328.0 - s) * (9837328.0 - s) + s * 11723776.0
        return f / 6.8966888496476e-5 * F.sqrt(top / low / ((s + 79919.29) * (s + 1345600.0)))

    return F.log10(F.abs(curve(F.lit(ref)) / curve(col(freq)))) * 20


def chord_label(label) -> Column:
    """Minor as ``m`` and flats as sharps, as in ``A#m`` for ``Bb:min``."""
    out = F.replace(col(label), F.lit(":min"), F.lit("m"))
    for flat, sharp in (("Db", "C#"), ("Eb", "D#"), ("Gb", "F#"), ("Ab", "G#"), ("Bb", "A#")):
        out = F.replace(out, F.lit(flat), F.lit(sharp))
    return out


def remove_digits(label) -> Column:
    return F.regexp_replace(col(label), r"\p{Nd}", "")


def instrument_name(*names) -> Column:
    """The first name that isn't empty, else Unknown."""
    return F.coalesce(*[F.nullif(col(n), F.lit("")) for n in names], F.lit("Unknown"))


def add(a, b=0, c=0) -> Column:
    return col(a) + col(b) + col(c)


def quantize_cens(v) -> Column:
    """Energy steps 0.05, 0.1, 0.2, 0.4 to 0..4; the last step is open above, negatives give 0."""
    v = col(v)
    return F.when(v >= 0.4, 4.0).when(v >= 0.2, 3.0).when(v >= 0.1, 2.0).when(v >= 0.05, 1.0).otherwise(0.0)


def quantize_steps(v, steps: list[tuple[float, float, float]], default: float = 0.0) -> Column:
    """Half-open steps (low, high, value)."""
    v, out = col(v), F.lit(float(default))
    for low, high, value in reversed(steps):
        out = F.when((v >= low) & (v < high), float(value)).otherwise(out)
    return out


def measure_p(tp, fp) -> Column:
    return F.coalesce(F.try_divide(col(tp), col(tp) + col(fp)), F.lit(0.0))


def measure_r(tp, fn) -> Column:
    return F.coalesce(F.try_divide(col(tp), col(tp) + col(fn)), F.lit(0.0))


def measure_f(p, r) -> Column:
    p, r = col(p), col(r)
    return F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))
