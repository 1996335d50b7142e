"""Feature sequences in long form (track, n, k, v): pooling, folding, normalising, novelty, salience."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .windows import difference, exclusive_prefix_sum, fir, frames_of, half_wave, hann_symmetric, local_average, moving_sum, normalize_by_max, over, smooth_downsample, whole

BY = ("track_id",)


def densify(df: DataFrame, values: list[int], axis: str = "k", v: str = "v", keys=("track_id", "n")) -> DataFrame:
    """Every value of ``axis`` for each key; missing cells are 0."""
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in values])).alias(axis))
    return grid.join(df, [*keys, axis], "left").select(*keys, axis, F.coalesce(v, F.lit(0.0)).alias(v))


def pool_pitch(spark, Fs: float, N: int, pitch_ref: float = 69, freq_ref: float = 440.0) -> DataFrame:
    """Fourier bins k of each MIDI pitch p: f(p - 0.5) <= k Fs / N < f(p + 0.5).

    Each bin has one pitch, floor(pitch(freq) + 0.5) put right at the border, so no range join is needed.
    """
    freq = F.col("id") * (Fs / N)
    near = F.floor(F.log2(freq / freq_ref) * 12 + pitch_ref + 0.5)
    low, high = C.f_pitch(F.col("p") - 0.5, pitch_ref, freq_ref), C.f_pitch(F.col("p") + 0.5, pitch_ref, freq_ref)
    bins = spark.range(1, N // 2 + 1).select(F.col("id").cast("int").alias("k"), freq.alias("f"), near.alias("p"))
    fixed = bins.withColumn("p", F.when(F.col("f") < low, F.col("p") - 1).when(F.col("f") >= high, F.col("p") + 1).otherwise(F.col("p")))
    return fixed.where("p between 0 and 127").select("k", F.col("p").cast("int").alias("p"))


def compute_spec_log_freq(frames: DataFrame, Fs: float, N: int) -> DataFrame:
    """Sum of each pitch's Fourier bins; pitches 0 to 127, empty ones 0."""
    bins = pool_pitch(frames.sparkSession, Fs, N)  # at most N / 2 rows
    summed = frames.join(F.broadcast(bins), "k").groupBy("track_id", "n", F.col("p").alias("k")).agg(F.sum("v").alias("v"))
    grid = frames.select("track_id", "n").distinct().select("track_id", "n", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("k"))
    return grid.join(summed, ["track_id", "n", "k"], "left").select("track_id", "n", "k", F.coalesce("v", F.lit(0.0)).alias("v"))


def compute_chromagram(pitches: DataFrame) -> DataFrame:
    return pitches.groupBy("track_id", "n", F.pmod("k", F.lit(12)).cast("int").alias("k")).agg(F.sum("v").alias("v"))


def cyclic_shift(frames: DataFrame, shift: int = 1, bins: int = 12) -> DataFrame:
    return frames.withColumn("k", F.pmod(F.col("k") + shift, F.lit(bins)).cast("int"))


def normalize_feature_sequence(frames: DataFrame, norm: str = "2", threshold: float = 0.0001, v: str = "v", fallback: float | None = None) -> DataFrame:
    """Normalise each frame by its 1, 2, max or z norm; frames not above the threshold get a constant vector."""
    w = Window.partitionBy("track_id", "n")
    K = F.count(v).over(w)
    x = F.col(v)
    if norm == "1":
        size, unit = F.sum(F.abs(x)).over(w), 1.0 / K
    elif norm == "2":
        size, unit = F.sqrt(F.sum(x * x).over(w)), 1.0 / F.sqrt(K)
    elif norm == "max":
        size, unit = F.max(F.abs(x)).over(w), F.lit(1.0)
    elif norm == "z":
        size, unit = F.stddev_samp(x).over(w), F.lit(0.0)
        x = x - F.avg(x).over(w)
    else:
        raise ValueError(f"no norm {norm}")
    return frames.withColumn(v, F.when(size > threshold, x / size).otherwise(unit if fallback is None else F.lit(float(fallback))))


def compute_cens(chroma: DataFrame, ell: int = 41, d: int = 10, quant: bool = True) -> DataFrame:
    """CENS: 1-norm, quantisation, Hann smoothing and decimation, 2-norm."""
    out = normalize_feature_sequence(chroma, "1", 0.001)
    if quant:
        out = out.withColumn("v", C.quantize_cens("v"))
    return normalize_feature_sequence(smooth_downsample(out, ell, d, "hann"), "2", 0.001)


def novelty_tail(df: DataFrame, M: int, norm: bool, x: str = "x", by=BY) -> DataFrame:
    """Subtract the local average, rectify and divide by the maximum."""
    if M > 0:
        df = local_average(df, M, x, "_a", by).withColumn(x, half_wave(F.col(x) - F.col("_a"))).drop("_a")
    return df.withColumn(x, normalize_by_max(x, by)) if norm else df


def novelty_energy(signal: DataFrame, N: int = 2048, H: int = 128, gamma: float = 10.0, norm: bool = True, by=BY) -> DataFrame:
    """Local energy, decimated; logarithm, rectified difference, maximum norm."""
    w = hann_symmetric(N)
    energy = fir(signal.withColumn("_e", F.col("x") * F.col("x")), w * w, "_e", "_e", by).where(F.col("n") % H == 0)
    energy = energy.select(*by, F.expr(f"n div {H}").alias("n"), F.col("_e").alias("x"))
    if gamma is not None:
        energy = energy.withColumn("x", C.log_compression("x", gamma))
    out = energy.withColumn("x", half_wave(difference("x", by)))
    return out.withColumn("x", normalize_by_max("x", by)) if norm else out


def novelty_spectrum(magnitudes: DataFrame, gamma: float = 100.0, M: int = 10, norm: bool = True) -> DataFrame:
    """Spectral flux of magnitudes (track, n, k, v): a value per frame."""
    flux = magnitudes.withColumn("_y", C.log_compression("v", gamma)).withColumn("_d", half_wave(difference("_y", ("track_id", "k"))))
    return novelty_tail(flux.groupBy("track_id", "n").agg(F.sum("_d").alias("x")), M, norm)


def phase_turns() -> Column:
    return F.atan2("im", "re") / (2 * math.pi)


def novelty_phase(spectrum: DataFrame, M: int = 40, norm: bool = True) -> DataFrame:
    """Second differences of the phase, summed over bins; the last two frames count as 0."""
    w = over(("track_id", "k"))
    p = spectrum.withColumn("_p", phase_turns())
    p = p.withColumn("_d", C.principal_argument(F.lead("_p").over(w) - F.col("_p")))
    p = p.withColumn("_dd", C.principal_argument(F.lead("_d").over(w) - F.col("_d")))
    p = p.withColumn("_dd", F.when(F.lead("_p", 2).over(w).isNotNull(), F.abs("_dd")).otherwise(0.0))
    return novelty_tail(p.groupBy("track_id", "n").agg(F.sum("_dd").alias("x")), M, norm)


def novelty_complex(spectrum: DataFrame, gamma: float = 10.0, M: int = 40, norm: bool = True) -> DataFrame:
    """Distance of each coefficient from its prediction, where the magnitude doesn't fall.

    The prediction has the compressed magnitude, and is compared with the raw coefficient.
    """
    w = over(("track_id", "k"))
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    s = spectrum.withColumns({"_m": F.log1p(mag * gamma) if gamma > 0 else mag, "_p": phase_turns()})
    s = s.withColumn("_q", (F.col("_p") + F.coalesce(F.lead("_p").over(w) - F.col("_p"), F.lit(0.0))) * (2 * math.pi))
    dx, dy = F.col("_m") * F.cos("_q") - F.col("re"), F.col("_m") * F.sin("_q") - F.col("im")
    falls = F.coalesce(F.col("_m") < F.lag("_m").over(w), F.lit(False))
    s = s.withColumn("_v", F.when(falls, 0.0).otherwise(F.sqrt(dx * dx + dy * dy)))
    return novelty_tail(s.groupBy("track_id", "n").agg(F.sum("_v").alias("x")), M, norm)


def compute_if(spectrum: DataFrame, Fs: float, N: int, H: int) -> DataFrame:
    """Instantaneous frequency of each coefficient by phase differences; the first frame repeats the second's."""
    w = over(("track_id", "k"))
    p = spectrum.withColumn("_p", phase_turns())
    ahead = (F.col("k") * (Fs / N) + C.principal_argument(F.col("_p") - F.lag("_p").over(w) - F.col("k") * (H / N)) * (Fs / H))
    p = p.withColumn("_f", ahead)
    return p.withColumn("freq", F.coalesce("_f", F.lead("_f").over(w), F.col("k") * (Fs / N))).drop("_p", "_f")


def _bins(F_max: float, R: float, F_min: float) -> int:
    return math.floor(1200 / R * math.log2(F_max / F_min) + 0.5) + 1


def compute_y_lf_bin(frames: DataFrame, Fs: float, N: int, R: float = 10.0, F_min: float = 55.0, F_max: float = 1760.0) -> DataFrame:
    """Sums of Fourier bins by log-frequency bin; both frequency bounds included."""
    f = frames.withColumn("_f", C.f_coef("k", Fs, N)).where(f"_f >= {F_min} and _f <= {F_max}")
    return f.groupBy("track_id", "n", C.frequency_to_bin_index("_f", R, F_min).cast("int").alias("k")).agg(F.sum("v").alias("v"))


def compute_y_lf_if_bin(spectrum: DataFrame, Fs: float, N: int, H: int, R: float = 10.0, F_min: float = 55.0, F_max: float = 1760.0, gamma: float = 0.0) -> DataFrame:
    """Power (or compressed magnitude) by the log-frequency bin of the instantaneous frequency; upper bound excluded."""
    f = compute_if(spectrum, Fs, N, H).where(f"freq >= {F_min} and freq < {F_max}")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    v = power if gamma == 0 else F.log1p(F.sqrt(power) * gamma)
    return f.groupBy("track_id", "n", C.frequency_to_bin_index("freq", R, F_min).cast("int").alias("k")).agg(F.sum(v).alias("v"))


def harmonic_summation(frames: DataFrame, num_harm: int = 10, alpha: float = 1.0) -> DataFrame:
    """Sum over h of alpha^(h-1) times bin k h; each value is sent to the bins it is a harmonic of."""
    h = F.col("h")
    sent = frames.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(num_harm)))).where("k % h = 0")
    return sent.groupBy("track_id", "n", (F.col("k") / h).cast("int").alias("k")).agg(F.sum(F.col("v") * F.pow(F.lit(float(alpha)), h - 1)).alias("v"))


def harmonic_summation_lf(frames: DataFrame, R: float, num_harm: int = 10, alpha: float = 1.0) -> DataFrame:
    """Harmonic summation on log-frequency bins, at offsets floor(1200 log2(h) / R)."""
    steps = F.array(*[F.struct(F.lit(math.floor(math.log2(h) * 1200 / R)).alias("o"), F.lit(float(alpha) ** (h - 1)).alias("w")) for h in range(1, num_harm + 1)])
    sent = frames.withColumn("_s", F.explode(steps)).withColumn("k", F.col("k") - F.col("_s.o")).where("k >= 0")
    return sent.groupBy("track_id", "n", "k").agg(F.sum(F.col("v") * F.col("_s.w")).alias("v"))


def compute_salience(spectrum: DataFrame, Fs: float, N: int, H: int, R: float = 10.0, F_min: float = 55.0, F_max: float = 1760.0, num_harm: int = 10, freq_smooth_len: int = 11, alpha: float = 1.0, gamma: float = 0.0) -> DataFrame:
    """Salience: binning by instantaneous frequency, Hann smoothing over bins, harmonic summation."""
    binned = compute_y_lf_if_bin(spectrum, Fs, N, H, R, F_min, F_max, gamma)
    bins = _bins(F_max, R, F_min)
    grid = spectrum.select("track_id", "n").distinct().select("track_id", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("k"))
    dense = grid.join(binned, ["track_id", "n", "k"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    smooth = fir(dense, hann_symmetric(freq_smooth_len), "v", "v", ("track_id", "n"), "k")
    return harmonic_summation_lf(smooth, R, num_harm, alpha)


def tempogram_fourier(novelty: DataFrame, Fs: float, N: int, H: int, thetas: list[float], by=BY) -> DataFrame:
    """Windowed Fourier coefficients at tempi in BPM: track, frame, bpm, re, im (centred frames)."""
    half = N // 2
    f = frames_of(novelty, N, H, "x", by, pad=half)
    weight = 0.5 - F.cos(F.col("i") * (2 * math.pi / max(1, N - 1))) * 0.5
    tempi = F.explode(F.array(*[F.lit(float(t)) for t in thetas])).alias("bpm")
    t = F.col("frame") * H + F.col("i")
    rows = f.select(*by, "frame", (F.col("x") * weight).alias("wx"), t.alias("t"), tempi)
    angle = F.col("t") * F.col("bpm") * (2 * math.pi / 60 / Fs)
    return rows.groupBy(*by, "frame", "bpm").agg(F.sum(F.col("wx") * F.cos(angle)).alias("re"), (-F.sum(F.col("wx") * F.sin(angle))).alias("im"))


def autocorrelation_local(novelty: DataFrame, N: int, H: int, norm_sum: bool = True, by=BY) -> DataFrame:
    """Autocorrelation of each centred frame for lags 0 to N - 1: track, frame, lag, v.

    A frame's samples are one array, so the lags are computed within a row and not by a self-join.
    """
    half = N // 2
    f = frames_of(novelty, N, H, "x", by, pad=half)
    got = f.groupBy(*by, "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), "x"))).alias("m"))
    dense = got.withColumn("a", F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))))
    a = F.col("a")

    def at_lag(lag):
        pairs = F.zip_with(F.slice(a, 1, F.lit(N) - lag), F.slice(a, lag + 1, F.lit(N) - lag), lambda p, q: p * q)
        total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p)
        return total / (F.lit(N) - lag) if norm_sum else total

    lags = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), at_lag)
    return dense.select(*by, "frame", F.posexplode(lags).alias("lag", "v"))


def tempogram_autocorr(novelty: DataFrame, Fs: float, N: int, H: int, thetas: list[float], norm_sum: bool = False, by=BY) -> DataFrame:
    """Autocorrelation resampled from lags to tempi in BPM (linear, extended at the ends): track, frame, bpm, v."""
    from .interpolate import at_times

    keys = (*by, "frame")
    low, high = math.ceil(Fs * 60 / thetas[-1]), math.ceil(Fs * 60 / thetas[0])
    lags = autocorrelation_local(novelty, N, H, norm_sum, by).where(f"lag > 0 and lag between {low} and {high}")
    samples = lags.select(*keys, (F.lit(60.0 * Fs) / F.col("lag")).alias("t"), F.col("v").alias("x"))
    grid = samples.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(float(b)) for b in thetas])).alias("t"))
    return at_times(samples, grid, by=keys).select(*keys, F.col("t").alias("bpm"), F.col("x").alias("v"))


def cyclic_tempogram(tempogram: DataFrame, tempo_ref: float = 30, octave_bin: int = 40, octave_num: int = 4, by=BY) -> DataFrame:
    """Interpolate to ``octave_bin`` tempi per octave and average tempi an octave apart: track, frame, k, v."""
    from .interpolate import at_times

    keys = (*by, "frame")
    samples = tempogram.select(*keys, F.col("bpm").alias("t"), F.col("v").alias("x"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(octave_bin * octave_num - 1))).alias("b")
    grid = samples.select(*keys).distinct().select(*keys, bins).withColumn("t", F.pow(F.lit(2.0), F.col("b") / octave_bin) * tempo_ref)
    out = at_times(samples, grid, by=keys)
    return out.groupBy(*keys, (F.col("b") % octave_bin).alias("k")).agg(F.avg("x").alias("v"))


def plp(tempogram: DataFrame, Fs: float, N: int, H: int, lengths: DataFrame, by=BY) -> DataFrame:
    """Predominant local pulse: each frame's best sinusoid, overlapped, added and rectified.

    ``tempogram``: as tempogram_fourier gives it; ``lengths``: (track, L) of the novelty curves.
    """
    mag = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    best = tempogram.groupBy(*by, "frame").agg(F.max(F.struct(mag.alias("m"), (-F.col("bpm")).alias("b"), "re", "im")).alias("s"))
    i = F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("i")
    rows = best.select(*by, "frame", (-F.col("s.b")).alias("bpm"), (-F.atan2("s.im", "s.re") / (2 * math.pi)).alias("phase"), i)
    t = F.col("frame") * H + F.col("i")
    weight = 0.5 - F.cos(F.col("i") * (2 * math.pi / max(1, N - 1))) * 0.5
    kernel = weight * F.cos((t * F.col("bpm") / 60 / Fs - F.col("phase")) * (2 * math.pi))
    summed = rows.groupBy(*by, (t - N // 2).alias("n")).agg(F.sum(kernel).alias("x"))
    return summed.join(lengths, [*by]).where("n >= 0 and n < L").select(*by, "n", half_wave(F.col("x")).alias("x"))


def sinusoid_optimal(tempogram: DataFrame, Fs: float, N: int, H: int, by=BY) -> DataFrame:
    """The windowed cosine of each tempogram coefficient: track, frame, bpm, n, kernel (n relative to the curve)."""
    i = F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("i")
    rows = tempogram.select(*by, "frame", "bpm", (-F.atan2("im", "re") / (2 * math.pi)).alias("phase"), i)
    t = F.col("frame") * H + F.col("i")
    weight = 0.5 - F.cos(F.col("i") * (2 * math.pi / max(1, N - 1))) * 0.5
    return rows.select(*by, "frame", "bpm", (t - N // 2).alias("n"), (weight * F.cos((t * F.col("bpm") / 60 / Fs - F.col("phase")) * (2 * math.pi))).alias("kernel"))


def template_comb(spark, M: int, theta: int = 0) -> DataFrame:
    """0/1 comb with teeth at theta plus multiples of 100 within [0, M)."""
    o = F.col("id") - theta
    tooth = (F.pmod(o, F.lit(100)) == 0) & (o >= 0) & (o <= 100 * ((M - 1) // 100))
    return spark.range(M).select(F.col("id").alias("i"), tooth.cast("double").alias("v"))


def tuning_similarity(v: DataFrame, M: int, by=BY) -> DataFrame:
    """Comb similarity for offsets -50 to 49 cents, and whether it is the (first) best: track, theta, sim, best.

    ``v``: (track, i, v) on a 1-cent grid of length M.  Each value meets the combs it is a tooth of.
    """
    theta = F.pmod(F.col("i") + 50, F.lit(100)) - 50
    last = 100 * ((M - 1) // 100)
    sent = v.withColumn("theta", theta).where(((F.col("i") - F.col("theta")) >= 0) & ((F.col("i") - F.col("theta")) <= last))
    got = sent.groupBy(*by, "theta").agg(F.sum("v").alias("sim"))
    grid = v.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(-50).cast("long"), F.lit(49).cast("long"))).alias("theta"))
    out = grid.join(got, [*by, "theta"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0))).withColumn("sim", normalize_by_max("sim", by))
    first = F.min_by("theta", F.struct(-F.col("sim"), "theta")).over(whole(by))
    return out.withColumn("best", F.col("theta") == first)


def local_rectify(v: DataFrame, filt_len: int = 101, by=BY) -> DataFrame:
    """Subtract a moving mean over the axis, rectify, divide by the maximum (the tuning distribution's tail)."""
    out = v.withColumn("v", half_wave(F.col("v") - moving_sum("v", filt_len, by, "i") / filt_len))
    return out.withColumn("v", normalize_by_max("v", by))


def adaptive_windowing(frames: DataFrame, beats: DataFrame, neighborhood: float = 1.0, add_start: bool = False, add_end: bool = False) -> DataFrame:
    """Mean of each bin between consecutive beats (frames), shrunk by ``neighborhood``; at least one frame.

    Returns track, b (interval), start, end, k, v.  Frames find their intervals by exploding the
    intervals, not by an inequality join.
    """
    sizes = frames.groupBy("track_id").agg((F.max("n") + 1).alias("_L"))
    b = beats.select("track_id", F.col("pos").cast("long").alias("pos"))
    top = b.join(sizes, "track_id").withColumn("_max", F.max("pos").over(whole())).where("_max <= _L or pos < _L").select("track_id", "pos")
    if add_start:
        top = top.unionByName(sizes.select("track_id", F.lit(0).cast("long").alias("pos"))).distinct()
    if add_end:
        top = top.unionByName(sizes.select("track_id", F.col("_L").alias("pos"))).distinct()
    w = Window.partitionBy("track_id").orderBy("pos")
    spans = top.withColumns({"t": F.lead("pos").over(w), "b": (F.row_number().over(w) - 1).cast("long")}).where("t is not null")
    cut = F.floor((F.col("t") - F.col("pos") + 1) * ((1 - neighborhood) / 2))
    spans = spans.select("track_id", "b", (F.col("pos") + cut).alias("start"), (F.col("t") - cut).alias("end"))
    spans = spans.withColumn("end", F.when(F.col("start") == F.col("end"), F.col("end") + 1).otherwise(F.col("end")))
    each = spans.where("start < end").withColumn("n", F.explode(F.sequence("start", F.col("end") - 1)))
    return frames.join(each, ["track_id", "n"]).groupBy("track_id", "b", "start", "end", "k").agg(F.avg("v").alias("v"))


def hps_masks(power: DataFrame, L_h: int, L_p: int, mask: str = "binary", eps: float = 1e-5, beta: float | None = None) -> DataFrame:
    """Harmonic and percussive masks of a power spectrogram by two median filters: adds h, p (and r).

    ``mask``: binary or soft; with ``beta`` the three-way split with a residual.
    """
    from .windows import moving_median

    out = moving_median(power, L_h, "v", "_h", ("track_id", "k"), "n")
    out = moving_median(out, L_p, "v", "_p", ("track_id", "n"), "k")
    h, p = F.col("_h"), F.col("_p")
    if beta is not None:
        out = out.withColumns({"h": (h >= p * beta).cast("double"), "p": (p > h * beta).cast("double")})
        out = out.withColumn("r", 1.0 - (F.col("h") + F.col("p")))
    elif mask == "binary":
        out = out.withColumns({"h": (h >= p).cast("double"), "p": (h < p).cast("double")})
    elif mask == "soft":
        out = out.withColumns({"h": (h + eps / 2) / (h + p + eps), "p": (p + eps / 2) / (h + p + eps)})
    else:
        raise ValueError(f"no mask of type {mask}")
    return out.drop("_h", "_p")


def dft_small(signal: DataFrame, inverse: bool = False, norm: bool = True, by=BY) -> DataFrame:
    """DFT by its definition, divided by N if ``norm``: track, k, re, im.  For short signals.

    ``signal`` has x, or re and im.
    """
    values = signal if "re" in signal.columns else signal.withColumns({"re": F.col("x"), "im": F.lit(0.0)})
    N = F.count("*").over(whole(by))
    rows = values.withColumn("_N", N).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_N") - 1)))
    angle = F.pmod(F.col("k") * F.col("n"), F.col("_N")) * (2 * math.pi) / F.col("_N") * (1 if inverse else -1)
    re = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)
    im = F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    by_n = F.first("_N") if norm else F.lit(1)
    return rows.groupBy(*by, "k").agg((F.sum(re) / by_n).alias("re"), (F.sum(im) / by_n).alias("im"))


def matrix_dft(spark, N: int, K: int, inverse: bool = False) -> DataFrame:
    """The K x N matrix of exp(-2 pi i k n / N); the inverse one is conjugated and divided by N."""
    angle = F.pmod(F.col("k") * F.col("n"), F.lit(N)) * (2 * math.pi / N)
    rows = spark.range(K).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("n"))
    scale, sign = (1.0 / N, 1.0) if inverse else (1.0, -1.0)
    return rows.select("k", "n", (F.cos(angle) * scale).alias("re"), (F.sin(angle) * sign * scale).alias("im"))


def twiddle(spark, N: int, inverse: bool = False) -> DataFrame:
    angle = F.col("id") * (2 * math.pi / N)
    return spark.range(N // 2).select(F.col("id").alias("k"), F.cos(angle).alias("re"), (F.sin(angle) * (1.0 if inverse else -1.0)).alias("im"))


def phase_of_frequency(freq: str, Fs: float, by=BY) -> Column:
    """Phase in radians of a changing frequency: an exclusive prefix sum."""
    return exclusive_prefix_sum(F.col(freq) * (2 * math.pi / Fs), by)
