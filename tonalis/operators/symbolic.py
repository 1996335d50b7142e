"""Notes, segments, chords and labels: rasterising, converting, recognising."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .features import normalize_feature_sequence

BY = ("track_id",)


def _span(df: DataFrame, start: Column, end: Column, out: str = "n") -> DataFrame:
    """A row for each index of [start, end); empty spans give none."""
    tmp = df.withColumns({"_a": start.cast("long"), "_b": end.cast("long")}).where("_a < _b")
    return tmp.withColumn(out, F.explode(F.sequence("_a", F.col("_b") - 1))).drop("_a", "_b")


def _trunc(x: Column) -> Column:
    """Toward zero, as a cast to an integer does."""
    return x.cast("long")


def notes_to_frames(notes: DataFrame, num_frames: int, frame_rate: float) -> DataFrame:
    end = F.col("start") + F.col("duration")
    return _span(notes, F.greatest(_trunc(F.col("start") * frame_rate), F.lit(0)), F.least(_trunc(end * frame_rate) + 1, F.lit(num_frames)))


def list_to_chromagram(notes: DataFrame, num_frames: int, frame_rate: float) -> DataFrame:
    """Active (track, n, k) cells of pitch classes; overlapping notes count once."""
    return notes_to_frames(notes, num_frames, frame_rate).select(*BY, "n", F.pmod("pitch", F.lit(12)).cast("int").alias("k")).distinct()


def list_to_pitch_activations(notes: DataFrame, num_frames: int, frame_rate: float) -> DataFrame:
    """Active (track, n, k) cells of pitches, k = pitch - 1."""
    return notes_to_frames(notes, num_frames, frame_rate).select(*BY, "n", (F.col("pitch").cast("int") - 1).alias("k")).distinct()


def score_chromagram(notes: DataFrame, Fs_beat: float) -> DataFrame:
    """Velocity-weighted chroma on a beat grid that starts at the first note, 2-norm: track, n, k, v; silent frames have no row."""
    first = F.min("start").over(Window.partitionBy(*BY))
    n = notes.withColumn("_0", first)
    a = F.rint((F.col("start") - F.col("_0")) * Fs_beat)
    b = F.rint((F.col("start") + F.col("duration") - F.col("_0")) * Fs_beat)
    k = F.pmod(F.rint("pitch"), F.lit(12)).cast("int")
    summed = _span(n, a, b).groupBy(*BY, "n", k.alias("k")).agg(F.sum("velocity").alias("v"))
    w = Window.partitionBy(*BY, "n")
    return summed.withColumn("v", F.try_divide("v", F.sqrt(F.sum(F.col("v") * F.col("v")).over(w))))


def cut_notes(notes: DataFrame, start_sec: float, end_sec: float) -> DataFrame:
    """Notes (start, end, pitch, label) that start strictly within the range, re-based and clipped; velocity 100."""
    kept = notes.where((F.col("start") > start_sec) & (F.col("start") < end_sec))
    return kept.select(*BY, (F.col("start") - start_sec).alias("start"), (F.least("end", F.lit(float(end_sec))) - F.col("start")).alias("duration"), F.col("pitch").cast("int").alias("pitch"), F.lit(100).alias("velocity"), F.col("label").cast("int").cast("string").alias("label"))


def cut_signal(signal: DataFrame, start_sec: float, end_sec: float, Fs: float, normalize: bool = True) -> DataFrame:
    """Samples of a time range, re-based, with a maximum magnitude of 1."""
    a, b = int(start_sec * Fs), int(end_sec * Fs)
    out = signal.where((F.col("n") >= a) & (F.col("n") < b)).withColumn("n", F.col("n") - a)
    top = F.max(F.abs("x")).over(Window.partitionBy(*BY))
    return out.withColumn("x", F.coalesce(F.try_divide("x", top), F.lit(0.0))) if normalize else out


def convert_structure(segments: DataFrame, Fs: float = 1, remove_digits: bool = False, index: bool = False) -> DataFrame:
    """Scale times, optionally to integers (half to even), optionally without digits in labels."""
    scale = (lambda c: F.rint(F.col(c) * Fs).cast("int")) if index else (lambda c: F.col(c) * Fs)
    out = segments.withColumns({"start": scale("start"), "end": scale("end")})
    return out.withColumn("label", C.remove_digits("label")) if remove_digits else out


def sequence_segments(labels: DataFrame, Fs: float = 1) -> DataFrame:
    """A segment of one frame around each label's frame."""
    return labels.select(*BY, ((F.col("n") - 0.5) / Fs).alias("start"), ((F.col("n") + 0.5) / Fs).alias("end"), "label")


def line_annotations(df: DataFrame, default: str = "") -> DataFrame:
    """Positions with a label column."""
    if "pos" not in df.columns:
        raise ValueError("positions need a column pos")
    return df if "label" in df.columns else df.withColumn("label", F.lit(default))


def segment_annotations(df: DataFrame, default: str = "") -> DataFrame:
    """Segments with a label column."""
    if not {"start", "end"} <= set(df.columns):
        raise ValueError("segments need columns start and end")
    return df if "label" in df.columns else df.withColumn("label", F.lit(default))


# ---------------------------------------------------------------- chords


def chord_labels(spark: SparkSession, ext_minor: str = "m", nonchord: bool = False) -> DataFrame:
    """chord_idx, label: twelve major, twelve minor chords and optionally N."""
    rows = [(i, n) for i, n in enumerate(C.CHROMA)] + [(12 + i, n + ext_minor) for i, n in enumerate(C.CHROMA)] + ([(24, "N")] if nonchord else [])
    return spark.createDataFrame(rows, "chord_idx int, label string")


def chord_templates(spark: SparkSession, nonchord: bool = False) -> DataFrame:
    """chord_idx, k, w: triads' pitch classes; the non-chord has all."""
    rows = [(c, (c + i) % 12, 1.0) for c in range(12) for i in (0, 4, 7)] + [(12 + c, (c + i) % 12, 1.0) for c in range(12) for i in (0, 3, 7)]
    rows += [(24, k, 1.0) for k in range(12)] if nonchord else []
    return spark.createDataFrame(rows, "chord_idx int, k int, w double")


def chord_similarity(chroma: DataFrame, norm_sim: str | None = "1", nonchord: bool = False) -> DataFrame:
    """Cosine similarity of each frame with each chord, optionally normalised: track, n, k (chord), v."""
    t = chord_templates(chroma.sparkSession, nonchord)  # at most 84 rows
    size = F.when(F.col("chord_idx") < 24, math.sqrt(3.0)).otherwise(math.sqrt(12.0))
    x = normalize_feature_sequence(chroma, "2")
    sim = x.join(F.broadcast(t), "k").groupBy(*BY, "n", F.col("chord_idx").alias("k")).agg((F.sum(F.col("v") * F.col("w")) / F.first(size)).alias("v"))
    return normalize_feature_sequence(sim, norm_sim) if norm_sim else sim


def chord_recognition(chroma: DataFrame, norm_sim: str | None = "1", nonchord: bool = False) -> DataFrame:
    """The most similar chord of each frame (the first on a tie): track, n, chord_idx, v.

    Similarities are compared to 12 digits, so that the order of summation cannot break a tie.
    """
    sim = chord_similarity(chroma, norm_sim, nonchord)
    best = sim.groupBy(*BY, "n").agg(F.max(F.struct(F.round("v", 12).alias("r"), (-F.col("k")).alias("k"), "v")).alias("s"))
    return best.select(*BY, "n", (-F.col("s.k")).alias("chord_idx"), F.col("s.v").alias("v"))


def chord_matrix(segments: DataFrame, labels: DataFrame, N: int | None = None, last: bool = False) -> DataFrame:
    """Reference cells (track, n, k) of integer chord segments, cut or extended to N frames.

    Missing frames are N, or the last label if ``last``; labels outside ``labels`` are left out.
    """
    from .evaluate import label_sequence

    seq = label_sequence(segments.withColumn("label", C.chord_label("label")))
    if N is not None:
        final = seq.groupBy(*BY).agg(F.max(F.struct("n", "label")).alias("_l"))
        pad = F.col("_l.label") if last else F.lit("N")
        more = final.where(F.col("_l.n") + 1 < N).select(*BY, F.explode(F.sequence(F.col("_l.n") + 1, F.lit(N - 1).cast("long"))).alias("n"), pad.alias("label"))
        seq = seq.where(F.col("n") < N).unionByName(more)
    return seq.join(F.broadcast(labels), "label").select(*BY, "n", F.col("chord_idx").alias("k"))


# ---------------------------------------------------------------- factor initialisers


def pitch_set(notes: DataFrame) -> DataFrame:
    """Distinct pitches with their place r: track, pitch, r."""
    w = Window.partitionBy(*BY).orderBy("pitch")
    return notes.select(*BY, "pitch").distinct().withColumn("r", F.row_number().over(w) - 1)


def template_pitch(pitches: DataFrame, K: int, freq_res: float, tol_pitch: float = 0.05) -> DataFrame:
    """Comb 1 / m around each harmonic m of a pitch, later harmonics over earlier ones: adds k, v (cells of 0 left out)."""
    f = C.f_pitch("pitch")
    orders = pitches.withColumn("_f", f).withColumn("_m", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(K * freq_res) / (F.col("_f") * (1 - tol_pitch))).cast("int"))))
    a = F.greatest(_trunc(F.col("_m") * F.col("_f") * ((1 - tol_pitch) / freq_res)), F.lit(0))
    b = F.least(_trunc(F.col("_m") * F.col("_f") * ((1 + tol_pitch) / freq_res)), F.lit(K - 1))
    return _span(orders, a, b + 1, "k").groupBy(*pitches.columns, "k").agg((1.0 / F.max("_m")).alias("v"))


def template_pitch_onset(pitches: DataFrame, K: int, freq_res: float, tol_pitch: float = 0.05) -> DataFrame:
    """Two columns for each pitch (with its place r): 2 r is 0.1 everywhere, 2 r + 1 the comb: track, col, k, v."""
    comb = template_pitch(pitches, K, freq_res, tol_pitch).select(*BY, (F.col("r") * 2 + 1).alias("col"), "k", "v")
    onset = pitches.select(*BY, (F.col("r") * 2).alias("col"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(K - 1).cast("long"))).alias("k")).withColumn("v", F.lit(0.1))
    return onset.unionByName(comb)


def activation_score(notes: DataFrame, N: int, frame_res: float, tol_note=(0.2, 0.5)) -> DataFrame:
    """Frames where a pitch may sound: track, pitch, n (each once)."""
    a = F.greatest(_trunc((F.col("start") - tol_note[0]) / frame_res), F.lit(0))
    b = F.least(_trunc((F.col("start") + F.col("duration") + tol_note[1]) / frame_res), F.lit(N))
    return _span(notes, a, b).select(*BY, "pitch", "n").distinct()


def activation_score_onset(notes: DataFrame, N: int, frame_res: float, tol_note=(0.2, 0.5), tol_onset=(0.3, 0.1)) -> DataFrame:
    """Rows of onsets (2 r) and sounds (2 r + 1) of each pitch: track, row, pitch, n."""
    w = Window.partitionBy(*BY).orderBy("pitch")
    ranked = notes.withColumn("r", F.dense_rank().over(w) - 1).where("pitch is not null")  # the place in ``pitch_set``

    def cells(before: float, end: Column, row: int) -> DataFrame:
        a = F.greatest(_trunc((F.col("start") - before) / frame_res), F.lit(0))
        b = F.least(_trunc(end / frame_res), F.lit(N))
        return _span(ranked, a, b).select(*BY, (F.col("r") * 2 + row).alias("row"), "pitch", "n").distinct()

    return cells(tol_onset[0], F.col("start") + tol_onset[1], 0).unionByName(cells(tol_note[0], F.col("start") + F.col("duration") + tol_note[1], 1))


def split_hands(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return notes.where("label = 'lh'"), notes.where("label = 'rh'")


# ---------------------------------------------------------------- data behind figures


def matrix_extent(frames: DataFrame, Fs: float = 1, Fs_F: float = 1) -> DataFrame:
    """Cells with the borders of their raster, half a bin around each."""
    t, f = F.col("n") / Fs, F.col("k") / Fs_F
    return frames.withColumns({"t_low": t - 0.5 / Fs, "t_high": t + 0.5 / Fs, "f_low": f - 0.5 / Fs_F, "f_high": f + 0.5 / Fs_F})


def signal_points(signal: DataFrame, Fs: float = 1) -> DataFrame:
    """Finite samples with their times."""
    return signal.where(~F.isnan("x") & (F.abs("x") < float("inf"))).withColumn("t", F.col("n") / Fs)


def segment_midpoints(segments: DataFrame) -> DataFrame:
    return segments.withColumn("mid", F.col("start") + (F.col("end") - F.col("start")) / 2)


def time_extent(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*BY).agg(F.min("start").alias("t_min"), F.max("end").alias("t_max"))


def label_lanes(segments: DataFrame) -> DataFrame:
    """A lane for each distinct label of a track, in the labels' order."""
    w = Window.partitionBy(*BY).orderBy("label")
    lanes = segments.select(*BY, "label").distinct().withColumn("lane", F.row_number().over(w) - 1)
    return segments.join(lanes, [*BY, "label"])


def piano_roll(notes: DataFrame) -> DataFrame:
    """Rectangles of notes."""
    return notes.withColumns({"end": F.col("start") + F.col("duration"), "low": F.col("pitch") - 0.5, "high": F.col("pitch") + 0.5})


def label_colors(labels: DataFrame, palette: list[str] | dict[str, str], default: str = "gray") -> DataFrame:
    """A colour for each distinct label: by name, or in order while the palette lasts."""
    spark = labels.sparkSession
    names = labels.select("label").distinct()
    if isinstance(palette, dict):
        dim = spark.createDataFrame(list(palette.items()) or [("", default)], "label string, color string")
        return names.join(F.broadcast(dim), "label", "left").select("label", F.coalesce("color", F.lit(default)).alias("color"))
    place = F.row_number().over(Window.orderBy("label")) - 1  # label sets are small: one task
    colors = F.array(*[F.lit(c) for c in palette]) if palette else F.array().cast("array<string>")
    return names.withColumn("_i", place).select("label", F.coalesce(F.get(colors, F.col("_i")), F.lit(default)).alias("color"))


def structure_colors(spark: SparkSession, groups: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Colours (r, g, b, alpha) by the letter that a structure label starts with; an empty label is transparent."""
    groups = groups or {"A": (1.0, 0.0, 0.0, 0.2), "B": (0.0, 1.0, 0.0, 0.2), "C": (0.0, 0.0, 1.0, 0.2), "I": (0.0, 1.0, 0.0, 0.2), "V": (1.0, 0.0, 0.0, 0.2), "O": (1.0, 1.0, 0.0, 0.2), "": (1.0, 1.0, 1.0, 0.0)}
    return spark.createDataFrame([(k, *v) for k, v in groups.items()], "letter string, r double, g double, b double, alpha double")


def gray_ramp(spark: SparkSession, alpha: float = 5, N: int = 256, reverse: bool = False) -> DataFrame:
    """Compressed grey levels from white to black for alpha > 0, the mirrored ramp below; the reverse of either."""
    if alpha == 0:
        raise ValueError("alpha must not be 0")
    rising = lambda x: F.log1p(x * abs(alpha)) / math.log1p(abs(alpha))
    x = F.col("id") / (N - 1)
    x = F.lit(1.0) - x if (alpha < 0) != reverse else x
    return spark.range(N).select(F.col("id").alias("i"), (1 - rising(x) if alpha > 0 else rising(x)).alias("level"))
