"""Registered queries of generators, factor initialisers, figure datasets, frequency refinement and cell measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as A
from .functions import columns as C
from .operators import evaluate as E
from .operators import features as FE
from .operators import interpolate as I
from .operators import sequences as S
from .operators import similarity as SM
from .operators import symbolic as SY
from .queries import query
from .sources import generators as G

TAU = "(2 * pi())"


def _samples(count: int, x: str, Fs: float) -> str:
    """SQL of a generated signal: a column x over n samples and their times t."""
    return f"SELECT 't0' AS track_id, n, t, {x} AS x FROM (SELECT n, n / {Fs}::double AS t FROM range(0, {count}) r(n))"


def _top(body: str, amp: float) -> str:
    return f"SELECT track_id, n, x / max(x) OVER () * {amp} AS x FROM ({body})"


def _pitch(p: float) -> str:
    return f"(440::double * pow(2, ({p} - 69) / 12::double))"


# ---------------------------------------------------------------- scalars


@query("event_id bins inside name", "cents penalty freq time total", """SELECT event_id, log2((value + 1) / 100) * 1200 AS cents, CASE WHEN event_id % 48 > 0 THEN -pow(log2((event_id % 48) / 24::double), 2) ELSE 0 END AS penalty,
CAST(ceil(value * (1024::double / 22050)) AS INT) AS bins, (event_id % 100) * (22050::double / 2048) AS freq, (event_id % 100) * 512 / 22050::double AS time, coalesce(floor(log2((value + 1) / 55) * 120 + 0.5::double) = 60, false) AS inside,
value + 1 + 2 AS total, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), 'Unknown') AS name FROM events""")  # fmt: skip
def frequency_scalars(spark, sf):
    e = A.table(spark, sf, "events").withColumns({"k": F.col("event_id") % 100, "b": F.col("event_id") % 48, "v": F.col("value") + 1})
    named = C.instrument_name(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")))
    return e.select("event_id", C.difference_cents("v", 100).alias("cents"), C.beat_penalty("b", 24).alias("penalty"), C.hertz_to_bins("value").alias("bins"), C.f_coef("k", 22050, 2048).alias("freq"), C.t_coef("k", 22050, 512).alias("time"), C.in_bin(60, "v").alias("inside"), C.add("value", 1, 2).alias("total"), named.alias("name"))


@query("l_orderkey l_linenumber name", "", "SELECT l_orderkey, l_linenumber, list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], CAST(l_partkey % 12 + 1 AS INT)) AS name FROM lineitem")
def chroma_names(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.chroma_name("l_partkey").alias("name"))


# ---------------------------------------------------------------- generators


@query("track_id n", "t x", _samples(5000, f"sin((t * 3 - 0.25::double) * {TAU}) * 0.5::double", 1000))
def sinusoid(spark, sf):
    return G.sinusoid(spark, 5, 1000, 0.5, 3, 0.25)


@query("track_id n", "x", _top(f"SELECT 't0' AS track_id, n, sin(list_extract([{_pitch(60)}, {_pitch(64)}, {_pitch(67)}], CAST(n // 2000 + 1 AS INT)) * (n % 2000) * ({TAU} / 4000)) AS x FROM range(0, 6000) r(n)", 0.5))
def sinusoid_scale(spark, sf):
    return G.sinusoid_scale(spark, [60, 64, 67], 0.5, 4000, 0.5)


@query("track_id n", "x", _top(_samples(4000, " + ".join(f"sin(t * ({TAU} * {_pitch(p)}))" for p in (60, 64, 67)), 4000), 0.5))
def sinusoid_chord(spark, sf):
    return G.sinusoid_chord(spark, [60, 64, 67], 1, 4000, 0.5).drop("t")


@query("track_id n", "x", _top(_samples(2000, " + ".join(f"sin(t * ({TAU} * {27.5 * 2**i}::double))" for i in range(10)), 4000), 1.0))
def shepard_tone(spark, sf):
    return G.shepard_tone(spark, 440, 0.5, 4000).drop("t")


@query("track_id n", "t x", _samples(2000, " + ".join(f"sin(t * ({TAU} * {_pitch(p)})) * (exp(-pow({p} - 60, 2) / 450::double) / (sqrt({TAU}) * 15))" for p in range(28, 108, 12)), 4000))
def chroma_shepard_tone(spark, sf):
    return G.chroma_shepard_tone(spark, 4, 4000, 2000)


@query("track_id n", "x", _top(_samples(8000, f"sin(pow(2::double, t / 8) * ({TAU} * 110 * 8 / ln(2)))", 1000), 1.0))
def chirp_exp_octave(spark, sf):
    return G.chirp_exp_octave(spark, 110, 8, 1000).drop("t")


GLISSANDO = "SELECT track_id, n, (" + " + ".join(f"w{i} / max(w{i}) OVER ()" for i in range(11)) + ") / 11 AS x FROM (SELECT 't0' AS track_id, n, " + ", ".join(f"sin(pow(2::double, n / 4000::double) * ({TAU} * {10 * 2**i} * 4 / ln(2))) AS w{i}" for i in range(11)) + " FROM range(0, 4000) r(n))"


@query("track_id n", "x t", f"SELECT track_id, n + o * 4000 AS n, x, (n + o * 4000) / 1000::double AS t FROM ({GLISSANDO}), range(0, 3) s(o)")
def shepard_glissando(spark, sf):
    return G.shepard_glissando(spark, 3, 4, 1000)


@query("track_id n", "t x", _samples(8000, f"sin((t * t * ((400 - 50) / 2::double / 2) + t * 50) * {TAU}) * 0.5::double", 4000))
def chirp_linear(spark, sf):
    return G.chirp_linear(spark, 2, 50, 400, 0.5, 4000)


CHIRP = f"SELECT 't0' AS track_id, n, n / 4000::double AS t, freq, sin(coalesce(sum(freq * ({TAU} / 4000)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS x FROM (SELECT n, exp(n * (ln(800::double / 50) / 7999)) * 50 AS freq FROM range(0, 8000) r(n))"


@query("track_id n", "t freq x", CHIRP)
def chirp_exp(spark, sf):
    return G.chirp_exp(spark, 2, 50, 800, 4000)


def _loudness(freq: str) -> str:
    """Equal loudness contour against 1 kHz; the constants are fixed values."""
    curve = lambda f: f"({f} / 6.8966888496476e-5::double * sqrt((pow(1037918.48::double - {f} * {f}, 2) + {f} * {f} * 1080768.16::double) / (pow(9837328::double - {f} * {f}, 2) + {f} * {f} * 11723776::double) / (({f} * {f} + 79919.29::double) * ({f} * {f} + 1345600::double))))"
    return f"log10(abs({curve('1000::double')} / {curve(freq)})) * 20"


@query("track_id n", "t freq x loudness", f"SELECT track_id, n, t, freq, x * pow(10::double, loudness / 20) AS x, loudness FROM (SELECT *, {_loudness('freq')} AS loudness FROM ({CHIRP}))")
def chirp_exp_equal_loudness(spark, sf):
    return G.chirp_exp_equal_loudness(spark, 2, 50, 800, 4000)


@query("i", "freq loudness", f"SELECT *, {_loudness('freq')} AS loudness FROM (SELECT i, pow(10::double, i * (log10(15000::double / 30) / 99)) * 30 AS freq FROM range(0, 100) r(i))")
def equal_loudness_contour(spark, sf):
    return G.equal_loudness_contour(spark)


@query("track_id n", "x", "SELECT 't0' AS track_id, n, CASE WHEN n < 10 THEN n / 10::double WHEN n < 20 THEN 1 - (n - 10) * 0.05::double WHEN n < 80 THEN 0.5::double ELSE 0.5::double * (1 - (n - 79) / 10::double) END AS x FROM range(0, 90) r(n)")
def adsr(spark, sf):
    return G.adsr(spark)


@query("track_id n", "t x", _samples(5000, f"(sin(t * ({TAU} * 5)) * 0.1::double + 0.5::double) * sin(t * ({TAU} * 44))", 1000))
def tremolo(spark, sf):
    return G.tremolo(spark, 5, 1000, freq=44)


@query("track_id n", "t x", _samples(4000, " + ".join(f"sin(t * ({TAU} * {_pitch(60)} * {h})) * {1 / h}::double" for h in (1, 2, 3, 4)), 4000))
def tone(spark, sf):
    return G.tone(spark, 60, [1.0, 1 / 2, 1 / 3, 1 / 4], 4000, 1)


THREE = f"sin(t * (2 * {TAU})) + sin((t * 6 - 0.1::double) * {TAU}) * 0.5::double + sin((t * 20 - 0.2::double) * {TAU}) * 0.1::double"


@query("track_id n", "t x", _samples(2000, THREE, 1000))
def three_sinusoids(spark, sf):
    return G.three_sinusoids(spark, 1000, 2)


@query("track_id n", "x1 x2 total", f"SELECT track_id, n, x1, x2, x1 + x2 AS total FROM (SELECT 't0' AS track_id, n, sin(n / 1000::double * 200 * {TAU}) AS x1, sin((n / 1000::double * 203 - 0.5::double) * {TAU}) AS x2 FROM range(0, 1000) r(n))")
def interference(spark, sf):
    return G.interference(G.sinusoid(spark, 1, 1000, 1, 200), G.sinusoid(spark, 1, 1000, 1, 203, 0.5))


# ---------------------------------------------------------------- Fourier tables


def _matrix(scale: str, sign: int) -> str:
    return f"SELECT k, CAST(n AS INT) AS n, cos((k * n % 32) * ({TAU} / 32)) * {scale} AS re, {sign} * sin((k * n % 32) * ({TAU} / 32)) * {scale} AS im FROM range(0, 20) a(k), range(0, 32) b(n)"


@query("k n", "re im", _matrix("1", -1))
def matrix_dft(spark, sf):
    return FE.matrix_dft(spark, 32, 20)


@query("k n", "re im", _matrix("(1 / 32::double)", 1))
def matrix_dft_inv(spark, sf):
    return FE.matrix_dft(spark, 32, 20, inverse=True)


@query("k", "re im", f"SELECT k, cos(k * ({TAU} / 64)) AS re, -sin(k * ({TAU} / 64)) AS im FROM range(0, 32) a(k)")
def twiddle(spark, sf):
    return FE.twiddle(spark, 64)


@query("k", "re im", f"SELECT k, cos(k * ({TAU} / 64)) AS re, sin(k * ({TAU} / 64)) AS im FROM range(0, 32) a(k)")
def twiddle_inv(spark, sf):
    return FE.twiddle(spark, 64, inverse=True)


@query("track_id k", "re im", f"SELECT track_id, f AS k, sum(v * cos(((f * k) % 64) * {TAU} / 64)) AS re, sum(v * sin(((f * k) % 64) * {TAU} / 64)) AS im FROM (SELECT track_id || '-' || CAST(n AS VARCHAR) AS track_id, k, v FROM feat), range(0, 64) g(f) GROUP BY ALL", "feat")
def idft(spark, sf):
    """The inverse transform of each vector, not divided."""
    x = A.feat(spark, sf).select(F.concat_ws("-", "track_id", "n").alias("track_id"), F.col("k").cast("long").alias("n"), F.col("v").alias("x"))
    return FE.dft_small(x, inverse=True, norm=False)


@query("k", "freq", "SELECT CAST(k AS INT) AS k, k * 22050::double / 4096 AS freq FROM range(0, 2049) a(k)")
def f_coef_linear(spark, sf):
    return I.compute_f_coef_linear(spark, 2048, 22050, 2)


@query("k", "freq cents", "SELECT CAST(k AS INT) AS k, pow(2::double, k * 10::double / 1200) * 55 AS freq, k * 10::double AS cents FROM range(0, 600) a(k)")
def f_coef_log(spark, sf):
    return I.compute_f_coef_log(spark, 10, 55, 1760)


# ---------------------------------------------------------------- instantaneous frequency and log-frequency bins

#: A complex spectrum of 32 coefficients: halves of the vectors as real and imaginary parts.
SPECTRUM = "sp AS MATERIALIZED (SELECT a.track_id, a.n, a.k, a.v AS re, b.v AS im, atan2(b.v, a.v) / (2 * pi()) AS p FROM feat a JOIN feat b ON a.track_id = b.track_id AND a.n = b.n AND b.k = a.k + 32 WHERE a.k < 32)"
INST = """inst AS MATERIALIZED (SELECT track_id, n, k, re, im, coalesce(f, lead(f) OVER w, k * (4000 / 64::double)) AS freq FROM
(SELECT *, k * (4000 / 64::double) + (d + 0.5::double - floor(d + 0.5::double) - 0.5::double) * (4000 / 16::double) AS f FROM (SELECT *, p - lag(p) OVER (PARTITION BY track_id, k ORDER BY n) - k * (16 / 64::double) AS d FROM sp)) WINDOW w AS (PARTITION BY track_id, k ORDER BY n))"""


def _spectrum(spark, sf):
    f = A.feat(spark, sf)
    b = f.where("k >= 32").select("track_id", "n", (F.col("k") - 32).alias("k"), F.col("v").alias("im"))
    return f.where("k < 32").select("track_id", "n", "k", F.col("v").alias("re")).join(b, ["track_id", "n", "k"])


@query("track_id n k", "freq", "SELECT track_id, n, k, freq FROM inst", "feat", f"{SPECTRUM}, {INST}")
def instantaneous_frequency(spark, sf):
    return FE.compute_if(_spectrum(spark, sf), 4000, 64, 16).select("track_id", "n", "k", "freq")


@query("track_id n k", "v", "SELECT track_id, n, CAST(floor(log2(k * (4000 / 64::double) / 55) * 12 + 0.5::double) AS INT) AS k, sum(abs(v)) AS v FROM feat WHERE k * (4000 / 64::double) BETWEEN 55 AND 1760 GROUP BY ALL", "feat")
def log_frequency_bins(spark, sf):
    return FE.compute_y_lf_bin(A.feat(spark, sf).withColumn("v", F.abs("v")), 4000, 64, 100.0)


@query("track_id n k", "v", "SELECT track_id, n, CAST(floor(log2(freq / 55) * 12 + 0.5::double) AS INT) AS k, sum(ln(1 + sqrt(re * re + im * im) * 10)) AS v FROM inst WHERE freq >= 55 AND freq < 1760 GROUP BY ALL", "feat", f"{SPECTRUM}, {INST}")
def log_frequency_bins_if(spark, sf):
    return FE.compute_y_lf_if_bin(_spectrum(spark, sf), 4000, 64, 16, 100.0, gamma=10.0)


# ---------------------------------------------------------------- factor initialisers

PITCHES = "ps AS MATERIALIZED (SELECT track_id, pitch, CAST(row_number() OVER (PARTITION BY track_id ORDER BY pitch) - 1 AS INT) AS r FROM (SELECT DISTINCT track_id, pitch FROM notes))"
COMB = """comb AS MATERIALIZED (SELECT track_id, pitch, r, k, 1 / max(m)::double AS v FROM (SELECT *, unnest(range(greatest(CAST(trunc(m * f * (0.95::double / 20)) AS BIGINT), 0), least(CAST(trunc(m * f * (1.05::double / 20)) AS BIGINT), 59) + 1)) AS k
FROM (SELECT *, unnest(range(1, CAST(ceil(1200 / (f * 0.95::double)) AS BIGINT) + 1)) AS m FROM (SELECT *, 440::double * pow(2, (pitch - 69) / 12) AS f FROM ps))) GROUP BY ALL)"""


@query("track_id pitch r k", "v", "SELECT track_id, pitch, r, k, v FROM comb", "notes", f"{PITCHES}, {COMB}")
def template_pitch(spark, sf):
    return SY.template_pitch(SY.pitch_set(A.notes(spark, sf)), 60, 20.0)


@query("track_id col k", "v", "SELECT track_id, CAST(r * 2 + 1 AS INT) AS col, k, v FROM comb UNION ALL SELECT track_id, CAST(r * 2 AS INT), k, 0.1::double FROM ps, range(0, 60) t(k)", "notes", f"{PITCHES}, {COMB}")
def template_pitch_onset(spark, sf):
    return SY.template_pitch_onset(SY.pitch_set(A.notes(spark, sf)), 60, 20.0)


def _active(a: str, b: str, o: int) -> str:
    return f"SELECT DISTINCT track_id, pitch, unnest(range(greatest(CAST(trunc(({a}) / 2) AS BIGINT), 0), least(CAST(trunc(({b}) / 2) AS BIGINT), 400))) AS n, {o} AS o FROM notes"


@query("track_id row pitch n", "", f"SELECT track_id, CAST(r * 2 + o AS INT) AS row, pitch, n FROM ({_active('start - 0.3::double', 'start + 4.1::double', 0)} UNION ALL {_active('start - 0.2::double', 'start + duration + 0.5::double', 1)}) JOIN ps USING (track_id, pitch)", "notes", PITCHES)
def activation_score_onset(spark, sf):
    return SY.activation_score_onset(A.notes(spark, sf), 400, 2.0, tol_onset=(0.3, 4.1))


# ---------------------------------------------------------------- datasets behind figures


@query("track_id n", "x t", "SELECT track_id, n, x, n / 24::double AS t FROM sig_hour WHERE isfinite(x)", "sig_hour")
def signal_points(spark, sf):
    return SY.signal_points(A.sig_hour(spark, sf), 24)


@query("track_id n", "x", "SELECT track_id, n, coalesce(x / nullif(max(abs(x)) OVER (PARTITION BY track_id), 0), 0) AS x FROM (SELECT track_id, n - 48 AS n, x FROM sig_hour WHERE n >= 48 AND n < 240)", "sig_hour")
def cut_signal(spark, sf):
    return SY.cut_signal(A.sig_hour(spark, sf), 2, 10, 24)


@query("track_id label", "start stop mid", 'SELECT track_id, label, start, "end" AS stop, start + ("end" - start) / 2 AS mid FROM segments', "segments")
def segment_midpoints(spark, sf):
    return SY.segment_midpoints(SY.segment_annotations(A.segments(spark, sf))).withColumnRenamed("end", "stop")


@query("track_id label lane", "start", "SELECT track_id, label, start, CAST(dense_rank() OVER (PARTITION BY track_id ORDER BY label) - 1 AS INT) AS lane FROM segments", "segments")
def label_lanes(spark, sf):
    return SY.label_lanes(A.segments(spark, sf)).drop("end")


@query("track_id pitch label", "start duration velocity low high stop", "SELECT *, pitch - 0.5::double AS low, pitch + 0.5::double AS high, start + duration AS stop FROM notes", "notes")
def piano_roll(spark, sf):
    return SY.piano_roll(A.notes(spark, sf)).withColumnRenamed("end", "stop")


@query("track_id n k", "v t_low t_high f_low f_high", "SELECT track_id, n, k, v, n / 2::double - 0.25::double AS t_low, n / 2::double + 0.25::double AS t_high, k / 4::double - 0.125::double AS f_low, k / 4::double + 0.125::double AS f_high FROM feat", "feat")
def matrix_extent(spark, sf):
    return SY.matrix_extent(A.feat(spark, sf), 2, 4)


@query("track_id label", "start stop", "SELECT track_id, s AS label, (n - 0.5::double) / 2 AS start, (n + 0.5::double) / 2 AS stop FROM states", "states")
def sequence_segments(spark, sf):
    return SY.sequence_segments(SY.line_annotations(A.states(spark, sf).select("track_id", "n", F.col("n").alias("pos"), F.col("s").alias("label"))), 2).withColumnRenamed("end", "stop")


@query("label color", "", "SELECT label, coalesce(list_extract(['red', 'green', 'blue'], CAST(row_number() OVER (ORDER BY label) AS INT)), 'gray') AS color FROM (SELECT DISTINCT label FROM segments)", "segments")
def label_colors(spark, sf):
    return SY.label_colors(A.segments(spark, sf), ["red", "green", "blue"])


@query("i", "level", "SELECT i, 1 - ln(1 + i / 255::double * 5) / ln(6::double) AS level FROM range(0, 256) a(i)")
def gray_ramp(spark, sf):
    return SY.gray_ramp(spark, 5)


@query("chord_idx label", "", "SELECT CAST(i AS INT) AS chord_idx, CASE WHEN i = 24 THEN 'N' ELSE list_extract(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], CAST(i % 12 + 1 AS INT)) || CASE WHEN i >= 12 THEN 'm' ELSE '' END END AS label FROM range(0, 25) a(i)")
def chord_labels(spark, sf):
    return SY.chord_labels(spark, nonchord=True)


@query("i j", "v", "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, sign(i) * sign(j)::double AS v FROM range(-4, 5) a(i), range(-4, 5) b(j)")
def checkerboard_box(spark, sf):
    return SM.checkerboard_box(spark, 4)


@query("i j", "p", "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 0.3::double ELSE 0.7::double / 23 END AS p FROM range(0, 24) a(i), range(0, 24) b(j)")
def uniform_transition(spark, sf):
    t = S.uniform_transition(spark, 0.3, 24)
    return t.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), t.columns[-1]).toDF("i", "j", "p")


@query("track_id m start stop", "", "SELECT track_id, n AS m, n AS start, n + 7 - 1 AS stop FROM sig_hour WHERE n % 24 = 0", "sig_hour")
def matches_diag(spark, sf):
    m = A.sig_hour(spark, sf).where("n % 24 = 0").select("track_id", F.col("n").alias("m"))
    return SM.matches_diag(m, F.lit(7)).withColumnRenamed("end", "stop")


# ---------------------------------------------------------------- measures of cells and pairs

SAME = "SELECT track_id, a.n, b.n AS m FROM states a JOIN states b USING (track_id) WHERE b.n < a.n AND a.{0} = b.{0}"


@query("track_id n m", "", SAME.format("s"), "states")
def compare_pairwise(spark, sf):
    return E.compare_pairwise(A.states(spark, sf).withColumnRenamed("s", "label"))


@query("track_id n m code", "", f"SELECT coalesce(r.track_id, e.track_id) AS track_id, coalesce(r.n, e.n) AS n, coalesce(r.m, e.m) AS m, CASE WHEN r.n IS NULL THEN 3 WHEN e.n IS NULL THEN 2 ELSE 1 END AS code FROM ({SAME.format('s')}) r FULL JOIN ({SAME.format('o')}) e ON r.track_id = e.track_id AND r.n = e.n AND r.m = e.m", "states")
def pairwise_codes(spark, sf):
    s = A.states(spark, sf)
    return E.pairwise_codes(*(E.compare_pairwise(s.select("track_id", "n", F.col(c).alias("label"))) for c in ("s", "o")))


def _cells(spark, sf):
    f = A.feat(spark, sf)
    return f.where("v > 0.1"), f.where("v > 0.15 or k % 16 = 0")


@query("track_id tp fn fp", "p r f", """SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (SELECT *, CASE WHEN tp > 0 THEN tp / (tp + fp)::double ELSE 0 END AS p, CASE WHEN tp > 0 THEN tp / (tp + fn)::double ELSE 0 END AS r FROM
(SELECT track_id, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fn, count(*) FILTER (b AND NOT a) AS fp FROM (SELECT track_id, v > 0.1 AS a, v > 0.15 OR k % 16 = 0 AS b FROM feat) WHERE a OR b GROUP BY track_id))""", "feat")  # fmt: skip
def eval_measures(spark, sf):
    return E.eval_measures(*_cells(spark, sf))


@query("track_id n k code", "", "SELECT track_id, n, k, CASE WHEN v > 0.1 THEN CASE WHEN v > 0.15 OR k % 16 = 0 THEN 'TP' ELSE 'FN' END ELSE 'FP' END AS code FROM feat WHERE v > 0.1 OR k % 16 = 0", "feat")
def eval_cells(spark, sf):
    return E.eval_cells(*_cells(spark, sf))
