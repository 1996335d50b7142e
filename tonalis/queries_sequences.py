"""SQL of alignment, decoding and streaming queries by recursive common table expressions: each row of a
table of a dynamic programme is a list made from the row before, and a second recursion walks back."""

from __future__ import annotations

from . import queries as Q

#: Cosine similarities of each track with the next one, as a list for each frame of the first.
NEXT = """unit AS MATERIALIZED (SELECT track_id, n, list(v ORDER BY k) AS e FROM (SELECT track_id, n, k, v / sqrt(sum(v * v) OVER (PARTITION BY track_id, n)) AS v FROM chroma) GROUP BY ALL),
two AS MATERIALIZED (SELECT * FROM (SELECT track_id, lead(track_id) OVER (ORDER BY track_id) AS other FROM (SELECT DISTINCT track_id FROM unit)) WHERE other IS NOT NULL),
al AS MATERIALIZED (SELECT track_id || '-' || other AS pair_id, a.n, b.n AS m, list_dot_product(a.e, b.e) AS v FROM two JOIN unit a USING (track_id) JOIN unit b ON b.track_id = other)"""
COST = NEXT + ", cr AS MATERIALIZED (SELECT pair_id, n, list(1 - v ORDER BY m) AS c FROM al GROUP BY ALL), size AS MATERIALIZED (SELECT pair_id, max(n) AS lastn, max(m) AS lastm FROM al GROUP BY ALL)"
SCORE = NEXT + """, th AS MATERIALIZED (SELECT *, coalesce(min(CASE WHEN k > 0 THEN k END) OVER (PARTITION BY pair_id), 0) AS l, max(k) OVER (PARTITION BY pair_id) AS h FROM
(SELECT *, CASE WHEN r >= max(CASE WHEN i = round_even(c * (1 - 0.15::double), 0) THEN r END) OVER (PARTITION BY pair_id) THEN r ELSE 0 END AS k FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS c FROM (SELECT *, round(v, 6) AS r FROM al)))),
cr AS MATERIALIZED (SELECT pair_id, n, list(CASE WHEN h > l THEN CASE WHEN k = 0 THEN -2 ELSE (k - l) / (h - l) END ELSE k END ORDER BY m) AS c FROM th GROUP BY ALL), size AS MATERIALIZED (SELECT pair_id, max(n) AS lastn, max(m) AS lastm FROM al GROUP BY ALL)"""
NONE = "CAST([] AS DOUBLE[])"
FAR = "1e300::double"


def _fold(pairs: str, step: str) -> str:
    """A list whose entries follow from the entry before (acc[-1]) and a pair x of numbers for each place."""
    return f"list_reduce({pairs}, lambda acc, x: list_append(acc, {step}), {NONE})"


def _places(*items: str) -> str:
    return f"list_transform(range(1, len(c.c) + 1), lambda i: [{', '.join(items)}])"


def _rows(first: str, following: str) -> str:
    """Recursion over rows n: d is the row, p the one before."""
    return f"""d AS (SELECT c.pair_id, c.n, {first} AS d, {NONE} AS p FROM cr c WHERE c.n = 0
UNION ALL SELECT c.pair_id, c.n, {following}, d.d FROM d JOIN cr c ON c.pair_id = d.pair_id AND c.n = d.n + 1),
dm AS MATERIALIZED (SELECT pair_id, n, d FROM d)"""


def _back(steps: tuple, stop: str) -> str:
    """Walking back from the end; the step listed first wins a tie."""
    value = lambda a, b: f"CASE WHEN b.m >= {b} THEN coalesce(r{a}.d[b.m + 1 - {b}], {FAR}) ELSE {FAR} END"
    least = "least(" + ", ".join(value(a, b) for a, b in steps) + ")"
    which = "CASE " + " ".join(f"WHEN {value(a, b)} = {least} THEN [{a}, {b}]" for a, b in steps) + " END"
    joins = " ".join(f"LEFT JOIN dm r{a} ON r{a}.pair_id = b.pair_id AND r{a}.n = b.n - {a}" for a in sorted({a for a, _ in steps}))
    return f"""b AS (SELECT pair_id, lastn AS n, lastm AS m, 0 AS k FROM size
UNION ALL SELECT pair_id, n - s[1], m - s[2], k + 1 FROM (SELECT b.pair_id, b.n, b.m, b.k, {which} AS s FROM b {joins} WHERE {stop}))"""


def _path(body: str) -> str:
    return f"SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY k DESC) - 1 AS INT) AS idx, n, m, total FROM ({body})"


TOTAL = "SELECT b.pair_id, b.n, b.m, b.k, r.d[lastm + 1] AS total FROM b JOIN size USING (pair_id) JOIN dm r ON r.pair_id = b.pair_id AND r.n = lastn"
CUMULATED = _fold(_places("c.c[i]", "0::double"), "x[1] + coalesce(acc[-1], 0)")
CLASSIC = _rows(CUMULATED, _fold(_places("c.c[i]", f"least(d.d[i], CASE WHEN i > 1 THEN d.d[i - 1] ELSE {FAR} END)"), f"x[1] + least(x[2], coalesce(acc[-1], {FAR}))"))
STEPS_21 = _rows(f"list_transform(range(1, len(c.c) + 1), lambda i: CASE WHEN i = 1 THEN c.c[1] ELSE {FAR} END)", f"list_transform(range(1, len(c.c) + 1), lambda i: least({FAR}, c.c[i] + least(CASE WHEN i > 1 THEN d.d[i - 1] ELSE {FAR} END, CASE WHEN i > 1 THEN coalesce(d.p[i - 1], {FAR}) ELSE {FAR} END, CASE WHEN i > 2 THEN d.d[i - 2] ELSE {FAR} END)))")


def oracle(name: str, *sql: str) -> None:
    """Register the query again, with SQL; the CTEs are recursive."""
    fn = getattr(Q, name)
    Q.query(*sql)(fn)
    Q.ORACLE_SQL[name] = Q.ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


PATH_COLUMNS = "pair_id idx n m"
oracle("dtw", PATH_COLUMNS, "total", _path(TOTAL), "chroma", f"{COST}, {CLASSIC}, {_back(((1, 1), (1, 0), (0, 1)), 'b.n > 0 OR b.m > 0')}")
oracle("dtw_21", PATH_COLUMNS, "total", _path(TOTAL), "chroma", f"{COST}, {STEPS_21}, {_back(((1, 1), (2, 1), (1, 2)), 'b.n > 0 OR b.m > 0')}")

# local alignment: scores never below 0; the path goes from the first maximum back to a score of 0
LOCAL = _rows(_fold(_places("c.c[i]", "0::double"), "greatest(0, x[1] + coalesce(acc[-1], 0))"), _fold(_places("c.c[i]", "greatest(d.d[i], CASE WHEN i > 1 THEN d.d[i - 1] ELSE 0 END)"), "greatest(0, x[1] + greatest(x[2], coalesce(acc[-1], 0)))"))
PEAK = "top AS MATERIALIZED (SELECT pair_id, arg_max([n, m], [v, -n, -m]) AS spot, max(v) AS total FROM (SELECT pair_id, n, unnest(range(0, len(d))) AS m, unnest(d) AS v FROM dm) GROUP BY pair_id)"
_VALUE = {s: f"CASE WHEN b.n >= {s[0]} AND b.m >= {s[1]} THEN coalesce(r{s[0]}.d[b.m + 1 - {s[1]}], -1) ELSE -1 END" for s in ((1, 1), (1, 0), (0, 1))}
_BEST = "greatest(" + ", ".join(_VALUE.values()) + ")"
LOCAL_BACK = f"""b AS (SELECT pair_id, spot[1] AS n, spot[2] AS m, 0 AS k FROM top WHERE total > 0
UNION ALL SELECT pair_id, n - s[1], m - s[2], k + 1 FROM (SELECT b.pair_id, b.n, b.m, b.k, {_BEST} AS v, CASE {" ".join(f"WHEN {x} = {_BEST} THEN [{a}, {b}]" for (a, b), x in _VALUE.items())} END AS s
FROM b LEFT JOIN dm r1 ON r1.pair_id = b.pair_id AND r1.n = b.n - 1 JOIN dm r0 ON r0.pair_id = b.pair_id AND r0.n = b.n WHERE b.n > 0 OR b.m > 0) WHERE v > 0)"""
oracle("common_subsequence", PATH_COLUMNS, "total", _path("SELECT b.pair_id, b.n, b.m, b.k, total FROM b JOIN top USING (pair_id)"), "chroma", f"{SCORE}, {LOCAL}, {PEAK}, {LOCAL_BACK}")

# one-to-one matching: the table has a zero border; a matched pair is where neither neighbour has the same score
MATCH = _rows(_fold(_places("c.c[i]", "0::double"), "greatest(0, x[1], coalesce(acc[-1], 0))"), _fold(_places("c.c[i] + CASE WHEN i > 1 THEN d.d[i - 1] ELSE 0 END", "d.d[i]"), "greatest(0, x[1], x[2], coalesce(acc[-1], 0))"))
MATCH_BACK = """b AS (SELECT pair_id, lastn + 1 AS n, lastm + 1 AS m, 0 AS k, false AS hit FROM size
UNION ALL SELECT b.pair_id, CASE WHEN own = aside THEN b.n ELSE b.n - 1 END, CASE WHEN own = aside THEN b.m - 1 WHEN own = above THEN b.m ELSE b.m - 1 END, b.k + 1, own <> aside AND own <> above
FROM (SELECT b.*, r0.d[b.m] AS own, CASE WHEN b.m > 1 THEN r0.d[b.m - 1] ELSE 0 END AS aside, coalesce(r1.d[b.m], 0) AS above FROM b JOIN dm r0 ON r0.pair_id = b.pair_id AND r0.n = b.n - 1 LEFT JOIN dm r1 ON r1.pair_id = b.pair_id AND r1.n = b.n - 2 WHERE b.n > 0 AND b.m > 0) b)"""
oracle("partial_matching", PATH_COLUMNS, "total", _path("SELECT b.pair_id, b.n, b.m, b.k, r.d[lastm + 1] AS total FROM b JOIN size USING (pair_id) JOIN dm r ON r.pair_id = b.pair_id AND r.n = lastn WHERE hit"), "chroma", f"{SCORE}, {MATCH}, {MATCH_BACK}")

# ---------------------------------------------------------------- decoding

_A = [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]]
_B = [[0.5, 0.2, 0.1, 0.1, 0.1], [0.1, 0.2, 0.4, 0.2, 0.1], [0.1, 0.1, 0.1, 0.2, 0.5]]
_START = [0.6, 0.2, 0.2]
_from = lambda i, j: f"(ln({_A[j][i]}::double) + v.d[{j + 1}])"
_into = lambda i: "greatest(" + ", ".join(_from(i, j) for j in range(3)) + ")"
_came = lambda i: "CASE " + " ".join(f"WHEN {_from(i, j)} = {_into(i)} THEN list_append(v.p[{j + 1}], {i})" for j in range(3)) + " END"
VITERBI = f"""em AS MATERIALIZED (SELECT track_id, n, [{", ".join(f"ln(list_extract({row}, CAST(substr(o, 1, 1) AS INT))::double)" for row in _B)}] AS e FROM states),
v AS (SELECT track_id, n, [{", ".join(f"ln({s}::double) + e[{i + 1}]" for i, s in enumerate(_START))}] AS d, [[0], [1], [2]] AS p FROM em WHERE n = 0
UNION ALL SELECT em.track_id, em.n, [{", ".join(f"{_into(i)} + e[{i + 1}]" for i in range(3))}], [{", ".join(_came(i) for i in range(3))}] FROM v JOIN em ON em.track_id = v.track_id AND em.n = v.n + 1),
fin AS (SELECT track_id, list_max(d) AS score, p[list_position(d, list_max(d))] AS path FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC) AS last FROM v) WHERE last = 1)"""
oracle("viterbi", "track_id n state", "score", "SELECT track_id, CAST(unnest(range(0, len(path))) AS BIGINT) AS n, CAST(unnest(path) AS INT) AS state, score FROM fin", "states", VITERBI)

# ---------------------------------------------------------------- spectra and tempograms

FRAMES = """fr AS MATERIALIZED (SELECT s.track_id, f AS n, CAST(k AS INT) AS k, sum(x * w * cos(2 * pi() * k * i / 64)) AS re, -sum(x * w * sin(2 * pi() * k * i / 64)) AS im FROM
(SELECT g.track_id, f, s.n + 32 - f * 24 AS i, x, 0.5::double - 0.5::double * cos(2 * pi() * (s.n + 32 - f * 24) / 64) AS w FROM (SELECT track_id, unnest(range(0, max(n + 1) // 24 + 1)) AS f FROM sig_hour GROUP BY track_id) g JOIN sig_hour s ON s.track_id = g.track_id AND s.n >= f * 24 - 32 AND s.n < f * 24 + 32) s, range(0, 33) b(k) GROUP BY ALL)"""
oracle("stft_power", "track_id n k", "v", "SELECT track_id, n, k, ln(1 + re * re + im * im) AS v FROM fr", "sig_hour", FRAMES)

FOURIER = f"""tf AS MATERIALIZED (SELECT track_id, f, bpm, sum(x * h * cos(2 * pi() * (n + 24) * bpm / 60)) AS re, -sum(x * h * sin(2 * pi() * (n + 24) * bpm / 60)) AS im FROM
(SELECT s.track_id, f, n, x, 0.5::double - 0.5::double * cos(2 * pi() * (n + 24 - f * 24) / 47) AS h FROM (SELECT track_id, unnest(range(0, (max(n) + 1) // 24 + 1)) AS f FROM sig_hour GROUP BY track_id) g JOIN sig_hour s ON s.track_id = g.track_id AND n >= f * 24 - 24 AND n < f * 24 + 24), (SELECT unnest({[float(b) for b in range(2, 21)]})::double AS bpm) GROUP BY ALL),
bt AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, f ORDER BY re * re + im * im DESC, bpm) AS r FROM tf) WHERE r = 1)"""
oracle("plp", "track_id n", "x", """SELECT track_id, n, greatest(0, x) AS x FROM (SELECT track_id, f * 24 + i - 24 AS n, sum((0.5::double - 0.5::double * cos(2 * pi() * i / 47)) * cos(2 * pi() * ((f * 24 + i) * bpm / 60 + atan2(im, re) / (2 * pi())))) AS x FROM bt, range(0, 48) t(i) GROUP BY ALL)
JOIN (SELECT track_id, max(n) + 1 AS len FROM sig_hour GROUP BY track_id) USING (track_id) WHERE n >= 0 AND n < len""", "sig_hour", FOURIER)  # fmt: skip

AUTO = """au AS MATERIALIZED (SELECT a.track_id, f AS frame, a.lag, 60 / a.lag::double AS t, coalesce(sum(s.x * u.x), 0) AS v FROM
(SELECT track_id, f, lag FROM (SELECT track_id, unnest(range(0, (max(n) + 1) // 24 + 1)) AS f FROM sig_hour GROUP BY track_id), range({0}, {1}) t(lag)) a
LEFT JOIN sig_hour s ON s.track_id = a.track_id AND s.n >= f * 24 - 24 AND s.n < f * 24 + 24 - a.lag LEFT JOIN sig_hour u ON u.track_id = s.track_id AND u.n = s.n + a.lag GROUP BY a.track_id, f, a.lag)"""


def _between(knots: str, grid: str, keys: str) -> str:
    """Linear interpolation of (keys, t, v) at the grid's times within the knots' range."""
    return f"""SELECT g.*, a.v + coalesce((b.v - a.v) / nullif(b.t - a.t, 0), 0) * (g.asked - a.t) AS v FROM {grid} g
ASOF JOIN {knots} a ON {" AND ".join(f"g.{k} = a.{k}" for k in keys.split())} AND g.asked >= a.t LEFT JOIN (SELECT *, lag(t) OVER (PARTITION BY {", ".join(keys.split())} ORDER BY t) AS before FROM {knots}) b ON {" AND ".join(f"b.{k} = a.{k}" for k in keys.split())} AND b.before = a.t"""


oracle("tempogram_autocorr", "track_id frame bpm", "v", f"SELECT track_id, frame, asked AS bpm, coalesce(v, own) AS v FROM ({_between('au', '(SELECT DISTINCT track_id, frame, asked FROM au, (SELECT unnest(range(2, 31))::double AS asked))', 'track_id frame').replace('AS v FROM', 'AS v, a.v AS own FROM', 1)})", "sig_hour", AUTO.format(2, 31))

# ---------------------------------------------------------------- streams

oracle("streaming_sessions", "user_id rows", "start stop mean", """SELECT user_id, min(us) / 1e6::double AS start, (max(us) + 21600000000) / 1e6::double AS stop, count(*) AS rows, avg(value) AS mean FROM
(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, value, epoch_us(ts) AS us FROM events)))
GROUP BY user_id, s HAVING max(us) + 21600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")  # fmt: skip
