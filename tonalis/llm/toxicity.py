"""Toxicity by maximum-scoring segments of token log-odds.

Learning: for each word (a run of letters, lower case) the toxic and clean training documents
that hold it, smoothed by a Dirichlet prior, give log-odds; a token's score is its log-odds less
``margin`` standard deviations, above or below zero.  The prior is hierarchical: its mean is the
mean toxic share of the other words that begin with the same PREFIX letters, each distinct word
counting once, drawn to the classes' share by ``hyper`` words.  Words that training never showed
have the score of the prior alone, which is below zero unless most words of their kind are toxic
ones.  Words and beginnings are kept as sorted 64-bit hashes.

Scoring: one linear scan (Ruzzo and Tompa) over all tokens' scores finds all maximal-scoring
segments; it is left out where even the best segment is not significant.  Under clean text, a text's best segment follows an extreme-value law (Karlin and
Altschul) whose lambda and K come from clean training documents; segments whose expected number
in a text of this length is below ``significance`` are toxic passages.  Their normalised scores
add up to the document's statistic, which a logistic curve fitted on training documents turns
into a score.

Labels are learned from a bounded sample of labelled rows (``sample``, by hash of the id; of
rows that repeat an id one); labels, language, source and id are no inputs of a score.  Null text
counts as empty: no passage, the score of a text without evidence.  Very long texts are scanned
whole.  Without both classes all scores are 0.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import built_once, crc_fold, held_out, letter_runs, materialize, strings, struct_array


PREFIX = 5


def word_hashes(found: list[str]) -> np.ndarray:
    """XXH64 with seed 42 of words, as Spark has it."""
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), found), np.uint64, len(found))


@dataclass
class Model:
    """``words``: hashes of the training's words in ascending order; ``scores``: a score for each.

    ``families`` and ``family_scores`` likewise for the beginnings of words of over PREFIX letters.
    """

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    families: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    family_scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    unseen: float = -1.0
    lam: float = 1.0
    k: float = 0.1
    significance: float = 0.2
    base: float = -30.0
    slope: float = 0.0


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a text whose tokens score ``values``.

    Ruzzo and Tompa's scan over the runs of tokens above zero: each candidate keeps the running
    total before it and at its end, and the nearest earlier candidate with a lower total before it,
    so that no candidate is looked at twice in vain.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total at the end, lower one
    totals = np.concatenate([[0.0], np.cumsum(values)])
    turns = np.flatnonzero(np.diff(values > 0, prepend=False, append=False))
    begins, ends = turns[::2], turns[1::2]
    for start, end, low, high in zip(begins.tolist(), ends.tolist(), totals[begins].tolist(), totals[ends].tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, low, high, j))
    return [(s, e, high - low) for s, e, low, high, _ in found]


def highest(values: np.ndarray) -> float:
    """The score of the best segment, 0 if no token is above zero."""
    totals = np.concatenate([[0.0], np.cumsum(values)])
    return float((totals - np.minimum.accumulate(totals)).max())


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted ``keys``, and their values or the default."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], default)


class Scorer:
    def __init__(self, model: Model):
        self.m = model

    def values(self, text: str) -> np.ndarray:
        """The scores of a text's tokens."""
        found, m = letter_runs(text.lower()), self.m
        hit, out = lookup(m.words, m.scores, word_hashes(found), m.unseen)
        new = [i for i in np.flatnonzero(~hit).tolist() if len(found[i]) > PREFIX]
        if new:
            _, out[new] = lookup(m.families, m.family_scores, word_hashes([found[i][:PREFIX] for i in new]), m.unseen)
        return out

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments with normalised scores."""
        values, m = self.values(text), self.m
        least = math.log(m.k * max(1, len(values))) - math.log(m.significance)
        if m.lam * highest(values) <= least:  # then no segment is significant
            return []
        return [(s, e, m.lam * x - least) for s, e, x in segments(values) if m.lam * x > least]

    def score(self, x: float) -> float:
        z = self.m.base + self.m.slope * math.log1p(x)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def document_frequencies(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Documents of each class that hold a word, and how often clean ones have it: word, toxic, clean, times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

        def out() -> pa.RecordBatch:
            w = list(seen[0].keys() | seen[1].keys())
            return pa.record_batch([pa.array(w, pa.string()), *(pa.array([seen[k][x] for x in w], pa.int64()) for k in (1, 0, 2))], names=["word", "toxic", "clean", "times"])

        for batch in batches:
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = Counter(letter_runs(text.lower()))
                seen[label].update(found.keys())
                if not label:
                    seen[2].update(found)
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield out()
                    for x in seen:
                        x.clear()
        yield out()

    counted = docs.select(text_col, F.col(label_col).cast("int")).mapInArrow(count, "word string, toxic long, clean long, times long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "times")])


def log_odds(toxic: np.ndarray, clean: np.ndarray, mean: np.ndarray, share: float, strength: float, margin: float) -> np.ndarray:
    """Log-odds of words against the classes' ``share``, less ``margin`` standard deviations; ``mean`` is the prior's."""
    a, b = toxic + strength * mean, clean + strength * (1 - mean)
    return np.log(a / b) - math.log(share / (1 - share)) - margin * np.sqrt(1 / a + 1 / b)


def family_means(own: np.ndarray, family: np.ndarray, share: float, hyper: float) -> tuple[np.ndarray, np.ndarray]:
    """Means of the priors from the words' ``own`` toxic shares and ``family`` numbers (-1: none).

    For each word, of the others in its family; and for each family, of all.
    """
    inside = family >= 0
    total, kinds = np.bincount(family[inside], own[inside]), np.bincount(family[inside])
    mean = np.full(len(own), share)
    at = family[inside]
    mean[inside] = (total[at] - own[inside] + hyper * share) / (kinds[at] - 1 + hyper)
    return np.maximum(mean, 1e-9), np.maximum((total + hyper * share) / (kinds + hyper), 1e-9)


def karlin(scores: np.ndarray, times: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 for tokens that occur ``times`` in clean text."""
    p = times / times.sum()
    low, high = 1e-6, 1.0
    f = lambda x: float(p @ np.exp(np.minimum(60.0, x * scores))) - 1
    while f(high) < 0 and high < 8:
        high *= 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, strength: float = 5.0, margin: float = 2.0, hyper: float = 4.0) -> Model:
    """Learn from the labelled rows of ``docs``; repeated label rows count once, as toxic if any says so.

    ``sample``: labelled ids used, by hash; ``strength``: documents that a word's prior
    weighs; ``hyper``: words that the classes' share weighs in a family.
    All words of the sample are kept.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    rows = materialize(rows.select("_text", "_y"), "labelled-texts")
    kind = F.when(F.char_length("word") > PREFIX, F.xxhash64(F.substring("word", 1, PREFIX))).alias("family")
    freq = document_frequencies(rows, "_text", "_y").select(F.xxhash64("word").alias("word"), kind, "toxic", "clean", "times").toArrow()
    toxic, clean, times = (freq.column(c).to_numpy().astype(float) for c in ("toxic", "clean", "times"))
    if not toxic.sum() or not clean.sum():
        return Model()
    share = toxic.sum() / (toxic.sum() + clean.sum())
    has = freq.column("family").is_valid().to_numpy()
    families, at = np.unique(freq.column("family").drop_null().to_numpy().view(np.uint64), return_inverse=True)
    family = np.full(len(has), -1)
    family[has] = at
    mean, of_family = family_means(toxic / (toxic + clean), family, share, hyper)
    scores, words = log_odds(toxic, clean, mean, share, strength, margin), freq.column("word").to_numpy().view(np.uint64)
    prior = lambda m: log_odds(np.zeros(len(m)), np.zeros(len(m)), m, share, strength, margin)
    order = np.argsort(words)
    model = Model(words[order], scores[order].astype(np.float32), families, prior(of_family).astype(np.float32), float(prior(np.array([share]))[0]))
    if (scores > 0).any():
        model.lam = karlin(scores, times)
    best = best_segments(spark, model)
    seen = [(r["n"], r["best"]) for r in rows.where("_y = 0").select(best(F.col("_text")).alias("b")).select("b.n", "b.best").collect() if r["n"]]
    # the likeliest K of the extreme-value law, given lambda
    model.k = min(10.0, max(1e-3, len(seen) / sum(n * math.exp(-model.lam * x) for n, x in seen))) if seen else model.k
    statistic = scorer_column(spark, model)
    seen = rows.select(statistic(F.col("_text")).alias("p"), "_y").select("p.statistic", "_y").collect()
    x = np.log1p(np.array([r["statistic"] for r in seen]))
    model.base, model.slope = logistic(x, np.array([r["_y"] for r in seen], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge; the slope is not below 0."""
    a, b = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.1 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if b > 0 else (math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0)


def best_segments(spark: SparkSession, model: Model):
    """Column function: text -> struct(n, best): its tokens, and the score of its best segment (0 if none)."""
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf("struct<n:long,best:double>")
    def best(text: pa.Array) -> pa.Array:
        data = sent.value
        scorer = built_once(("toxicity", len(data), hash(data)), lambda: Scorer(pickle.loads(data)))
        found = [scorer.values(x) for x in strings(text)]
        return struct_array([("n", pa.array(map(len, found), pa.int64())), ("best", pa.array(map(highest, found), pa.float64()))])

    return best


def scorer_column(spark: SparkSession, model: Model):
    """Column function: text -> struct(statistic, score, passages); a passage has token positions and a normalised score."""
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf("struct<statistic:double,score:double,passages:array<struct<start:int,end:int,score:double>>>")
    def score(text: pa.Array) -> pa.Array:
        data = sent.value
        scorer = built_once(("toxicity", len(data), hash(data)), lambda: Scorer(pickle.loads(data)))
        found = [scorer.passages(x) for x in strings(text)]
        x = [sum(p[2] for p in f) for f in found]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return struct_array([("statistic", pa.array(x, pa.float64())), ("score", pa.array(map(scorer.score, x), pa.float64())), ("passages", pa.array([[dict(start=s, end=e, score=v) for s, e, v in f] for f in found], kind))])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted, n_passages."""
    learn = lambda df: df.where(crc_fold(F.col(id_col)) != 2)
    model = train(learn(docs), learn(labels), id_col, text_col, **params)
    score = scorer_column(docs.sparkSession, model)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("p"))
    return out.select("doc_id", "held_out", "p.score", (F.col("p.score") >= threshold).cast("int").alias("predicted"), F.size("p.passages").cast("long").alias("n_passages"))
