"""Language identification by interpolated Kneser-Ney character models.

Words (runs of letters, lower case) are padded by border symbols, and a model of order four
per language gives each symbol's probability after its three predecessors.  Counts come from
all training texts, and every language and four-gram is kept, so the model grows with the
distinct four-grams of the corpus.  Symbols have 21 bits, so up to three fill a 64-bit key and
four are hashed into one; each order is one sorted array of keys with a row of log probabilities
per key (a column per language), looked up by binary search.  A text goes to the language with the lowest
cross-entropy per symbol.  A temperature turns cross-entropies into a score, and a text is
rejected if even its best cross-entropy lies far above what training texts show; both are
calibrated on all training texts, the limit by exact quantiles.

A text that is null or has no letter (number signs such as fractions are none) is ``und`` with
score 0, and is rejected.  Very long texts are scored whole, distinct word by distinct word.  Ties go to
the language that sorts first.  Without any training text every document is ``und``.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import built_once, crc_fold, discard, held_out, letter_runs, materialize, strings, struct_array

ORDER = 4
BORDER = "\x01"
UND = "und"
DISCOUNT = 0.75
BITS = np.uint64(21)  # of a symbol
MASK = [np.uint64((1 << (21 * k)) - 1) for k in range(ORDER)]
TEMPERATURES = np.geomspace(0.005, 2, 30)


def words(text: str) -> list[str]:
    return letter_runs(text.lower())


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four-grams of padded words: their first symbols, their other three in one number, and the number of each word's."""
    joined = "".join(BORDER * 3 + w + BORDER for w in distinct)
    symbols = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 4 for w in distinct), np.int64, len(distinct))
    rest = symbols[3:] | symbols[2:-1] << BITS | symbols[1:-2] << np.uint64(42)
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(rest), bool)
    for k in (1, 2, 3):  # windows that reach into the next word
        at = starts[1:] - k
        keep[at] = False
    return symbols[:-3][keep], rest[keep], sizes - 3


def key_of(first: np.ndarray, rest: np.ndarray, order: int) -> np.ndarray:
    """Keys of the last ``order`` symbols; all four are hashed (Stafford's mixing) into 64 bits."""
    if order < ORDER:
        return rest & MASK[order]
    x = rest * np.uint64(0x9E3779B97F4A7C15) + first
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def context_of(first: np.ndarray, rest: np.ndarray, order: int) -> np.ndarray:
    """Keys of the symbols before the last one in an n-gram of ``order`` symbols."""
    return (rest & MASK[order]) >> BITS if order < ORDER else first << np.uint64(42) | rest >> BITS


@dataclass
class Model:
    """``keys[k]``, ``logp[k]``: order k + 1; ``contexts``, ``backoff`` likewise for contexts."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    temperature: float = 0.05
    limit: float = float("inf")

    def score(self, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log probabilities, a row for each four-gram and a column for each language."""
        out = np.zeros((len(rest), len(self.languages)), np.float32)
        left = np.arange(len(rest))
        for k in range(ORDER - 1, -1, -1):
            at, hit = find(self.keys[k], key_of(first[left], rest[left], k + 1))
            out[left[hit]] += self.logp[k][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            at, hit = find(self.contexts[k], context_of(first[left], rest[left], k + 1))
            out[left[hit]] += self.backoff[k][at[hit]]
        else:
            out[left] += self.unseen
        return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def build(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney tables from each language's distinct four-grams (first, rest) and their counts."""
    n = len(languages)
    # by language and order: keys, their contexts, their lower-order keys, counts
    levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
    for lang in languages:
        first, rest, count = counts[lang]
        by_order = [(key_of(first, rest, ORDER), context_of(first, rest, ORDER), rest, count.astype(float))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before a shorter gram
            key, count = np.unique(rest & MASK[k], return_counts=True)
            by_order.insert(0, (key, key >> BITS, key & MASK[k - 1], count.astype(float)))
            rest = key
        levels.append(by_order)
    symbols = np.unique(np.concatenate([x[0][0] for x in levels]))
    keys, logp, contexts, backoff = [], [], [], []
    unseen_p = np.zeros(n)
    lower: np.ndarray | None = None
    for k in range(ORDER):
        all_keys, where = np.unique(np.concatenate([x[k][0] for x in levels]), return_index=True)
        all_contexts, of_context = np.unique(np.concatenate([x[k][1] for x in levels])[where], return_inverse=True)
        shorter = np.concatenate([x[k][2] for x in levels])[where]
        p, gamma_of = np.zeros((len(all_keys), n)), np.ones((len(all_contexts), n))
        for i, by_order in enumerate(levels):
            key, _, _, count = by_order[k]
            own = np.searchsorted(all_keys, key)
            ctx = of_context[own]
            total = np.bincount(ctx, count, len(all_contexts))
            kinds = np.bincount(ctx, minlength=len(all_contexts))
            seen = total > 0
            gamma_of[seen, i] = DISCOUNT * kinds[seen] / total[seen]
            p[own, i] = np.maximum(count - DISCOUNT, 0) / total[ctx]
            base = 1.0 / (len(symbols) + 1) if lower is None else lower[np.searchsorted(keys[-1], shorter), i]
            p[:, i] += gamma_of[of_context, i] * base
        if lower is None:
            unseen_p = np.log(np.maximum(gamma_of[0] / (len(symbols) + 1), 1e-12))
            gamma_of = np.ones_like(gamma_of)  # already in unseen_p
        keys.append(all_keys)
        logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        contexts.append(all_contexts)
        backoff.append(np.log(np.maximum(gamma_of, 1e-12)).astype(np.float32))
        lower = p
    return Model(languages, keys, logp, contexts, backoff, unseen_p.astype(np.float32))


class Scorer:
    """Scores texts; each distinct word is scored once while it is remembered."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model = model
        self.known: dict[str, int] = {}
        self.most = most = max(1000, min(most, 20_000_000 // (len(model.languages) + 1)))
        self.rows = np.zeros((most, len(model.languages) + 1), np.float32)

    def sums(self, text: str) -> np.ndarray | None:
        """Log probability of each language, and last the number of symbols; None without a letter."""
        found = words(text)
        if not found:
            return None
        known = self.known
        fresh = list({w for w in found if w not in known})
        if len(known) + len(fresh) > self.most:
            known.clear()
            fresh = list(set(found))
        if len(fresh) > self.most:  # a text of more distinct words than are ever remembered
            return self._direct(Counter(found))
        if fresh:
            at = len(known)
            self.rows[at : at + len(fresh)] = self._words(fresh)
            known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return self.rows[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum(0, dtype=np.float64)

    def _words(self, distinct: list[str]) -> np.ndarray:
        first, rest, sizes = grams(distinct)
        value = self.model.score(first, rest)
        sums = np.add.reduceat(value, np.cumsum(sizes) - sizes, axis=0)
        return np.concatenate([sums, sizes[:, None].astype(np.float32)], axis=1)

    def _direct(self, freq: Counter) -> np.ndarray:
        distinct, total = list(freq), np.zeros(len(self.model.languages) + 1)
        for i in range(0, len(distinct), 50_000):
            part = distinct[i : i + 50_000]
            total += (self._words(part).astype(float) * np.array([freq[w] for w in part])[:, None]).sum(0)
        return total

    def entropy(self, text: str) -> np.ndarray | None:
        """Nats per symbol in each language."""
        sums = self.sums(text)
        return None if sums is None else -sums[:-1] / sums[-1]


def count_grams(docs: DataFrame, text_col: str, lang_col: str, flush: int = 200_000) -> DataFrame:
    """Four-gram counts of each language over all rows of ``docs``: lang, first, rest, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, freq in seen.items():
                first, rest, sizes = grams(list(freq))
                weight = np.repeat(np.fromiter(freq.values(), np.int64, len(freq)), sizes)
                order = np.lexsort((first, rest))
                first, rest, weight = first[order], rest[order], weight[order]
                new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])))
                yield pa.record_batch([pa.array([lang] * len(new)), pa.array(first[new].view(np.int64)), pa.array(rest[new].view(np.int64)), pa.array(np.add.reduceat(weight, new))], names=["lang", "first", "rest", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                found = words(text)
                if found:
                    seen.setdefault(lang, Counter()).update(found)
                if sum(map(len, seen.values())) > flush:
                    yield from out()
        yield from out()

    return docs.select(lang_col, text_col).mapInArrow(count, "lang string, first long, rest long, n long").groupBy("lang", "first", "rest").agg(F.sum("n").alias("n"))


def send(spark: SparkSession, model: Model):
    """Broadcast the tables without what is calibrated, so that a worker needs one scorer before and after."""
    return spark.sparkContext.broadcast(pickle.dumps(replace(model, temperature=0.0, limit=0.0)))


def scorer_of(data: bytes) -> Scorer:
    return built_once(("langid", len(data), hash(data)), lambda: Scorer(pickle.loads(data)))


def calibration(docs: DataFrame, model: Model, text_col: str, lang_col: str) -> DataFrame:
    """``best``: the lowest cross-entropy of each row that has a letter; ``losses``: a task's sums for TEMPERATURES."""
    sent = send(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        at = {x: i for i, x in enumerate(scorer.model.languages)}
        losses = np.zeros(len(TEMPERATURES))
        kinds = pa.schema([("best", pa.float64()), ("losses", pa.list_(pa.float64()))])
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                found = [(e, at[x]) for x, text in zip(part.column(0).to_pylist(), strings(part.column(1)), strict=True) if (e := scorer.entropy(text)) is not None]
                if not found:
                    continue
                e, truth = np.array([e for e, _ in found]), np.array([x for _, x in found])
                best = e.min(1)
                for i, t in enumerate(TEMPERATURES):
                    z = -(e - best[:, None]) / t
                    losses[i] += (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).sum()
                yield pa.record_batch([pa.array(best), pa.nulls(len(best), kinds.types[1])], schema=kinds)
        yield pa.record_batch([pa.nulls(1, kinds.types[0]), pa.array([losses.tolist()], kinds.types[1])], schema=kinds)

    return docs.select(lang_col, text_col).mapInArrow(score, "best double, losses array<double>")


def at_ranks(values: DataFrame, ranks: set[int], few: int = 100_000, bins: int = 4096) -> dict[int, float]:
    """The values at ``ranks`` (from 0, ascending) of a column of finite doubles: only bins that hold a rank are looked into."""
    x = F.col(values.columns[0])
    n, low, high = values.agg(F.count(x), F.min(x), F.max(x)).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= few:
        ordered = np.sort(values.toArrow().column(0).to_numpy())
        return {r: float(ordered[r]) for r in ranks}
    place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))
    out, before = {}, 0
    for b, size in sorted(map(tuple, values.groupBy(place).count().collect())):
        inside = {r - before for r in ranks if before <= r < before + size}
        if inside:
            out |= {before + r: v for r, v in at_ranks(values.where(place == b), inside, few, bins).items()}
        before += size
    return out


def quantiles(values: DataFrame, shares: list[float]) -> list[float]:
    """Exact quantiles of a column of finite doubles, linear between neighbours."""
    last = values.count() - 1
    below = [int(last * q) for q in shares]
    found = at_ranks(values, {min(r + k, last) for r in below for k in (0, 1)})
    return [found[r] + (last * q - r) * (found[min(r + 1, last)] - found[r]) for q, r in zip(shares, below, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from ``docs`` (rows with a null language or text take no part)."""
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text is not null and _lang is not null")
    kept = count_grams(rows, "_text", "_lang").toPandas()
    if not len(kept):
        return Model([], [], [], [], [], np.zeros(0, np.float32))
    table = {}
    for lang, own in kept.groupby("lang", sort=False):
        table[lang] = (own["first"].to_numpy(np.int64).view(np.uint64), own["rest"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64))
    languages = sorted(table)
    model = build(languages, table)
    seen = materialize(calibration(rows, model, "_text", "_lang"), "calibration")
    losses = np.array([r["losses"] for r in seen.where("losses is not null").collect()])
    median, high = quantiles(seen.select("best").where("best is not null"), [0.5, 0.999])
    discard(seen)
    model.limit = high + 3 * (high - median) + 0.5
    model.temperature = float(TEMPERATURES[np.argmin([math.fsum(x) for x in losses.T])])
    return model


def predictor(spark: SparkSession, model: Model):
    """Column function: text -> struct(lang_pred, score, rejected, entropy)."""
    sent, temperature, limit = send(spark, model), model.temperature, model.limit
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("entropy", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(text: pa.Array) -> pa.Array:
        scorer = scorer_of(sent.value)
        m = scorer.model
        lang, score, rejected, entropy = [], [], [], []
        for x in strings(text):
            e = scorer.entropy(x) if m.languages else None
            if e is None:
                lang.append(UND), score.append(0.0), rejected.append(not words(x)), entropy.append(None)
                continue
            at = int(e.argmin())
            lang.append(m.languages[at])
            score.append(float(1 / np.exp(-(e - e[at]) / temperature).sum()))
            rejected.append(bool(e[at] > limit))
            entropy.append(float(e[at]))
        return struct_array([("lang_pred", pa.array(lang, pa.string())), ("score", pa.array(score, pa.float64())), ("rejected", pa.array(rejected, pa.bool_())), ("entropy", pa.array(entropy, pa.float64()))])

    return predict


def identify(docs: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """Predict every document: doc_id, held_out, lang_pred, score, rejected.

    Learns from the rows of ``training`` (default ``docs``) outside the held-out quarter.
    """
    training = docs if training is None else training
    model = train(training.where(crc_fold(F.col(id_col)) != 2), id_col, text_col, lang_col, **params)
    predict = predictor(docs.sparkSession, model)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
