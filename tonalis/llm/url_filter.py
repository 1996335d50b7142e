"""URL filter rules by a cascade of Bloom filters, all in JVM expressions.

Keys are a host suffix joined to a path prefix.  The listed keys are the rules'.  The complete
key universe is every key that some URL of the corpus could match: each suffix of its host (at
label borders, with no more labels than some rule's host) joined to each path prefix that is as
long as some rule's path; so a very long host or path has no more keys than a short one.  Level 1 encodes
the listed keys; the universe's keys that pass it without being listed are level 2; listed keys
that pass level 2 are level 3, and so on until nothing is left over.  For keys of the universe
the cascade's answer is exact, so URLs are judged without a join.

Level 1 is sized by the universe so that about as many keys pass wrongly as are listed; what
the driver gathers is thus bounded by the rules, of which there may be ``MOST_RULES``.

A null URL, or one without ``://``, has an empty host and path and fits no rule.  A URL that fits
no rule is allowed.  Of rules that fit, the longest wins (host and path together; ties go to
the text that sorts first).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Bloom:
    """A Bloom filter whose hashes are XXH64 of the level's letter and the key, split in two."""

    level: int
    size: int
    hashes: int
    words: list[int]

    @classmethod
    def of(cls, keys: list[str], level: int, rate: float) -> Bloom:
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        hashes = max(1, min(30, round(size / max(1, len(keys)) * math.log(2))))
        out = cls(level, size, hashes, [0] * (size // 64))
        for key in keys:
            for at in out.places(key):
                out.words[at // 64] |= 1 << at % 64
        return out

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh64_intdigest((chr(96 + self.level) + key).encode(), 42)
        return [((h & 0xFFFFFFFF) + i * (h >> 32)) % self.size for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.words[at // 64] >> at % 64 & 1 for at in self.places(key))

    def passes(self, key: Column) -> Column:
        h = F.xxhash64(F.concat(F.lit(chr(96 + self.level)), key))
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
        table = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w) for w in self.words])
        test = F.lit(True)
        for i in range(self.hashes):
            at = F.pmod(low + high * F.lit(i), F.lit(self.size))
            word = F.get(table, F.shiftrightunsigned(at, 6).cast("int"))
            test = test & F.getbit(word, F.pmod(at, F.lit(64)).cast("int")).cast("boolean")
        return test


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """All keys of a URL that a rule could be: suffixes of the host with at most as many labels as
    some rule's host, with path prefixes of rules' lengths."""
    labels = F.split(host, r"\.")
    count = F.least(F.size(labels), F.lit(most_labels))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


@dataclass
class Cascade:
    levels: list[Bloom]

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.passes(key), answer).otherwise(F.lit(level.level % 2 == 0))
        return answer


def build(universe: DataFrame, listed: list[str], key: str = "key") -> Cascade:
    """A cascade that is exact on ``universe`` (distinct keys in a column) and the listed keys."""
    total = universe.select(F.approx_count_distinct(key)).first()[0]
    rate = min(0.5, max(len(listed), 1) / max(1, total))
    while True:
        first = Bloom.of(listed, 1, rate)
        wrong_rows = universe.where(first.passes(F.col(key)) & ~F.col(key).isin(listed)).select(key).distinct()
        wrong = [r[0] for r in wrong_rows.limit(20 * len(listed) + 1001).collect()]
        if len(wrong) <= 20 * len(listed) + 1000:
            break
        rate /= 16  # rare: more passed than planned, so a larger level 1
    levels, inside, outside = [first], listed, wrong
    while outside:
        level = Bloom.of(outside, len(levels) + 1, 0.3 if len(levels) < 12 else 1e-6)
        levels.append(level)
        inside, outside = outside, [k for k in inside if k in level]
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path, else null), verdict.

    ``rules``: (verdict, host, path) with verdict ``allow`` or ``block``; of equal host and path
    the first counts.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    verdicts: dict[str, str] = {}
    for verdict, host, path in rules:
        verdicts.setdefault(host + path, verdict)
    lengths = sorted({len(path) for _, _, path in rules})
    labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not verdicts:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keyed = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    cascade = build(keyed.select(F.explode("keys").alias("key")).distinct(), sorted(verdicts))
    fits = F.filter("keys", cascade.member)
    ordered = F.array_sort(F.transform(fits, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    rule = F.get(ordered, F.lit(0))["k"]
    table = F.create_map(*[F.lit(x) for pair in sorted(verdicts.items()) for x in pair])
    return keyed.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.coalesce(table[F.col("rule")], F.lit("allow")).alias("verdict"))
