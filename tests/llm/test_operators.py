"""The ten training-data operators against brute force, and on nulls, empty and repeated rows."""

import base64
import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonalis.llm import byte_bpe, caps, components, langid, packing, piece_counts, queries, simhash, topk, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, _text string, key string"
LONG = "word " * 30_000 + "\u00e9\u4e2d\U0001f600 end"
TEXTS = [None, "", " \n\t ", "a", "Hello, world's  best!\n\n 12 345", LONG, "naïve \u00b2 ½ \u2581 mark", "<|endoftext|> </s> <unk>", "\U0001f600\u200d x\x00y", "Hello, world's  best!\n\n 12 345"]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls everywhere, repeats, and extra columns whose names the operators use inside."""
    rows = [(i, t, "en", None, None, "clash", "clash", "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})


# ---------------------------------------------------------------- 1 byte-level BPE


def test_bpe_equals_the_library(docs, none):
    enc, path = tiktoken_encoding(), P.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.encode_documents(docs, path, P.PATTERN, decode=True).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids) and bytes(r["decoded"]).decode() == text
    assert byte_bpe.encode_documents(none, path, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("abcdeo' \n1é", max_size=60))
def test_bpe_on_any_text(text):
    bpe = byte_bpe.codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    ids = tiktoken_encoding_cached().encode_ordinary(text)
    assert bpe.encode_packed(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert bpe.decode_packed(bpe.encode_packed(text)) == text.encode()


_ENC = []


def tiktoken_encoding_cached():
    if not _ENC:
        _ENC.append(tiktoken_encoding())
    return _ENC[0]


# ---------------------------------------------------------------- 2 toxicity


def brute_segments(s):
    """All maximal segments by their recursive definition."""

    def find(a, b):
        best = (0, None)
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += s[j]
                if total > best[0]:
                    best = (total, (i, j + 1))
        if best[1] is None:
            return []
        i, j = best[1]
        return [*find(a, i), (i, j), *find(j, b)]

    return find(0, len(s))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=25))
def test_segments_are_the_maximal_ones(values):
    values = [v + (i + 2) ** 0.5 / 1000 for i, v in enumerate(values)]  # no ties between sums
    got = [(s, e) for s, e, _ in toxicity.segments(np.array(values, float))]
    want = brute_segments(values)
    assert got == want
    assert toxicity.highest(np.array(values, float)) == pytest.approx(max((sum(values[s:e]) for s, e in want), default=0))


def brute_model(texts, labels, strength=5.0, margin=2.0, hyper=4.0):
    """Scores of words, and of words not seen by their first five letters, by their definition."""
    held = [set(re.findall(r"[a-z]+", t)) for t in texts]
    count = {w: [sum(w in h and y == k for h, y in zip(held, labels)) for k in (0, 1)] for h in held for w in h}
    total = [sum(c[k] for c in count.values()) for k in (0, 1)]
    share = total[1] / sum(total)

    def mean(prefix, but=None):
        kin = [t / (t + c) for w, (c, t) in count.items() if len(w) > 5 and w[:5] == prefix and w != but]
        return (sum(kin) + hyper * share) / (len(kin) + hyper)

    def score(c, t, m):
        a, b = t + strength * m, c + strength * (1 - m)
        return np.log(a / b * (1 - share) / share) - margin * (1 / a + 1 / b) ** 0.5

    words = {w: score(c, t, mean(w[:5], w) if len(w) > 5 else share) for w, (c, t) in count.items()}
    return words, lambda w: score(0, 0, mean(w[:5]) if len(w) > 5 else share)


def test_word_scores_and_passages_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    labels = [int(i % 4 == 0) for i in range(200)]
    texts = [" ".join(rng.choices(words, k=60) + rng.choices(["vile", "nasty", "wicked", "wickedly", "wickeder"], k=4 if y else 0) + rng.choices(words, k=20)) for y in labels]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    want, new = brute_model(texts, labels)
    scorer = toxicity.Scorer(model)
    others = ["wickedest", "wicke", "unknown", "vile"]
    assert scorer.values(" ".join(others)).tolist() == pytest.approx([want.get(w) or new(w) for w in others], rel=1e-5)
    assert dict(zip(want, scorer.values(" ".join(want)).tolist())) == pytest.approx(want, rel=1e-5) and min(want.values()) < 0 < max(want.values())
    assert len(model.words) == len(want)
    long = " ".join([texts[0]] + [w for t in texts[1:4] for w in t.split()] * 100 + [texts[4]])
    for text in [*texts[:20], "", "unknown words only, the wickedest", "vile vile vile", long]:
        values = [float(np.float32(want[w] if w in want else new(w))) for w in re.findall('[a-z]+', text)]
        found = toxicity.segments(np.array(values)) if len(values) > 500 else [(s, e, sum(values[s:e])) for s, e in brute_segments(values)]
        least = np.log(model.k * max(1, len(values)) / model.significance)
        expected = [(s, e, model.lam * x - least) for s, e, x in found if model.lam * x > least]
        got = scorer.passages(text)
        assert [p[:2] for p in got] == [p[:2] for p in expected] and [p[2] for p in got] == pytest.approx([p[2] for p in expected], rel=1e-3, abs=1e-3)
    assert len(scorer.passages(long)) >= 2  # passages far apart in a very long text are both found


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    rng = random.Random(1)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = rng.choices(words, k=80)
        if i % 5 == 0:
            for _ in range(4):
                t.insert(rng.randrange(80), rng.choice(["vile", "nasty", "horrid"]))
        rows.append((i, " ".join(t), "clash"))
        labels.append((i, None, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None, None), (1001, "", None), (None, "vile nasty", None)], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, None, 1), (5, None, None), (0, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, known).collect()}
    assert len(got) == 403
    held = [r for i, r in got.items() if i is not None and i < 400 and r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert got[1000]["score"] == got[1001]["score"] < 0.3
    assert [r["score"] for r in toxicity.score_documents(docs, known.where("toxic = 0")).limit(3).collect()] == [pytest.approx(0, abs=1e-9)] * 3
    assert toxicity.score_documents(docs.limit(0), known.limit(0)).count() == 0


# ---------------------------------------------------------------- 3 exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((400, 20)) + np.repeat(rng.standard_normal((40, 20)), 10, 0) * 2
    X[50:80] = X[50]
    rows = [(i, [float(v) for v in x], "clash") for i, x in enumerate(X)]
    odd = [(1000, None, ""), (1050, [None] * 20, ""), (1100, [float("nan")] * 20, ""), (1150, [1.0, 2.0], ""), (None, [1.0] * 20, ""), (1200, [], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id string")
    got = tuples(topk.top_k(df, every=50, k=5), "query_id", "rank", "vec_id", "score")
    Q = np.floor(256 * X).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        s = Q @ Q[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]
    assert got == sorted(want, key=str)
    small = tuples(topk.top_k(df, every=50, k=5, block=3), "query_id", "rank", "vec_id", "score")
    assert small == got
    assert tuples(topk.top_k(df, every=50, k=5, hold_bytes=1), "query_id", "rank", "vec_id", "score") == got
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_components_and_repeated_ids(spark):
    """Whole-number products beyond what doubles hold; the smaller of two rows with one id is asked; saturated scores."""
    rng = np.random.default_rng(6)
    X = [[float(v) for v in x] for x in rng.standard_normal((60, 8)) * 2.0 ** rng.integers(0, 24, (60, 1))]
    X[0], X[7], X[8] = [70000.0, 1.0] + [0.0] * 6, [1e200] * 8, [-1e200] * 8
    rows = [(i, x) for i, x in enumerate(X)] + [(50, [1.0] * 8)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    Q = [(i, [int(np.floor(256 * v)) for v in x]) for i, x in rows]
    for q in (0, 50):
        asked = min((np.array(v, "<f8").tobytes(), v) for i, v in Q if i == q)[1]
        s = [(max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(asked, v)))), i) for i, v in Q if i != q]
        assert [got[q, r + 1] for r in range(5)] == [(i, x) for x, i in sorted(s, key=lambda x: (-x[0], x[1]))[:5]]


# ---------------------------------------------------------------- 4 packing


def check_packing(got, texts, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, rows in by_doc.items():
        ids = t.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        for r in rows:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"] and r["start"] == capacity * r["piece"]
        assert sum(r["length"] for r in rows) % len(ids) == 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)


def test_packing_keeps_all_tokens(docs, none):
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    check_packing(got, dict(enumerate(TEXTS)))
    assert {r["doc_id"] for r in got} == set(range(len(TEXTS)))
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=9))
def test_small_plans_are_optimal(lengths):
    def least(rest, rooms):
        if not rest:
            return len(rooms)
        x, best = rest[0], 99
        for i in range(len(rooms)):
            if rooms[i] >= x and rooms[i] not in rooms[:i]:
                best = min(best, least(rest[1:], [*rooms[:i], rooms[i] - x, *rooms[i + 1 :]]))
        return min(best, least(rest[1:], [*rooms, 10 - x]))

    got = packing.plan(dict(Counter(lengths)), 10)
    assert sum(n for _, n in got) == least(sorted(lengths, reverse=True), [])
    assert Counter({k: sum(p.get(k, 0) * n for p, n in got) for k in set(lengths)}) == Counter(lengths)
    assert all(sum(k * v for k, v in p.items()) <= 10 for p, _ in got)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 30), st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5))
def test_fillings_have_the_least_waste(rest, left):
    sums = {0}
    for length, n in left.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= rest}
    got = packing.complete(rest, sorted(left), left)
    assert all(n <= left[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == max(sums)


@pytest.mark.parametrize("seed", range(6))
def test_plans_of_many_pieces(seed):
    """Instances whose pieces were cut from full sequences, so that the bound can be met; and a bound above the tokens'."""
    rng = random.Random(seed)
    lengths = []
    for _ in range(40 + 400 * (seed % 2)):
        cuts = sorted(rng.sample(range(1, 100), rng.randrange(1, 4)))
        lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
    got = packing.plan(dict(Counter(lengths)), 100)
    assert Counter({k: sum(p.get(k, 0) * n for p, n in got) for k in set(lengths)}) == Counter(lengths)
    assert all(sum(k * v for k, v in p.items()) <= 100 for p, _ in got)
    assert sum(lengths) // 100 <= sum(n for _, n in got) <= sum(lengths) // 100 + 1
    assert packing.lower_bound({60: 10, 50: 3, 30: 4}, 100) == 12


def test_fillings_mix_counts_of_a_length():
    histogram = {2096: 1000, 800: 1000, 600: 2000}
    got = packing.plan(histogram, 4096)
    assert sum(n for _, n in got) == 1000
    assert {k: sum(p.get(k, 0) * n for p, n in got) for k in histogram} == histogram


# ---------------------------------------------------------------- 5 SimHash


def brute_fingerprint(text, n=4, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, bits):
    label = dict(zip(ids, ids))
    while True:
        new = {a: min(label[b] for b, q in zip(ids, prints) if (p ^ q).bit_count() <= bits) for a, p in zip(ids, prints)}
        if new == label:
            return label
        label = new


def test_simhash_equals_brute_force(docs, none):
    got = tuples(simhash.near_duplicates(docs), "doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id")
    prints = [brute_fingerprint(t) for t in TEXTS]
    label = classes(list(range(len(TEXTS))), prints, 4)
    want = [(i, f"{prints[i]:016x}", label[i]) for i in [*range(len(TEXTS)), 4]]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0


def near_codes(rng, n):
    """Codes of which half lie within four bits of another, and a dense cluster."""
    codes = rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)
    near = codes.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 63, n // 2, dtype=np.uint64)
    cluster = codes[0] ^ (np.uint64(1) << rng.integers(0, 63, n // 4, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, n // 4, dtype=np.uint64))
    return np.unique(np.concatenate([codes, near, cluster, [np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)]]))


def connected(codes, bits):
    label = np.arange(len(codes))
    close = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits
    while True:
        new = np.where(close, label[None, :], len(codes)).min(1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("n", [2, 20, 300, 3000])
def test_gray_index_connects_what_brute_force_connects(n):
    codes = near_codes(np.random.default_rng(n), n)
    want = connected(codes, 4)
    union, index = components.Union(len(codes)), simhash.GrayIndex(codes)
    visits = simhash.walk(index, index, 4, union)
    assert np.array_equal(union.label, want)
    assert 0 < visits and (n < 3000 or visits < len(codes) * (len(codes) - 1) / 2)  # whole groups are dropped
    half, whole = len(codes) // 2, components.Union(len(codes))
    for part, at in ((codes[:half], 0), (codes[half:], half)):
        own = components.Union(len(part))
        one = simhash.GrayIndex(part)
        simhash.walk(one, one, 4, own)
        whole.add(np.arange(len(part)) + at, own.label + at)
    a, b = simhash.segment_links(codes, np.arange(len(codes)), (np.arange(len(codes)) >= half).astype(int), 4)
    whole.add(a, b)
    assert np.array_equal(whole.label, want)


def test_fingerprint_segments_lose_no_link(spark):
    """Many small segments and one, chains across them, and groups of over a thousand links."""
    codes = np.concatenate([near_codes(np.random.default_rng(8), 1600), np.array([sum(1 << (k % 64) for k in range(i, i + 3)) for i in range(0, 60, 2)], np.uint64)])
    codes = np.unique(codes)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(codes.view(np.int64).tolist())], "fp long, node long")
    label = connected(codes, 4)
    size = np.bincount(label, minlength=len(codes))
    want = {i: int(x) for i, x in enumerate(label) if size[x] > 1}
    assert size.max() > 300
    for params in (dict(largest=100), dict(parts=1), {}):
        parts = components.connected_components(simhash.fingerprint_links(nodes, 4, **params))
        assert {r["node"]: r["component"] for r in parts.collect()} == want


# ---------------------------------------------------------------- 6 WARC


def test_warc_round_trip(spark):
    html = [None, "", "x", "y" * 300_000, "x", "<p>é</p>", "", "x"]
    rows = [(i, f"http://h/{i} z" if i % 3 else None, h, "clash") for i, h in enumerate(html)] + [(None, None, "lonely", ""), (2, "again", "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, body string")
    got = tuples(warc.round_trip(pages, 0, chunk_bytes=1000), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        same = [j for j, _, g, _ in rows if (g or "").encode() == b and j is not None]
        first = min(same) if same else None
        hit = first is None or first == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if hit else "revisit", None if hit else first))
    assert got == sorted(want, key=str)
    bounded = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages.where("page_id is not null"), 2, chunk_bytes=1000).collect()}
    assert set(bounded.values()) == {"response"}
    copies = spark.createDataFrame([(i, None, "z" * 5_000_000 if i % 3 else str(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.round_trip(copies).collect()} == {i: (5_000_000 if i % 3 else len(str(i)), 1 if i % 3 and i > 1 else None) for i in range(12)}
    assert warc.round_trip(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 7 language ID


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    syllables = {"aa": ["ba", "ko", "lu", "mi"], "bb": ["sch", "en", "ung", "tra"], "cc": ["oux", "é", "ille", "que"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(30)), g, "clash") for i, g in enumerate(rng.choices(list(syllables), k=300))]
    odd = [(900, None, "aa", ""), (901, "", None, ""), (902, "123 !?", "bb", ""), (904, "\u00bd \u2461 \u2167 x\u00b2"[:5], None, ""), (905, "bako lumi " * 60_000, None, ""), (906, "\U00010400\U00010428", None, ""), (903, "ЖЖЖ ЩЩЩ ЫЫЫ ЪЪЪ ЯЯЯ", None, ""), (None, "bako lumi", None, "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == 308 and got[905]['lang_pred'] == 'aa' and got[906]['rejected'] and got[906]['lang_pred'] in syllables
    assert all(got[i]["lang_pred"] == g for i, _, g, _ in rows)
    assert not any(got[i]["rejected"] for i, *_ in rows)
    for i in (900, 901, 902, 904):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[903]["rejected"] and got[903]["lang_pred"] in syllables
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_language_and_four_gram_is_learned(spark):
    """More than 64 languages, and one of more than 200,000 distinct four-grams."""
    rows = [(i, f"{chr(0x4E00 + 20 * i)}{chr(0x4E01 + 20 * i)} " * 20, f"l{i:02d}") for i in range(70)]
    rng = random.Random(11)
    wide = ["".join(chr(0xAC00 + rng.randrange(5000)) for _ in range(8)) for _ in range(25_000)]
    rows += [(100 + k, " ".join(wide[k::50]), "wide") for k in range(50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({r[2] for r in rows})
    scorer = langid.Scorer(model)
    assert all(model.languages[int(scorer.entropy(t).argmin())] == g for _, t, g in rows)
    first, rest, _ = langid.grams(sorted({w for _, t, _ in rows for w in langid.words(t)}))
    want = np.unique(langid.key_of(first, rest, 4))
    assert len(want) > 200_000 and np.array_equal(model.keys[3], want)


def test_calibration_counts_every_training_text(spark):
    """Texts beyond the first 4000 by hash of the id, and those without an id, move limit and temperature as well."""
    rng = random.Random(12)
    plain = {"aa": ["ba", "ko", "lu", "mi"], "bb": ["sch", "en", "ung", "tra"]}
    ids = [r["id"] for r in spark.range(4400).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, " ".join("".join(rng.choices(plain[g], k=2)) for _ in range(6)), g) for i, g in zip(ids[:4000], rng.choices(list(plain), k=4000))]
    rows += [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)), "aa") for i in ids[4000:]]  # little like their language
    rows += [(None, "".join(rng.choices(plain["bb"], k=2)), "aa") for _ in range(600)]  # marked wrongly
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    scorer = langid.Scorer(model)
    e = np.array([scorer.entropy(t) for _, t, _ in rows])
    best, own = e.min(1), e[np.arange(len(rows)), [model.languages.index(g) for _, _, g in rows]]
    middle, high = np.quantile(best, [0.5, 0.999])
    assert model.limit == pytest.approx(high + 3 * (high - middle) + 0.5, rel=1e-9)
    loss = lambda t: np.mean(np.log(np.exp((best[:, None] - e) / t).sum(1)) + (own - best) / t)
    assert model.temperature == min(np.geomspace(0.005, 2, 30), key=loss)


def test_values_at_ranks_equal_sorting(spark):
    rng = random.Random(13)
    x = [rng.choice([1.0, 1.5, rng.expovariate(1), 1e9 * rng.random()]) for _ in range(1000)] + [1.0, 1.0 + 2**-52]
    values = spark.createDataFrame([(v,) for v in x], "x double")
    ranks = {0, 1, 400, 401, 500, 1000, 1001}
    for few, bins in (1, 64), (50, 16), (2000, 16):
        assert langid.at_ranks(values, ranks, few, bins) == {r: sorted(x)[r] for r in ranks}
    assert langid.quantiles(values, [0.0, 0.5, 0.999, 1.0]) == pytest.approx(np.quantile(x, [0, 0.5, 0.999, 1]), rel=1e-12)


def gram_counts(texts):
    """Distinct four-grams (first, rest) and their counts."""
    freq = Counter()
    for w in (w for t in texts for w in langid.words(t)):
        first, rest, _ = langid.grams([w])
        freq.update(zip(first.tolist(), rest.tolist()))
    return tuple(np.array(x, np.uint64) for x in zip(*freq)) + (np.array(list(freq.values())),)


def four_grams(strings):
    codes = np.array([[ord(c) for c in s] for s in strings], np.uint64)
    return codes[:, 0], codes[:, 1] << np.uint64(42) | codes[:, 2] << np.uint64(21) | codes[:, 3]


def brute_kneser_ney(texts, n_symbols):
    """Probabilities by the definition, count by count."""
    padded = ["\x01" * 3 + w + "\x01" for t in texts for w in langid.words(t)]
    counts = {4: Counter(p[i : i + 4] for p in padded for i in range(len(p) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (n_symbols + 1)
        same = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - 0.75, 0) / total + 0.75 * len(same) / total * p(gram[1:])

    return p


def test_kneser_ney_probabilities_add_up_and_equal_brute_force():
    texts = ["abab abba bab", "\U00010448b ab \u0448\U00010448"]  # the last two symbols have the same lower 16 bits
    m = langid.build(["x", "y"], {"x": gram_counts(texts[:1]), "y": gram_counts(texts)})
    symbols = ["a", "b", "\x01", "\U00010448", "\u0448"]
    for column, own in (0, texts[:1]), (1, texts):
        p = brute_kneser_ney(own, len(symbols))
        for context in ("\x01\x01\x01", "\x01ab", "zzz", "\x01\u0448\U00010448", "bab"):
            got = np.exp(m.score(*four_grams([context + s for s in [*symbols, "?"]])))[:, column]
            assert got == pytest.approx([p(context + s) for s in [*symbols, "?"]], rel=1e-4)
            assert got.sum() == pytest.approx(1, abs=1e-5)  # ? stands for the unseen symbol


# ---------------------------------------------------------------- 8 token counts


def test_counts_equal_the_library(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tuples(piece_counts.count_tokens(docs, path, limit=5), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i in [*range(len(TEXTS)), 4]:
        n = len(sp.encode(TEXTS[i] or ""))
        want.append((i, len((TEXTS[i] or "").encode()), n, n > 5))
    assert got == sorted(want, key=str)
    for head in (0, 3):  # the shuffled join alone, and both ways
        assert tuples(piece_counts.count_tokens(docs, path, limit=5, head=head), "doc_id", "n_bytes", "n_tokens", "over_limit") == got
    assert piece_counts.count_tokens(none, path).count() == 0


def test_runs_count_each_pre_token_once():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((f" w{rng.randrange(50)}", rng.randrange(20), rng.randrange(1, 4)) for _ in range(900))
    asked, got, want = Counter(), Counter(), Counter()
    cut = []
    for part in ([(None, 3, 1000)], rows[:7], rows[7:7], rows[7:500], rows[500:]):
        pre, row, n = zip(*part) if part else ((), (), ())
        cut.append(pa.record_batch([pa.array(row, pa.int64()), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.int64()), pa.array(n, pa.int64()), pa.array(pre, pa.string())], names=["row", "doc_id", "n_bytes", "n", "pre"]))

    def count(pre):
        asked[pre] += 1
        return len(pre)

    for b in piece_counts.sum_runs(iter(cut), count):
        got.update(dict(zip(b.column("row").to_pylist(), b.column("n").to_pylist())))
    want[3] = 1000
    for pre, row, times in rows:
        want[row] += times * len(pre)
    assert got == want and set(asked.values()) == {1}


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=50) | st.text("ab \n\t▁<s>/é", max_size=50))
def test_counts_on_any_text(text):
    path = P.path("piece_bpe_32k.model")
    c = piece_counts.built_once(("test", path), lambda: piece_counts.PieceCounter(open(path, "rb").read()))
    assert c.count(text) == len(c.model.encode(text))


# ---------------------------------------------------------------- 9 URL filters


def brute_verdict(url, rules):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://a.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/2", "https://xexample.org/es/", "http://org/", "http://b.com/de/", "http://com/fr/x", "ftp://COM", "http://a..com/de/", "http://x.com?/de/", "http://h/a://b.com/de/", "http://.org/", "http://" + "l." * 8000 + "example.org/es/" + "p" * 20_000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[4], "")], "page_id long, url string, keys string")
    got = tuples(url_filter.judge(pages, queries.RULES), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *brute_verdict(u, queries.RULES)) for i, u in [*enumerate(urls), (None, urls[4])]], key=str)
    assert url_filter.judge(pages.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::7]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.build(universe, listed)
    assert len(cascade.levels) > 1
    assert {r["key"] for r in universe.where(cascade.member(F.col("key"))).collect()} == set(listed)


# ---------------------------------------------------------------- 10 embedding near-dedup


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    X = np.concatenate([base, base[:30] + 0.18 * rng.standard_normal((30, 32)), np.repeat(base[:1], 40, 0), base[:20] + 0.3 * rng.standard_normal((20, 32))])
    n = len(X)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [None] * 32), (1004, [float("inf")] * 32), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    df = spark.createDataFrame([(i, [float(v) for v in x], "clash", 1) for i, x in enumerate(X)] + [(i, v, "", None) for i, v in odd], "vec_id long, embedding array<double>, key string, label int")
    got = {r["vec_id"]: tuple(r)[1:4] for r in caps.near_duplicates(df, most=10).collect()}
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    close = U @ U.T >= 0.95
    label = np.arange(n)
    while True:
        new = np.where(close, label[None, :], n).min(1)
        if (new == label).all():
            break
        label = new
    want = {i: (int(close[i].sum()) - 1, int(label[i]), bool(label[i] == i)) for i in range(n)}
    want |= {i: (0, i, True) for i, _ in odd[:5]} | {1005: (1, 1005, True), 1006: (1, 1005, False)}
    assert got == want
    assert caps.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_recall_on_the_large_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = rows.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    X = np.stack(got.embedding.to_list()).astype(float)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    want = int((U @ U.T >= 0.95).sum()) - len(X)
    found = caps.near_duplicates(rows).agg(F.sum("n_links")).first()[0]
    assert 0.99 * want <= found <= want


@pytest.mark.parametrize("n", [2_000, 80_000, 1_000_000, 5_000_000])
def test_recall_does_not_fall_with_the_number_of_vectors(n):
    """Pairs other than those the filters were tuned on, with the width and threshold for n vectors."""
    width, sds, least = caps.tuned(n, 64)
    rng = np.random.default_rng(9)
    x, z = rng.standard_normal((2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.951 * x + (1 - 0.951**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    code = caps.Code(64, width, 20)
    one, two = code.decode(x, sds / 8, least), code.decode(y, sds / 8, least)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two)]) >= 0.97
