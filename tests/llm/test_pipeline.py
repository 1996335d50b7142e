"""The pipeline's stages: their decisions take effect, and other columns and rows survive."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonalis.llm import common, simhash
from tonalis.llm.common import crc_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, row string, verdict string, id string"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(6)
    words = {g: ["".join(rng.choices(s, k=3)) for _ in range(200)] for g, s in {"aa": ["ba", "ko", "lu", "mi"], "bb": ["sch", "en", "ung", "tra"]}.items()}
    rows = [(i, " ".join(rng.choices(words[g], k=60)) + (" vile nasty horrid" * 2 if i % 6 == 0 else ""), g) for i, g in enumerate(rng.choices(["aa", "bb"], k=240))]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    clean = [r for r in rows if r[0] % 6]
    copies = [(1000 + i, clean[0][1], None) for i in range(5)]
    odd = [(2000, None, None), (2001, "", None), (2002, "42 !", None), (None, clean[1][1], None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, g, None, None, "kept", "clash", "clash", "clash") for i, t, g in rows + copies + odd], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, clean


def test_stages(spark, world):
    folder, clean = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name == "language_id":
            assert not {2000, 2001, 2002} & set(ids) and len(ids) == docs.count() - 3
        if name == "toxicity":
            assert not [i for i in ids if i is not None and i < 1000 and i % 6 == 0] and len([i for i in ids if i is not None and i < 1000]) == len(clean)
        if name == "simhash_dedup":
            assert not [i for i in ids if i is not None and i >= 1000] and clean[0][0] in ids and None in ids
        assert kept.where(F.col("extra") != "kept").count() == 0
        docs = kept
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.collect()} == set(ids)


def test_empty_tables(spark, world, tmp_path):
    folder, _ = world
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_limit_comes_from_every_training_document(spark):
    """Unusual documents that training holds stay, though none is among the first 4000 by hash of the id."""
    rng = random.Random(15)
    plain = {"aa": ["ba", "ko", "lu", "mi"], "bb": ["sch", "en", "ung", "tra"]}
    ids = [r["id"] for r in spark.range(6400).where(crc_fold(F.col("id")) != 2).orderBy(F.xxhash64("id"), "id").limit(4400).collect()]
    assert len(ids) == 4400
    rows = [(i, " ".join("".join(rng.choices(plain[g], k=2)) for _ in range(6)), g) for i, g in zip(ids[:4000], rng.choices(list(plain), k=4000))]
    rows += [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)), "aa") for i in ids[4000:]]
    docs = spark.createDataFrame([*rows, (9000, "42 !", None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept == set(ids)


def test_language_models_come_from_every_document(spark):
    """A language stays if all its documents are in the quarter that op7 holds out; unlike texts without a language go."""
    rng = random.Random(16)
    fold = {r["id"]: r["fold"] for r in spark.range(400).select("id", crc_fold(F.col("id")).alias("fold")).collect()}
    parts = {"aa": ["ba", "ko", "lu", "mi"], "bb": ["sch", "en", "ung", "tra"], "cc": ["λο", "γη", "ται", "μεν"]}
    rows = [(i, g, " ".join("".join(rng.choices(parts[g], k=3)) for _ in range(20))) for i, f in fold.items() for g in ["cc" if f == 2 else rng.choice(["aa", "bb"])]]
    assert {g for _, g, _ in rows} == set(parts)
    odd = [(9000, None, "42 !"), (9001, None, "это другой язык и его никто не учил")]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows + odd, "doc_id long, lang string, text string"), "").select("doc_id").collect()}
    assert kept == set(fold)


def jaccard(one: str, two: str) -> float:
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (one.split(), two.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("small", [32, 2])
def test_near_copies_from_similarity_0_8_on_go(spark, small):
    """Planted copies of similarity 0.8 to 0.95 are linked, less similar ones aren't."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    for i in range(240):
        base = rng.choices(vocabulary, k=rng.choice([40, 150, 600]))
        copy, aim = list(base), (0.7, 0.8, 0.85, 0.9, 0.95)[i % 5]
        for k in rng.sample(range(len(base)), len(base)):
            once = [*copy[:k], "other", *copy[k + 1 :]]
            if jaccard(" ".join(base), " ".join(once)) >= aim:
                copy = once
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want[2 * i + 1] = 2 * i if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else 2 * i + 1
    hub = rng.choices(vocabulary, k=300)  # a large group of near copies, each with a word changed
    group = [(1000 + k, " ".join([*hub[:k], "odd", *hub[k + 1 :]])) for k in range(60)]
    docs = spark.createDataFrame(rows + group + [(2000, None), (2001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, small=small).collect()}
    assert {k: got[k] for k in want} == want
    assert {got[k] for k, _ in group} == {1000} and got[2001] == got[2000] == 2000
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()} if small == 32 else None
    assert kept is None or kept == {k for k, v in got.items() if k == v}


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_bound_the_bytes_of_a_batch(spark, world):
    """What a stage sends to Python workers comes in batches of at most 4 MB, or less if the session asks for it."""
    folder, _ = world
    texts = spark.range(0, 4000, 1, 1).select(F.col("id"), F.repeat(F.lit("word "), 600).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    try:
        for asked, most in [(None, 4 << 20), ("1m", 1 << 20)]:
            for _, stage in corpus_pipeline.STAGES if asked is None else corpus_pipeline.STAGES[-1:]:
                spark.conf.set(BATCH, asked or "64m")
                stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(20), folder)
                found = [(r["n"], r["bytes"]) for r in texts.mapInArrow(sizes, "n long, bytes long").collect()]
                assert sum(n for n, _ in found) == 4000 and max(x for _, x in found) < 1.1 * most
    finally:
        spark.conf.unset(BATCH)


def test_rows_do_not_depend_on_batches(spark, world):
    """The pipeline returns the same rows if nearly every row is a batch of its own."""
    folder, _ = world
    try:
        spark.conf.unset(BATCH)
        want = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str)
        spark.conf.set(BATCH, "1k")
        assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str) == want
    finally:
        spark.conf.unset(BATCH)


def test_a_worker_keeps_one_built_object():
    """A stage's model doesn't stay in a worker beside the next one's."""
    kept = dict(common._BUILT)
    try:
        made = [common.built_once(("test", i), lambda i=i: [i]) for i in (0, 1, 1)]
        assert made == [[0], [1], [1]] and made[1] is made[2] and list(common._BUILT) == [("test", 1)]
    finally:
        common._BUILT.clear()
        common._BUILT.update(kept)
