"""Token counts of a SentencePiece BPE model without materialising ids.

The model's text has a space before it and spaces turned into a mark that only starts
pieces; so no piece spans the border between another character and a space.  Line feeds
are in no piece either.  Both borders cut a text into pre-tokens whose pieces do not
depend on their surroundings.

A document's count is the sum of its pre-token frequencies times the pre-tokens' own counts.  The
``head``, a bounded number of frequent pre-tokens, is counted once, sent to all tasks and joined to
a document's frequencies where its text is read.  The frequencies of every other pre-token are
shuffled by pre-token and sorted; each distinct one is counted once where its run begins, joined
to the rows of the run, and the products are summed by document.  What is frequent in the corpus
is in the head, so the shuffle has no hot key; which pre-tokens the head has changes no result.

Null text counts as empty and has no tokens; repeated rows are counted each; very long texts and
pre-tokens are taken whole; an empty table gives no rows.  Models whose pieces could cross a
border (or that rewrite their text) are counted by encoding whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, broadcast_file, built_once, materialize, strings

MARK = "▁"
#: A run of spaces with what follows, or a line feed with what follows.
PRE_TOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")


class PieceCounter:
    def __init__(self, data: bytes, most: int = 400_000):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not m.is_byte(i)]
        # the splits hold if no piece has a mark after another character or a line feed, and texts are taken as they are
        probe = "a  b　ﬁ\tc \n d "
        self.splits = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces) and self._as_is(probe)
        self.counts = Memo(most, self._count)

    def _as_is(self, probe: str) -> bool:
        m = self.model
        whole = len(m.encode(probe))
        parts = sum(self._count(p) for p in PRE_TOKEN.findall(" " + probe))
        return m.decode(m.encode(probe)) == probe and whole == parts

    def _count(self, pre: str) -> int:
        """Pieces of one pre-token; ``encode`` puts a space before the text, so one is taken off."""
        if pre[0] == "\n":
            return len(self.model.encode(pre, num_threads=1)) - 1  # the added space is a piece of its own before a line feed
        return len(self.model.encode(pre[1:], num_threads=1)) if len(pre) > 1 else 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text, num_threads=1))
        counts = self.counts
        return sum(n * counts[pre] for pre, n in frequencies(text).items())


def frequencies(text: str) -> Counter:
    """A text's pre-tokens; the mark itself is a space to the model."""
    return Counter(PRE_TOKEN.findall(" " + text.replace(MARK, " "))) if text else Counter()


def counter(spark: SparkSession, model_path: str):
    """Column function: text -> number of tokens (long); null counts as empty."""
    model = broadcast_file(spark, model_path)

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        c = piece_counter(model.value)
        return pa.array([c.count(x) for x in strings(text)], pa.int64())

    return count


def head_table(texts: DataFrame, model, head: int, head_chars: int) -> dict[str, int]:
    """Counts of at most ``head`` pre-tokens, those found most often of what recurs within the tasks' texts.

    A pre-token left out that way occurs at most once a task or less often than the head's.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                seen.update(PRE_TOKEN.findall(" " + text.replace(MARK, " ")) if text else ())
                if len(seen) > 2 * head:
                    seen = Counter(dict(seen.most_common(head)))
        found = [(x, n) for x, n in seen.most_common(head) if n > 1 and len(x) <= head_chars]
        yield pa.record_batch([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["pre", "n"])

    @F.arrow_udf("long")
    def pieces(pre: pa.Array) -> pa.Array:
        c = piece_counter(model.value)
        return pa.array([c._count(x) for x in pre.to_pylist()], pa.int64())

    frequent = materialize(texts.select("text").mapInArrow(gather, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n")), "frequent")
    # the least frequency of which the head has room for all; frequencies above it are few
    least, room = None, head
    for r in frequent.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).count().orderBy(F.desc("n")).toLocalIterator():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    known = frequent.where(F.col("n") >= least if least is not None else F.lit(False)).select("pre", pieces("pre").alias("pieces")).toArrow()
    return dict(zip(known.column("pre").to_pylist(), known.column("pieces").to_pylist(), strict=True))


def sum_runs(batches: Iterator[pa.RecordBatch], count: Callable[[str], int]) -> Iterator[pa.RecordBatch]:
    """Token numbers by row of rows sorted by ``pre``, each distinct pre-token counted once.

    A row has ``times`` of a pre-token; rows whose ``pre`` is null go on as they are.
    """
    last, pieces = None, 0
    for batch in batches:
        whole = batch.filter(pa.compute.is_null(batch.column("pre")))
        if whole.num_rows:
            yield whole.select(["row", "doc_id", "n_bytes", "n"])
        batch = batch.filter(pa.compute.is_valid(batch.column("pre")))
        if not batch.num_rows:
            continue
        coded = batch.column("pre").dictionary_encode()
        own = []
        for pre in coded.dictionary.to_pylist():
            if pre != last:
                last, pieces = pre, count(pre)
            own.append(pieces)
        rows, at = np.unique(batch.column("row").to_numpy(), return_inverse=True)
        n = np.zeros(len(rows), np.int64)
        np.add.at(n, at, np.array(own, np.int64)[coded.indices.to_numpy()] * batch.column("n").to_numpy())
        yield pa.record_batch([pa.array(rows), *(pa.nulls(len(rows), batch.schema.field(c).type) for c in ("doc_id", "n_bytes")), pa.array(n)], names=["row", "doc_id", "n_bytes", "n"])


def piece_counter(data: bytes) -> PieceCounter:
    return built_once(("pieces", hashlib.sha1(data).digest()), lambda: PieceCounter(data))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", head: int = 200_000, head_chars: int = 64) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).

    ``head``: pre-tokens of at most ``head_chars`` characters that are sent to all tasks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    model = broadcast_file(spark, model_path)
    if not PieceCounter(model.value).splits:
        counted = texts.select("doc_id", "n_bytes", counter(spark, model_path)("text").alias("n_tokens"))
        return counted.withColumn("over_limit", F.col("n_tokens") > limit)
    sent = spark.sparkContext.broadcast(head_table(texts, model, head, head_chars))

    def join_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with its tokens of the head, and one for each other pre-token that it has, with its frequency."""
        get, row = sent.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            n, pre, owner, times = [], [], [], []
            for i, text in enumerate(strings(batch.column("text")), row):
                total = 0
                for x, k in frequencies(text).items():
                    if (c := get(x)) is None:
                        pre.append(x), owner.append(i), times.append(k)
                    else:
                        total += c * k
                n.append(total)
            more = len(pre)
            rows = pa.array(np.concatenate([np.arange(row, row + len(n)), np.array(owner, np.int64)]))
            doc, size = (pa.concat_arrays([batch.column(c), pa.nulls(more, batch.schema.field(c).type)]) for c in ("doc_id", "n_bytes"))
            yield pa.record_batch([rows, doc, size, pa.array(n + times, pa.int64()), pa.array([None] * len(n) + pre, pa.string())], names=["row", "doc_id", "n_bytes", "n", "pre"])
            row += len(n)

    kind = texts.schema["doc_id"].dataType.simpleString()
    joined = texts.mapInArrow(join_head, f"row long, doc_id {kind}, n_bytes long, n long, pre string")
    dealt = joined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.coalesce("pre", F.col("row").cast("string"))).sortWithinPartitions("pre")
    parts = dealt.mapInArrow(lambda batches: sum_runs(batches, piece_counter(model.value)._count), f"row long, doc_id {kind}, n_bytes long, n long")
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
