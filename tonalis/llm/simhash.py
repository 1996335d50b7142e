"""SimHash near-duplicates found through a Gray-order hierarchical index.

A fingerprint bit is set if it is set in over half of a text's shingle hashes.  Documents with
equal fingerprints are one node.  Nodes are sorted by Gray rank and cut into segments of ranks.
Within a segment they are grouped sixteen by sixteen, level upon level; a group keeps the bits
that all its members have set and those that all have unset.  Two groups differ at least in the
bits that one shares as set and the other as unset; this sum grows down the tree, and pairs of
groups beyond the limit are dropped whole.  The segments themselves are the groups above: only
pairs of segments that may hold a link meet in a task, and each pair is walked there from its
top groups down.  Groups whose members are known to be connected aren't compared again.  A task
yields at most one link per node, to the smallest node it is connected with, and the links'
connected components are taken over all tasks.

A text without words (or null) has fingerprint 0 and is linked like any other; a text of fewer
words than a shingle is one shingle; very long texts are hashed block by block.  Repeated rows
keep their multiplicity, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, struct_array
from .components import Union, connected_components
from .runs import per_run, split_hot

FAN = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, shingle_words: int, seed: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in ascending order; the same shingles as in ``fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle_words + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle_words]), seed) for i in range(n)), np.uint64, n))


def fingerprint(text: str, shingle_words: int, seed: int, block: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    for at in range(0, n, block):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : min(n, at + block)].tolist(), last[at : at + block].tolist())], np.uint64)  # noqa: B905
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle_words: int, seed: int = 42) -> Column:
    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x or "", shingle_words, seed) for x in column.to_pylist()], pa.int64())

    return simhash(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchy over codes in Gray order.

    ``ones[k]`` and ``zeros[k]`` hold the bits that all members of a group have set and unset;
    level 0 is the codes themselves, filled up to whole groups with the last one.
    """

    def __init__(self, codes: np.ndarray, height: int = 1):
        order = np.argsort(gray_rank(codes), kind="stable")
        self.order = np.append(order, np.repeat(order[-1:], -len(order) % FAN))
        self.ones, self.zeros, self.sizes = [codes[self.order]], [~codes[self.order]], [len(self.order)]
        while self.sizes[-1] > FAN or len(self.sizes) <= height:
            for table, merge in ((self.ones, np.bitwise_and), (self.zeros, np.bitwise_and)):
                table.append(self._filled(merge.reduceat(table[-1], np.arange(0, self.sizes[-1], FAN))))
            self.sizes.append(-(-self.sizes[-1] // FAN))
        self.height = len(self.sizes) - 1

    @staticmethod
    def _filled(x: np.ndarray) -> np.ndarray:
        return np.append(x, np.repeat(x[-1:], -len(x) % FAN))

    def same(self, label: np.ndarray) -> list[np.ndarray]:
        """For each group of each level its members' label, or -1 if they have several."""
        low = high = label[self.order]
        out = [low]
        for _ in range(self.height):
            at = np.arange(0, len(low), FAN)
            low, high = (self._filled(f.reduceat(x, at)) for f, x in ((np.minimum, low), (np.maximum, high)))
            out.append(np.where(low == high, low, -1))
        return out


def walk(one: GrayIndex, two: GrayIndex, bits: int, union: Union, shift: int = 0, most: int = 1024) -> int:
    """Connect in ``union`` all codes of ``one`` and ``two`` within ``bits`` differing bits.

    The codes of ``two`` have places from ``shift`` on in ``union``; with ``one is two`` each pair of
    groups is met once.  Both need the same height.  Returns the number of pairs compared.
    """
    own = one is two
    visits, same = 0, None
    top = [np.arange(x.sizes[-1], dtype=np.int32) for x in (one, two)]
    a, b = (x.ravel() for x in np.meshgrid(*top, indexing="ij"))
    todo = [(one.height, a[keep], b[keep]) for keep in [a <= b if own else np.ones(len(a), bool)]]
    while todo:
        level, a, b = todo.pop()
        if same is None:
            same = one.same(union.label), (two.same(union.label[shift:]) if not own else None)
        left, right = same[0][level][a], same[own - 1][level][b]
        keep = (left < 0) | (left != right)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level == 0:
            visits += len(a)
            if union.add(one.order[a], two.order[b] + shift):
                same = None
            continue
        below = level - 1
        cut = lambda table, at: table[below].reshape(-1, FAN)[at]  # noqa: B023, E731
        if below:
            differ = np.bitwise_count((cut(one.ones, a)[:, :, None] & cut(two.zeros, b)[:, None, :]) | (cut(one.zeros, a)[:, :, None] & cut(two.ones, b)[:, None, :]))
        else:
            differ = np.bitwise_count(cut(one.ones, a)[:, :, None] ^ cut(two.ones, b)[:, None, :])
        visits += differ.size
        pair, i, j = np.nonzero(differ <= bits)
        a, b = a[pair] * FAN + i.astype(np.int32), b[pair] * FAN + j.astype(np.int32)
        keep = (a < one.sizes[below]) & (b < two.sizes[below])
        if own:
            keep &= a < b if not below else a <= b
        a, b = a[keep], b[keep]
        step = most if below else max(1, len(a))
        todo += [(below, a[at : at + step], b[at : at + step]) for at in range(0, len(a), step)][::-1]
    return visits


def segment_links(code: np.ndarray, node: np.ndarray, side: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), at most one a node, that connect two segments (or one, if ``side`` is all 0) as all their pairs would."""
    order = np.lexsort((node, side))  # a component's smallest place in a segment is its smallest node there
    code, node, side = code[order], node[order], side[order]
    union, cut = Union(len(code)), int(np.searchsorted(side, 1))
    if cut == len(code):
        index = GrayIndex(code)
        walk(index, index, bits, union)
    elif cut:
        height = max(GrayIndex(x).height for x in (code[:cut], code[cut:]))
        walk(GrayIndex(code[:cut], height), GrayIndex(code[cut:], height), bits, union, cut)
    linked = np.flatnonzero(union.label != np.arange(len(code)))
    return node[linked], node[union.label[linked]]


def fingerprint_links(nodes: DataFrame, bits: int, largest: int = 500_000, parts: int = 8) -> DataFrame:
    """Links (a, b) that connect the nodes within ``bits`` differing bits as all such pairs would.

    ``nodes``: distinct ``fp`` with a ``node`` id each.  Segments of Gray ranks have about
    ``largest`` nodes at most, and there are at least ``parts``.  What the driver gathers is two
    patterns a segment.
    """
    ranked = nodes.select("fp", "node", rank_of(F.col("fp")).alias("rank"))
    n = nodes.count()
    parts = max(parts, -(-n // largest))
    edges = np.unique(ranked.approxQuantile("rank", [k / parts for k in range(1, parts)], 0.1 / parts)) if n and parts > 1 else np.zeros(0)

    @F.arrow_udf("int")
    def segment_of(rank: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, rank.to_numpy().astype(float), side="right"), pa.int32())

    cut = materialize(ranked.select("fp", "node", segment_of("rank").alias("segment")), "segments")
    found = cut.groupBy("segment").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")).collect()
    names = np.array([r["segment"] for r in found], np.int64)
    ones, zeros = (np.array([r[c] for r in found], np.int64).view(np.uint64) for c in ("ones", "zeros"))

    def partners(segment: int) -> np.ndarray:
        at = int(np.flatnonzero(names == segment)[0])
        return names[np.bitwise_count((ones[at] & zeros) | (zeros[at] & ones)) <= bits]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("segment").to_numpy()
            for segment in np.unique(mine):
                rows = batch.filter(pa.array(mine == segment))
                for other in partners(segment).tolist():
                    pair = min(segment, other) * (len(edges) + 1) + max(segment, other)
                    yield pa.record_batch([rows.column("fp"), rows.column("node"), pa.array(np.full(len(rows), segment > other, np.int32)), pa.array(np.full(len(rows), pair, np.int64))], names=["fp", "node", "side", "pair"])

    def link(table: pa.Table) -> pa.Table:
        a, b = segment_links(table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy(), table.column("side").to_numpy(), bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut.mapInArrow(deal, "fp long, node long, side int, pair long").groupBy("pair").applyInArrow(link, "a long, b long")


def rank_of(fp: Column) -> Column:
    """Gray rank of a signed code, shifted so that signed order is rank order."""

    @F.arrow_udf("long")
    def rank(column: pa.Array) -> pa.Array:
        return pa.array((gray_rank(column.to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))

    return rank(fp)


def near_duplicates(docs: DataFrame, shingle_words: int = 4, bits: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", **segments: int) -> DataFrame:
    """One row per document: doc_id, fp (signed 64-bit fingerprint), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``bits`` differing
    bits, the document's own included.  Ids must be integers and not null.
    """
    prints = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), shingle_words, seed).alias("fp")), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "fingerprint-nodes")
    parts = connected_components(fingerprint_links(nodes, bits, **segments))
    named = materialize(nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "fingerprint-components")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


#: Bands of rows of minima: of pairs with Jaccard similarity 0.8, all but 1 in 10,000 share a band.
BANDS, ROWS = 24, 5
#: Differing fingerprint bits that similarity 0.8 needs: 9.7 on average with a deviation of 2.9, so five deviations on top.
HEADROOM_BITS = 24


def set_code(hashes: np.ndarray) -> int:
    """A number for a set of shingles, as a signed integer; it names the set as a node."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1) - (1 << 63)


def band_keys(hashes: np.ndarray, seed: int, block: int = 2048) -> list[int]:
    """A key for each band of minima over random permutations of the hashes."""
    rng = np.random.default_rng([seed, BANDS, ROWS])
    mask, factor = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    factor |= np.uint64(1)
    least = np.full(BANDS * ROWS, ALL)
    for at in range(0, len(hashes), block):
        least = np.minimum(least, ((hashes[at : at + block] ^ mask) * factor).min(1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def candidate_pairs(runs: DataFrame, similarity: float, small: int = 32) -> DataFrame:
    """Pairs (a, b) of nodes in a run that may be as similar as asked, by fingerprints and sizes.

    A run of at most ``small`` rows gives all its pairs; a larger one gives neighbours in Gray order.
    """

    def batch(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        code, n, node = table.column("fp").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("node").to_numpy()
        keep = (np.bitwise_count(code[i] ^ code[j]) <= HEADROOM_BITS) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (node[i] != node[j])
        a, b = node[i[keep]], node[j[keep]]
        return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def neighbours(table: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.argsort(gray_rank(table.column("fp").to_numpy().view(np.uint64)), kind="stable")
        for d in range(1, 5):
            yield batch(table, order[:-d], order[d:])

    def many(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [table.num_rows]])))
        first = [np.flatnonzero(run[:-d] == run[d:]) for d in range(1, min(small, len(run)))]
        i = np.concatenate(first)
        return batch(table, i, i + np.repeat(np.arange(1, len(first) + 1), [len(x) for x in first]))

    return per_run(runs.select("run", "fp", "node", "n"), neighbours, "a long, b long", many, small).distinct()


def links_apart(runs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within runs that have a ``set`` and a ``label`` a row, as all similar pairs of different labels would connect them.

    The sets are compared in the task through an index of their hashes, so no pair becomes a row.
    """

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        if not label.max():
            return
        node = table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, name = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(name, kind="stable")
        holders, ends = owner[order], np.cumsum(np.bincount(name))
        own = np.split(name, np.cumsum(size)[:-1])
        union, a, b = Union(len(sets)), [], []
        first = np.unique(label, return_index=True)[1]
        union.add(np.arange(len(sets)), first[label])
        for i in range(len(sets)):
            if (union.label == union.label[i]).all():
                continue
            both = np.zeros(len(sets), np.int64)
            for x in own[i].tolist():
                both[holders[ends[x - 1] if x else 0 : ends[x]]] += 1
            hit = np.flatnonzero((both >= similarity * (size + size[i] - both) - 1e-9) & (union.label != union.label[i]))
            if len(hit):
                hit = hit[np.unique(union.label[hit], return_index=True)[1]]
                union.add(np.full(len(hit), i), hit)
                a += [i] * len(hit)
                b += hit.tolist()
        yield pa.record_batch([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return per_run(runs.select("run", "node", "label", "set"), found, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle_words: int, seed: int) -> DataFrame:
    """``node`` and ``set`` (packed hashes) of the ``wanted`` nodes."""
    ids = nodes.join(wanted, "node").select("doc_id").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):  # a few texts' sets at a time
                got = [shingle_hashes(x or "", shingle_words, seed) for x in b.column(0).slice(at, 128).to_pylist()]
                yield pa.record_batch([pa.array([set_code(h) for h in got], pa.int64()), pa.array([h.tobytes() for h in got], pa.binary())], names=["node", "set"])

    return materialize(docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(sets, "node long, set binary"), "shingle-sets").dropDuplicates(["node"])


def verified(own: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles (``own``) have a Jaccard similarity of at least ``similarity``."""

    @F.arrow_udf("boolean")
    def similar(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one, two, strict=True):  # the sets stay in the column's buffers
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    named = lambda x: own.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return materialize(both.where(similar("set_a", "set_b")).select("a", "b"), "similar")


def similar_documents(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most: int = 1000, small: int = 32) -> DataFrame:
    """One row per document: doc_id, component_id, linked by the Jaccard similarity of their sets of shingles.

    Nodes are distinct sets.  Candidates share a band of minima and are within HEADROOM_BITS
    differing bits of each other's fingerprint; each is verified on the sets themselves.  In runs of
    more than ``small`` nodes, neighbours are verified first, and what these leave in different
    components is compared within the run's task, so that a large group isn't expanded into pairs.
    ``component_id`` is the smallest doc_id of the component.  Ids must be integers and not null.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @F.arrow_udf("struct<node:long,fp:long,n:int,bands:array<long>>")
    def sketch(column: pa.Array) -> pa.Array:
        node, fp, n, bands = [], [], [], []
        for x in column.to_pylist():
            h = shingle_hashes(x or "", shingle_words, seed)
            ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            node.append(set_code(h)), n.append(len(h)), bands.append(band_keys(h, seed))
            fp.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
        return struct_array([("node", pa.array(node, pa.int64())), ("fp", pa.array(fp, pa.int64())), ("n", pa.array(n, pa.int32())), ("bands", pa.array(bands, pa.list_(pa.int64())))])

    prints = materialize(docs.select("doc_id", sketch("text").alias("s")).select("doc_id", "s.*"), "sketches")
    nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sketch-nodes")
    keyed = nodes.select("node", "fp", "n", F.explode("bands").alias("key"))
    runs = materialize(split_hot(keyed, "key", "node", most).select("run", "node", "fp", "n"), "runs")
    pairs = materialize(candidate_pairs(runs, similarity, small=small), "candidates")
    links = verified(sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle_words, seed), pairs, similarity)
    parts = connected_components(links)
    large = runs.groupBy("run").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("run")
    labelled = runs.select("run", "node").join(large, "run", "left_semi").join(parts, "node", "left").withColumn("label", F.coalesce("component", "node"))
    labelled = materialize(labelled.select("run", "node", "label"), "labelled")
    mixed = labelled.groupBy("run").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l < _m").select("run")
    left = materialize(labelled.join(mixed, "run", "left_semi"), "apart")
    if left.limit(1).count():
        sets = sets_of(docs, nodes, left.select("node").distinct(), shingle_words, seed)
        parts = connected_components(links.union(materialize(links_apart(left.join(sets, "node"), similarity), "links-apart")))
    named = materialize(nodes.join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("part")), "sketch-components")
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "node").join(named.select("node", "part").join(least, "part"), "node").select("doc_id", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
