"""Best-fit packing of tokenised documents into sequences by bin completion on lengths.

Documents are cut into pieces only if they are longer than a sequence.  How pieces can be
packed depends on nothing but their lengths, of which there are at most ``capacity``; so the
search runs on the histogram of lengths (at most ``capacity`` numbers, however many documents)
and yields patterns, each with the number of sequences filled that way.

Bin completion: take the largest length left; enumerate the fillings of the rest of its
sequence that no other filling dominates, larger documents first, pruned once the waste can't
get below the best so far; the first incumbent is the best-fit filling.  A filling is applied to
as many sequences as its lengths allow.  Another incumbent for the whole is best-fit decreasing.
Incumbents above the lower bound are improved by branch and bound over whole plans, which tries
``tries`` fillings before it gives up; a plan that meets the bound is optimal.

Pieces get a place within their length (by task, then within the task) and read their sequence
and offset from the patterns.  The tokenised table is written once, so places never change.

A null text counts as empty: its document is the end token alone.  Repeated rows are packed
as often as they come.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import pickle
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, broadcast_file, built_once, materialize, strings

#: Texts for the fast path: Latin with accents and common signs, without the superscripts and fractions that count as numbers.
PLAIN = re.compile("[\t\n\r -~\xa0-±´-¸º»¿-ſ‐-‧‰-›€]*")
#: The split that the fast path repeats, as the file has it and as ``re`` has it for PLAIN texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SELF)}


class WordTokenizer:
    """Packed ids of a tokenizers file, pre-token by pre-token with a memo.

    The fast path repeats the file's own normalisation and split and encodes each distinct
    pre-token once with the library; it is used for files of the known shape and texts of
    characters for which both agree.  All other texts go to the library whole.
    """

    def __init__(self, data: bytes, most: int = 400_000):
        self.t = tokenizers.Tokenizer.from_buffer(data)
        self.model = self.t.model
        self.known = Memo(most, self.token_ids)
        spec = json.loads(data)
        self.split = self._splitter(spec)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]

    @staticmethod
    def _splitter(spec: dict):
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            return None
        cut = pre[0]
        if steps[1]["pattern"] != {"Regex": r"\s+"} or steps[1]["content"] != " " or cut["behavior"] != "Removed" or not cut["invert"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            return None
        return FAST.findall if cut["pattern"] == {"Regex": SPLIT} else None

    def token_ids(self, pre_token: str) -> bytes:
        """Ids of one pre-token by the file's model alone."""
        if not (pre_token.isascii() and pre_token.isprintable()):
            pre_token = "".join(map(ALPHABET.__getitem__, pre_token.encode()))
        ids = [x.id for x in self.model.tokenize(pre_token)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def library(self, text: str) -> bytes:
        ids = self.t.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        if self.split is None or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.library(text)
        # white space only parts pre-tokens, so it need not be replaced first
        return b"".join(map(self.known.__getitem__, self.split(unicodedata.normalize("NFC", text).lower())))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces: doc_id, piece, start, length, ids_crc32, task, place.

    ``place`` counts pieces of the same length within the task.
    """
    data = broadcast_file(docs.sparkSession, tokenizer_path)
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = data.value
        t = built_once(("words", hashlib.sha1(raw).digest()), lambda: WordTokenizer(raw))
        task, places = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = t.encode_packed(text) + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), task, int(places[length])))
                    places[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


Pattern = tuple[dict[int, int], int]  # lengths with how often each occurs in a sequence, and the number of sequences


def complete(rest: int, lengths: list[int], left: dict[int, int], mixed: bool = True, tries: int = 2000) -> dict[int, int]:
    """The undominated filling of ``rest`` with the least waste found within ``tries`` nodes.

    ``lengths``: ascending lengths that are left.  The search goes by descending length, takes
    as many of a length as fit first and then, if ``mixed``, fewer, and stops at no waste.  A filling that could take another
    document is dominated by the one that does, so only maximal fillings are compared.
    """
    best: tuple[int, dict[int, int]] = (rest, {})
    nodes = 0
    chosen: dict[int, int] = {}

    def search(rest: int, at: int) -> bool:
        """Lengths up to index ``at`` may be used; True once there is no waste or no try left."""
        nonlocal best, nodes
        at = min(at, bisect.bisect_right(lengths, rest) - 1)
        if rest < best[0]:
            best = (rest, {k: v for k, v in chosen.items() if v})
        if not rest or nodes >= tries:
            return True
        while at >= 0:
            length = lengths[at]
            nodes += 1
            most = min(left[length] - chosen.get(length, 0), rest // length)
            if most > 0:
                # an exact partner first: two documents that fill the rest
                for n in range(most, 0, -1):
                    chosen[length] = chosen.get(length, 0) + n
                    done = search(rest - n * length, at - 1)
                    chosen[length] -= n
                    if done or nodes >= tries:
                        return True
                    if not mixed:
                        break
            at -= 1
        return False

    search(rest, len(lengths) - 1)
    return best[1]


def completion_plan(histogram: dict[int, int], capacity: int, mixed: bool = True) -> list[Pattern]:
    left = {k: v for k, v in histogram.items() if v}
    lengths = sorted(left)
    out: list[Pattern] = []
    while lengths:
        largest = lengths[-1]
        left[largest] -= 1
        fill = complete(capacity - largest, [x for x in lengths if left[x]] if not left[largest] else lengths, left, mixed)
        left[largest] += 1
        pattern = dict(fill)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del lengths[bisect.bisect_left(lengths, k)]
        out.append((pattern, times))
    return out


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: equal sequences are kept as one pattern with a count."""
    rooms: dict[int, list[list]] = {}  # room -> [pattern, count]
    order: list[int] = []
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                full, rest = divmod(todo, each)
                for n, count in ((each, full), (rest, 1)):
                    if n and count:
                        room = capacity - n * length
                        if room not in rooms:
                            bisect.insort(order, room)
                        rooms.setdefault(room, []).append([{length: n}, count])
                break
            room = order[at]
            group = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            pattern, count = group
            fit = room // length
            used = min(count, max(1, todo // fit))
            n = min(fit, todo)
            if used < count:
                if room not in rooms:
                    bisect.insort(order, room)
                rooms.setdefault(room, []).append([pattern, count - used])
            new = dict(pattern)
            new[length] = new.get(length, 0) + n
            todo -= n * used
            spare = room - n * length
            if spare not in rooms:
                bisect.insort(order, spare)
            rooms.setdefault(spare, []).append([new, used])
    return [(pattern, count) for groups in rooms.values() for pattern, count in groups]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without (Martello and Toth): for each limit, pieces with a
    room too small for any piece from the limit on stand alone, and the rest fills the others' rooms."""
    lengths = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    if not len(lengths):
        return 0
    tokens, best = int(lengths @ n), 0
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    below = lambda x, side="left": int(np.searchsorted(lengths, x, side))
    half = below(capacity / 2, "right")  # from here on longer than half a sequence
    for limit in [0, *lengths[:half].tolist()]:
        alone, low = below(capacity - limit, "right"), below(limit)
        big = int(count[-1] - count[half])
        rooms = (alone - half) and capacity * int(count[alone] - count[half]) - int(total[alone] - total[half])
        rest = int(total[half] - total[low]) - max(0, rooms)
        best = max(best, big + max(0, -(-rest // capacity)))
    return max(best, -(-tokens // capacity))


def exact_plan(histogram: dict[int, int], capacity: int, most: int, tries: int = 100_000) -> list[Pattern] | None:
    """Branch and bound over whole plans: one of fewer than ``most`` sequences, or None.

    The largest length left opens each sequence.  Its undominated fillings are enumerated on the
    histogram, least waste first, as many sequences at once as the lengths allow and then fewer;
    a branch ends once its waste exceeds what fewer sequences allow, and the search after
    ``tries`` fillings.
    """
    lengths = sorted(histogram, reverse=True)
    left = [histogram[k] for k in lengths]
    allowed = (most - 1) * capacity - sum(k * v for k, v in histogram.items())
    nodes = 0

    def fillings(rest: int, at: int, spare: int) -> Iterator[list[tuple[int, int]]]:
        """Fillings by lengths from index ``at`` on with a waste of at most ``spare``."""
        nonlocal nodes
        none = True
        for i in range(at, len(lengths)):
            if not left[i] or lengths[i] > rest:
                continue
            none = False
            for n in range(min(left[i], rest // lengths[i]), 0, -1):
                nodes += 1
                if nodes > tries:
                    return
                for more in fillings(rest - n * lengths[i], i + 1, spare):
                    yield [(i, n), *more]
        if none and rest <= spare:
            yield []

    def dominated(fill: list[tuple[int, int]], waste: int) -> bool:
        """Whether another document would fit."""
        used = dict(fill)
        low = bisect.bisect_left(lengths, -waste, key=lambda x: -x)
        return any(left[i] > used.get(i, 0) for i in range(low, len(lengths)))

    plan: list[Pattern] = []
    # a stack of its own, as plans are deeper than Python's recursion
    stack: list[tuple] = []

    def options(waste: int):
        top = next((i for i, v in enumerate(left) if v), None)
        if top is None:
            return None
        left[top] -= 1
        spare = allowed - waste
        found = []
        for f in fillings(capacity - lengths[top], top, spare):
            w = capacity - lengths[top] - sum(n * lengths[i] for i, n in f)
            if not dominated(f, w):
                found.append((w, [(top, 1 + f[0][1]), *f[1:]] if f and f[0][0] == top else [(top, 1), *f]))
        left[top] += 1
        found = [f for _, f in sorted(found, key=lambda x: x[0])]
        return iter([(f, t) for f in found for t in {min(left[i] // n for i, n in f), 1} if t > 0])

    if allowed < 0:
        return None
    waste, now = 0, options(0)
    while now is not None and nodes <= tries:
        step = next(now, None)
        if step is None:
            if not stack:
                return None
            now, fill, times, waste = stack.pop()
            for i, n in fill:
                left[i] += n * times
            plan.pop()
            continue
        fill, times = step
        spare = capacity - sum(n * lengths[i] for i, n in fill)
        if spare:
            times = min(times, (allowed - waste) // spare)
        if times <= 0:
            continue
        stack.append((now, fill, times, waste))
        for i, n in fill:
            left[i] -= n * times
        plan.append(({lengths[i]: n for i, n in fill}, times))
        waste += spare * times
        now = options(waste)
    return plan if now is None else None


def plan(histogram: dict[int, int], capacity: int, **limits: int) -> list[Pattern]:
    """The patterns for a histogram of lengths: the better incumbent, improved by branch and bound until
    the lower bound is met or its ``tries`` end."""
    bound = lower_bound(histogram, capacity)
    count = lambda p: sum(n for _, n in p)
    best = min((best_fit_plan(histogram, capacity), completion_plan(histogram, capacity, mixed=False)), key=count)
    if bound < count(best):
        best = min((best, completion_plan(histogram, capacity)), key=count)
    while bound < count(best) and (better := exact_plan({k: v for k, v in histogram.items() if v}, capacity, count(best), **limits)) is not None:
        best = better
    return best


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length rows (first place, pieces a sequence, first sequence, offset), by place."""
    table: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            table.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    table = materialize(pieces(docs, tokenizer_path, capacity, end_id, **columns), "pieces")
    # where a task's pieces of a length begin among all of that length: at most capacity rows a task
    own = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(own.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "places")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(pickle.dumps(slots(plan(histogram, capacity))))

    def assign(pieces: pa.Table, places: pa.Table) -> pa.Table:
        """The pieces of one task, with the places where its lengths begin."""
        by_length = pickle.loads(sent.value)
        first = np.zeros(capacity + 1, np.int64)
        first[places.column("length").to_numpy()] = places.column("first").to_numpy()
        length = pieces.column("length").to_numpy()
        rank = first[length] + pieces.column("place").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for value in np.unique(length):
            at = np.flatnonzero(length == value)
            rows = by_length[int(value)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            copy, which = np.divmod(rank[at] - row[:, 0], row[:, 1])
            sequence[at], offset[at] = row[:, 2] + copy, row[:, 3] + which * value
        return pieces.drop_columns(["task", "place"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # both sides have as many rows a key as a task has pieces, which its share of the texts bounds
    return table.groupBy("task").cogroup(offsets.select("task", "length", "first").groupBy("task")).applyInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
