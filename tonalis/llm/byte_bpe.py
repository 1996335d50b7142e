"""Byte-level BPE encoding and decoding without a merge loop over the text.

Every match of the split pattern is encoded on its own.  Its UTF-8 bytes, seen as Latin-1
characters, run once through an Aho-Corasick automaton of the vocabulary, which gives the
longest token at each byte.  A left-to-right walk takes the longest token that may follow
the previous one, falls back to shorter prefixes and backtracks over dead ends; a bit per
byte keeps dead ends from being tried twice, so that the walk is linear in the bytes.  Two
tokens may stand side by side if merging their joint bytes gives back exactly these two;
that answer is memoised per pair.

Null text counts as empty and gives no ids.  Rows keep their multiplicity.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, broadcast_file, built_once, strings, struct_array

UNREACHED = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class ByteBpe:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 300_000, most_pairs: int = 1_000_000):
        self.ranks = ranks
        self.vocab = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for rank, token in self.vocab.items()}
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.prefix: dict[int, int | None] = {}
        self.pairs = Memo(most_pairs, self._pair)
        self.pieces = Memo(most_pieces, self._piece)

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by lowest rank, leftmost first; only for two tokens' worth of bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = UNREACHED, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], UNREACHED)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _pair(self, key: tuple[int, int]) -> bool:
        """Whether two tokens may stand side by side."""
        return self.merged(self.vocab[key[0]] + self.vocab[key[1]]) == [*key]

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def shorter(self, token: int) -> int | None:
        """The longest other token that this token starts with."""
        if token not in self.prefix:
            data = self.vocab[token]
            self.prefix[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)
        return self.prefix[token]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        size, n = self.size, len(data)
        longest: list[int | None] = [None] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends only grow: the longest comes last
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None and not (alive[at + size[token]] and (last is None or self.pairs[last, token])):
                token = self.shorter(token)
            if token is not None:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else None
            elif last is None:
                return self.merged(data)  # a vocabulary without all single bytes' merges
            else:
                alive[at] = 0
                out.pop()
                at -= size[last]
                token = last
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


def codec(data: bytes, pattern: str) -> ByteBpe:
    return built_once(("byte-bpe", hashlib.sha1(data).digest(), pattern), lambda: ByteBpe(read_ranks(data), pattern))


def encoder(spark: SparkSession, ranks_path: str, pattern: str, decode: bool = False):
    """Column function: text -> struct(ids binary[, decoded binary]); null counts as empty.

    ``ids`` holds little-endian unsigned 32-bit integers.  With ``decode`` the ids are turned
    back into bytes in the same pass.
    """
    ranks = broadcast_file(spark, ranks_path)

    @F.arrow_udf("struct<ids:binary,decoded:binary>" if decode else "struct<ids:binary>")
    def encode(text: pa.Array) -> pa.Array:
        bpe = codec(ranks.value, pattern)
        ids = [bpe.encode_packed(x) for x in strings(text)]
        out = [("ids", pa.array(ids, pa.binary()))]
        if decode:
            out.append(("decoded", pa.array(map(bpe.decode_packed, ids), pa.binary())))
        return struct_array(out)

    return encode


def decoder(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function: packed ids -> bytes; null gives empty bytes."""
    ranks = broadcast_file(spark, ranks_path)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = codec(ranks.value, pattern)
        return pa.array([bpe.decode_packed(x or b"") for x in ids.to_pylist()], pa.binary())

    return decode


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str | Column = "text", decode: bool = False) -> DataFrame:
    """One row per document: its id, ``n_tokens``, packed ``ids`` and, if asked for, ``decoded`` bytes.

    Other columns of ``docs`` are left out.  No shuffle: one pass over the texts.
    """
    encode = encoder(docs.sparkSession, ranks_path, pattern, decode)
    out = docs.select(F.col(id_col).alias("doc_id"), encode(F.col(text) if isinstance(text, str) else text).alias("bpe"))
    columns = ["doc_id", (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"), F.col("bpe.ids").alias("ids")]
    return out.select(*columns, *([F.col("bpe.decoded").alias("decoded")] if decode else []))
