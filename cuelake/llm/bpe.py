"""Byte-level BPE by backtracking over an automaton of the vocabulary.

A piece's bytes are read as Latin-1 text, so that an Aho-Corasick automaton finds the longest
token at every position in one pass. The encoder goes forward with that token and steps back to
a shorter one, or to the token before, whenever two neighbours could not stand side by side in
the result of the merges. That test unpicks only the two tokens and is memoised; a position is
given up at most once, so the work is linear in the piece's length (van Antwerpen and Neubeck,
2024). A piece that is itself a token is that token, as in the usual encoders.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.workdir import bounded_batches

#: Pieces, and pairs of tokens, that a task remembers before it starts afresh (about 70 and 40 MB at most); longer pieces are never kept.
MEMO, LONGEST_MEMO = 300_000, 64
PAIR_BITS, NEVER = 24, 1 << 60


def merged(piece: bytes, rank: dict[bytes, int], below: int) -> list[bytes]:
    """The merges in order of rank, carried out one by one; only those of a rank lower than ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def decoded(ids: bytes, token: list[bytes | None]) -> bytes:
    return b"".join(map(token.__getitem__, memoryview(ids).cast("I")))


class Vocabulary:
    """What encoding needs to know of a vocabulary; made on the driver, broadcast, bounded by the vocabulary's size."""

    def __init__(self, content: bytes, pattern: str):
        self.pattern = pattern
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines())}
        self.token: list[bytes | None] = [None] * (max(self.rank.values(), default=-1) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        nothing = array("i", [-1]) * len(self.token)
        #: of each token that merges can reach: the two tokens merged last (a single byte's are itself), and the longest proper prefix that is such a token
        self.left, self.right, self.shorter = nothing[:], nothing[:], nothing[:]
        for t, r in self.rank.items():
            if len(t) == 1:
                self.left[r] = self.right[r] = r
            elif len(parts := merged(t, self.rank, r)) == 2:
                self.left[r], self.right[r] = self.rank[parts[0]], self.rank[parts[1]]
        for t, r in self.rank.items():
            if self.left[r] >= 0:
                self.shorter[r] = next((p for k in range(len(t) - 1, 0, -1) if (p := self.rank.get(t[:k], -1)) >= 0 and self.left[p] >= 0), -1)

    def encoder(self) -> Encoder:
        return Encoder(self)

    def decoded(self, ids: bytes) -> bytes:
        return decoded(ids, self.token)


class Encoder:
    """The automaton of a worker process and the memos of its task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.regex = regex.compile(vocabulary.pattern)
        self.automaton = ahocorasick.Automaton()
        self.left, self.right, self.shorter = vocabulary.left, vocabulary.right, vocabulary.shorter
        self.length = [len(t or b"") for t in vocabulary.token]
        #: rank of what two neighbouring tokens are merged to; a pair is a number
        self.joined: dict[int, int] = {}
        for t, r in vocabulary.rank.items():
            for k in range(1, len(t)):
                a, b = vocabulary.rank.get(t[:k]), vocabulary.rank.get(t[k:])
                if a is not None and b is not None:
                    self.joined[a << PAIR_BITS | b] = r
            if self.left[r] >= 0:
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo = _Memo(self)

    def together(self, a: int, b: int) -> bool:
        """Whether the merges can leave two tokens side by side; undoes the later of the two's merges, again and again."""
        joined, left, right, limit = self.joined.get, self.left, self.right, NEVER
        while True:
            if joined(a << PAIR_BITS | b, limit) < limit:
                return False  # the two would have been merged before one of them was complete
            inner_a, inner_b = right[a], left[b]
            if (a > b or inner_b == b) and inner_a != a:
                a, limit = inner_a, a
            elif inner_b != b:
                b, limit = inner_b, b + 1
            else:
                return True

    def piece(self, piece: bytes) -> list[int]:
        whole = self.v.rank.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(piece), self.length, self.shorter, self.pairs
        if len(pairs) > MEMO:
            pairs.clear()
        longest = [-1] * (n + 1)
        for end, r in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[r]] = r  # ends rise, so the last match of a start is the longest
        out: list[int] = []
        given_up = bytearray(n + 1)
        at, now = 0, longest[0]
        while at < n:
            if now < 0:  # no token fits here: give up this position
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                given_up[at] = 1
                now = out.pop()
                at -= length[now]
                now = shorter[now]
                continue
            end = at + length[now]
            if not given_up[end]:
                if out:
                    pair = out[-1] << PAIR_BITS | now
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.together(out[-1], now)
                else:
                    fits = True
                if fits:
                    out.append(now)
                    at, now = end, longest[end]
                    continue
            now = shorter[now]
        return out

    def forget(self) -> None:
        self.pairs.clear()
        self.memo.clear()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.regex.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return self.v.decoded(ids)


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.piece(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_MEMO:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


#: The encoder of this process; that of another vocabulary is given up.
_KEPT: dict[str, Encoder] = {}


def _worker(name: str, shared) -> Encoder:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = shared.value.encoder()
    return _KEPT[name]


CODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])


class Tokenizer:
    """Encoding and decoding of columns with the vocabulary file at ``path`` (read on the driver)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        bounded_batches(spark)
        with open(path, "rb") as f:
            content = f.read()
        self._share(spark, content + pattern.encode(), Vocabulary(content, pattern))

    def _share(self, spark: SparkSession, known_by: bytes, vocabulary) -> None:
        self.name = hashlib.md5(known_by).hexdigest()
        self.shared = spark.sparkContext.broadcast(vocabulary)

    def code(self, text: str | Column) -> Column:
        """struct(ids, decoded): the ids of a whole text, four little-endian bytes each, and the bytes that they stand for. Null and empty texts have none.

        A task clears the memos at its end, so that a worker that goes on to other work keeps the
        vocabulary and the automaton only, some 35 MB.
        """
        shared, name = self.shared, self.name

        @F.arrow_udf(CODED)
        def code(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _worker(name, shared)
            try:
                for column in columns:
                    ids = [encoder.encode(t.as_py() or "") for t in column]
                    yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(encoder.decode, ids), pa.binary())], ["ids", "decoded"])
            finally:
                encoder.forget()

        return code((F.col(text) if isinstance(text, str) else text).cast("string"))

    def decode(self, ids: str | Column) -> Column:
        """Binary: the bytes that ids stand for; an unknown id is an error. Null has no ids."""
        shared = self.shared

        @F.arrow_udf(T.BinaryType())
        def decode(column: pa.Array) -> pa.Array:
            return pa.array([shared.value.decoded(i.as_py() or b"") for i in column], pa.binary())

        return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each text and the bytes they decode to (columns of these names are replaced).

    Each match of the pattern is encoded by itself and no special token is known, so a text that
    spells one is ordinary text. Null and empty texts get no ids; repeated rows get equal results;
    all other columns stay.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (ids, decoded)]
    coded = docs.select(F.struct(*others).alias("row"), tokenizer.code(F.col(f"`{text}`")).alias("coded"))
    return coded.select("row.*", F.col("coded.ids").alias(ids), F.col("coded.decoded").alias(decoded))
