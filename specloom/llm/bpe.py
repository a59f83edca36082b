"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over characters can hold
byte strings; it follows a piece from any position as far as some token goes, which gives the longest
token that begins there. Encoding walks the piece from the left, takes the longest token that may stand after its predecessor, falls back to that token's next
shorter prefix, and steps back over a predecessor when no token fits. "May stand after" is a
property of two adjacent tokens (would the merges have joined across their border before each was
complete?) and is memoised, so a piece costs time linear in its bytes and equals the merges exactly.

Defined results: a null text counts as empty and has no ids; null ids decode to the empty string;
ids outside the vocabulary raise ``ValueError``; repeated rows are encoded independently; an empty
table gives an empty table with the same columns; other columns pass through, and an existing column
with the output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import slices

#: Strings up to CACHE_CHARS are kept in a worker's caches, each of two generations of at most so many.
CACHE_CHARS, CACHED_CHUNKS, CACHED_PIECES, CACHED_PAIRS = 48, 160_000, 60_000, 250_000
#: Fixed value: the public pattern for which a text may be cut before any space that a non-space follows.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of ``base64-token rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _pack(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


class Recent:
    """A bounded cache: what was used since the last turnover survives it."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) > CACHE_CHARS:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """Encoder and decoder for one rank table; ranks are the ids, and tables are lists by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if {bytes([b]) for b in range(256)} - ranks.keys():
            raise ValueError("a byte-level vocabulary holds all 256 bytes")
        self.ranks, self.split, self.size = ranks, regex.compile(pattern), max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = [len(token or b"") for token in self.bytes_of]
        #: The two tokens whose merge made a token, -1 for a byte; and the other way round.
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.merged: dict[int, int] = {}
        self._learn_merges()
        self.memo: dict[int, bool] = {}
        self.reach = max(self.lengths)
        #: All beginnings of tokens with the longest token that each begins with, -1 for none; and the
        #: longest shorter token that begins a token.
        self.paths, self.shorter = ahocorasick.Automaton(), [-1] * self.size
        for rank in sorted(filter(self._made, ranks.values()), key=self.lengths.__getitem__):
            token = self.bytes_of[rank].decode("latin-1")
            best = -1
            for n in range(1, len(token)):
                known = self.paths.get(token[:n], None)
                if known is None:
                    self.paths.add_word(token[:n], best)
                else:
                    best = known
            self.shorter[rank] = best
            self.paths.add_word(token, rank)
        self.paths.make_automaton()
        self.pieces, self.chunks, self.spaced = Recent(CACHED_PIECES), Recent(CACHED_CHUNKS), pattern == SPACED_PATTERN

    def _made(self, rank: int) -> bool:
        return self.left[rank] >= 0 or self.lengths[rank] == 1

    def _learn_merges(self) -> None:
        """In rank order: the split of a token whose halves are complete earlier and stay apart until then.

        A token without such a split never arises from merges; it is an id only of a piece that
        equals it.
        """
        for rank, token in enumerate(self.bytes_of):
            for n in range(len(token or b"") - 1, 0, -1):
                left, right = self.ranks.get(token[:n]), self.ranks.get(token[n:])
                if left is None or right is None or max(left, right) >= rank or not (self._made(left) and self._made(right)):
                    continue
                if self._apart(left, right):
                    self.left[rank], self.right[rank], self.merged[left * self.size + right] = left, right, rank
                    break

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undo the later of the two tokens' merges step by step. At each step the parts that touch at
        the border must not make a pair that the merges would have taken before the step undone last.
        """
        before = float("inf")
        while True:
            joined = self.merged.get(left * self.size + right)
            if joined is not None and joined < before:
                return False
            undo_left = left > right
            for _ in range(2):
                rank = left if undo_left else right
                if self.left[rank] >= 0:
                    break
                undo_left = not undo_left
            else:
                return True
            # Of equal pairs the merges take the leftmost first, so a pair that joins at the same
            # rank as the right token's own merge would have come first.
            before = rank if undo_left else rank + 1
            if undo_left:
                left = self.right[rank]
            else:
                right = self.left[rank]

    def fits(self, left: int, right: int) -> bool:
        pair = left * self.size + right
        known = self.memo.get(pair)
        if known is None:
            if len(self.memo) > CACHED_PAIRS:
                self.memo.clear()
            known = self.memo[pair] = self._apart(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")
        known, best, path = self.memo.get, self.paths.get, self.paths.longest_prefix
        lengths, shorter, reach, size, n = self.lengths, self.shorter, self.reach, len(latin), self.size
        ids: list[int] = []
        dead: set[int] = set()
        last, at, ahead = -1, 0, latin[:reach]
        token = best(ahead[: path(ahead)])
        while True:
            end = at + lengths[token]
            if end not in dead:
                fits = last < 0 or known(last * n + token)
                if fits is None:
                    fits = self.fits(last, token)
                if fits:
                    ids.append(token)
                    if end == size:
                        return ids
                    last, at, ahead = token, end, latin[end : end + reach]
                    token = best(ahead[: path(ahead)])
                    continue
            token = shorter[token]
            while token < 0:
                # Nothing fits here: the predecessor was too long.
                dead.add(at)
                token = ids.pop()
                at -= lengths[token]
                last = ids[-1] if ids else -1
                token = shorter[token]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.spaced:
            return self._split_and_encode(text)
        chunks = text.split(" ")
        out = list(map(self.chunks.young.get, chunks))
        # The first chunk has no space before it; the cached ones have.
        out[0] = self._split_and_encode(chunks[0])
        if None in out:
            recent, put = self.chunks.get, self.chunks.put
            for i, packed in enumerate(out):
                if packed is None:
                    chunk = chunks[i]
                    packed = recent(chunk)
                    if packed is None:
                        if chunk.isascii() and chunk.isalpha():
                            packed = _pack(self.encode_piece(b" " + chunk.encode()))
                        elif not chunk or chunk[0].isspace():
                            return self._split_and_encode(text)
                        else:
                            packed = self._split_and_encode(" " + chunk)
                        put(chunk, packed)
                    out[i] = packed
        return b"".join(out)

    def _split_and_encode(self, text: str) -> bytes:
        young, out = self.pieces.young.get, []
        for piece in self.split.findall(text):
            packed = young(piece) or self.pieces.get(piece)
            if packed is None:
                ids = self.encode_piece(piece.encode())
                packed = _pack(ids)
                self.pieces.put(piece, packed)
                young = self.pieces.young.get
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return decode(self.bytes_of, ids)


def decode(bytes_of: list[bytes | None], ids: Iterable[int]) -> bytes:
    """The bytes of the ids, one after another; ``ValueError`` for an id that isn't there."""
    ids = list(ids)
    try:
        if ids and min(ids) < 0:
            raise IndexError(min(ids))
        return b"".join(map(bytes_of.__getitem__, ids))
    except (IndexError, TypeError) as missing:
        raise ValueError(f"ids outside the vocabulary: {missing}") from None


def _by_slices(values: pa.Array, f: Callable[[pa.Array], pa.Array], rows: int = 500) -> pa.Array:
    """A function's results over a batch, a few hundred rows at a time: what it holds besides stays small."""
    return pa.concat_arrays([f(values.slice(a, rows)) for a in range(0, max(1, len(values)), rows)])


def _rows(ids: pa.Array) -> Iterable[np.ndarray]:
    """The ids of each row; none for a null row."""
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])
    return (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _ranks(table: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in table.splitlines() if x.strip())}


@functools.lru_cache(maxsize=1)
def _encoder(table: bytes, pattern: str) -> Bpe:
    """One encoder per worker process and vocabulary."""
    return Bpe(_ranks(table), pattern)


@functools.lru_cache(maxsize=1)
def _tokens(table: bytes) -> list[bytes | None]:
    """All that decoding needs, once per worker process."""
    ranks = _ranks(table)
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Tokenizer:
    """The coder as DataFrame columns. The vocabulary file is read on the driver and broadcast; its
    size is fixed and checked against ``max_vocabulary_bytes``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, max_vocabulary_bytes: int = 64 << 20):
        with open(path, "rb") as f:
            table = f.read()
        if len(table) > max_vocabulary_bytes:
            raise ValueError(f"vocabulary of {len(table)} bytes exceeds {max_vocabulary_bytes}")
        shared, self.table, self.pattern = spark.sparkContext.broadcast(table), table, pattern

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(texts: pa.Array) -> pa.Array:
            coder = _encoder(shared.value, pattern)

            def some(part: pa.Array) -> pa.Array:
                packed = [coder.encode_packed(x) if x else b"" for x in part.to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64)
                values = np.frombuffer(b"".join(packed), "<i4")
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

            return _by_slices(texts, some)

        @F.arrow_udf(T.BinaryType())
        def text_bytes(ids: pa.Array) -> pa.Array:
            tokens = _tokens(shared.value)
            return _by_slices(ids, lambda part: pa.array([decode(tokens, x.tolist()) for x in _rows(part)], pa.binary()))

        # Spark may copy a deterministic function into each of its uses; the ids are found once.
        self._encode, self._decode, self._shared = encode.asNondeterministic(), text_bytes, shared

    def ids(self, text: Column) -> Column:
        """Ids of a text column; a null text has no ids."""
        return self._encode(F.coalesce(text, F.lit("")))

    def text_bytes(self, ids: Column) -> Column:
        """Bytes of an id column; null ids give no bytes."""
        return self._decode(ids)

    def digests(self, df: DataFrame, text: str = "text", *, with_ids: bool = False) -> DataFrame:
        """Encodes a text column and decodes its ids again, in one pass and a slice of a batch at a time.

        Adds ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
        ``decoded_sha256``, and ``ids`` themselves if they are wanted; columns of the same name are
        replaced, and the text column stays only if it is named like one of them.
        """
        shared, pattern, place = self._shared, self.pattern, df.columns.index(text)
        made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        kept = [k for k, c in enumerate(df.columns) if k != place and c not in made]
        schema = T.StructType([df.schema.fields[k] for k in kept] + [T.StructField(c, t) for c, t in zip(made, (T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())), strict=False)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = _encoder(shared.value, pattern)
            for batch in slices(batches, place):
                packed = [coder.encode_packed(x) if x else b"" for x in batch.column(place).to_pylist()]
                sizes = [len(x) // 4 for x in packed]
                found = [pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed])]
                found.append(pa.array([hashlib.sha256(coder.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in packed]))
                if with_ids:
                    ends = np.cumsum([0, *sizes], dtype=np.int64)
                    found.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *found], schema.names)

        return df.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        return df.withColumn(out, self.ids(F.col(f"`{text}`")))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        return df.withColumn(out, self.text_bytes(F.col(f"`{ids}`")))


@F.arrow_udf(T.BinaryType())
def packed_ids(ids: pa.Array) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers."""
    return _by_slices(ids, lambda part: pa.array([x.astype("<u4").tobytes() for x in _rows(part)], pa.binary()))
