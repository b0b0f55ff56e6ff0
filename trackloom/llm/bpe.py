"""Byte-level BPE encoding and decoding.

A text is split by a pattern; each match is encoded alone. Bytes are mapped to Latin-1 characters so that an
Aho-Corasick automaton over the vocabulary gives the longest token that starts at each byte. The encoder walks from
longest matches and backtracks: a token may follow another only if encoding the two tokens' bytes gives back just these two. Adjacent pairs
that pass this test are exactly the tokens that the merges by rank would give; the test's results are memoised, and an
end that turned out a dead end is never tried again, so the walk is linear in the bytes of a match.

Null and empty texts have no tokens. Repeated rows give repeated results; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from trackloom.llm.shared import bounded_batches, documents

#: Entries of a generation of a worker's memos, and the longest match that is kept. They bound memory, never results: a full generation becomes the old
#: one, from which what is still used moves to the new.
MEMO_ENTRIES, MEMO_CHARS = 130_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for a table of ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merges by lowest rank, leftmost first, as they are defined; for the short strings of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`."""
        pair = left << 32 | right
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) >= 3 * MEMO_ENTRIES:
                self._fits.clear()
            a, b = self.tokens[left], self.tokens[right]
            found = self._fits[pair] = self.merged(a + b) == [a, b]
        return found

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self._shorter:
            t = self.tokens[token]
            self._shorter[token] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), None)
        return self._shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        text, tokens = data.decode("latin-1"), self.tokens
        longest: list[int | None] = [None] * len(text)
        for end, token in self.automaton.iter(text):  # ends ascend, so the last match that starts at a byte is the longest
            longest[end + 1 - len(tokens[token])] = token
        dead = bytearray(len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while token is not None:
                end = at + len(tokens[token])
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter(token)
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = self.shorter(token)
            else:
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else None
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self._pieces
        for piece in self.split.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self._old.get(piece)
                if ids is None:
                    ids = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
                if len(piece) <= MEMO_CHARS:
                    if len(pieces) >= MEMO_ENTRIES:
                        self._old, self._pieces = pieces, {}
                        pieces = self._pieces
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[int, Codec] = {}


def codec_of(vocabulary) -> Codec:
    """The codec for a broadcast (ranks, pattern), made once in a worker."""
    if vocabulary.id not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.id] = Codec(*vocabulary.value)
    return _CODECS[vocabulary.id]


class _Vocabulary:
    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.broadcast = spark.sparkContext.broadcast((read_ranks(path), pattern))  # fixed in size: the vocabulary's file
        self.id = self.broadcast.id if hasattr(self.broadcast, "id") else id(self.broadcast)

    @property
    def value(self):
        return self.broadcast.value


def _rows(batch: pa.RecordBatch, most: int = 256):
    for i in range(0, batch.num_rows, most):
        yield batch.slice(i, most)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every text, whole."""
    vocabulary = _Vocabulary(df.sparkSession, path, pattern)

    def run(batches):
        codec = codec_of(vocabulary)
        for whole in batches:
            for b in _rows(whole):
                ids = [codec.encode(t) if t else [] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of every list of ids; null lists are empty."""
    vocabulary = _Vocabulary(df.sparkSession, path, pattern)

    def run(batches):
        codec = codec_of(vocabulary)
        for whole in batches:
            for b in _rows(whole):
                data = [codec.decode(ids or []) for ids in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, data binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes every text, decodes the ids again, and keeps digests of both."""
    vocabulary = _Vocabulary(df.sparkSession, path, pattern)

    def run(batches):
        codec = codec_of(vocabulary)
        words = {i: str(i) for i in codec.tokens}
        for whole in batches:
            for b in _rows(whole):
                n, of_ids, of_bytes = [], [], []
                for text in b.column(1).to_pylist():
                    ids = codec.encode(text) if text else []
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(words.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, n_tokens, tokens): ids packed as little-endian integers of 16 bits, or 32 where the vocabulary needs them.

    Every list is decoded again; a text that doesn't come back whole stops the job.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    vocabulary = _Vocabulary(spark, path, pattern)
    put = df.select(F.col(text_col).alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate((id_col, *carry))))
    schema = StructType([*put.schema.fields[1:], StructField("n", LongType()), StructField("tokens", BinaryType())])

    def run(batches):
        codec = codec_of(vocabulary)
        kind = "H" if max(codec.tokens) < 1 << 16 else "I"
        for whole in batches:
            for b in _rows(whole):
                n, packed = [], []
                for text in b.column(0).to_pylist():
                    ids = codec.encode(text) if text else []
                    if codec.decode(ids) != (text or "").encode("utf-8", "replace"):
                        raise ValueError("a text was not restored")
                    n.append(len(ids))
                    packed.append(array(kind, ids).tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(packed, pa.binary())], schema.names)

    return put.mapInArrow(run, schema).toDF(id_col, *carry, "n_tokens", "tokens")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_byte_bpe": op2}
SQL: dict[str, str] = {}
