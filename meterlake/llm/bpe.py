"""Byte-level BPE over Arrow batches with the tokenizers library, built from a table of ranks.

The driver reads the rank file once and derives the merge of each token by merging its bytes under the
lower ranks; what the executors get is the finished tokenizer as one string of fixed size (the
vocabulary's), so no worker needs the file.  Bytes are written as the characters of the usual
byte-to-character table, which the decoder reverses.

Words repeat, so each worker keeps the ids of the matches it has met (``CACHE`` of them, and ``CACHE_CHARS`` characters, at
most, or those of one chunk; then it begins anew) and hands the library only new ones, many at a time.

A text is cut, once ``CHUNK`` characters are full, before a space that follows a non-space or any white space that follows a
letter or digit; a match of the pattern never spans such a place, so ids are those of the whole text while what is held at
once is a chunk.  A longer run without such a place is a chunk of its own.

The library gets the pattern's matches one by one, so offsets are not asked of it: each token's first character follows from the lengths of the tokens' bytes,
which lie end to end over the text's.  A token that begins within a character (split by the merges) has that character's place.

Defined results: null or empty text has no tokens; every row gives a row, repeated ones equal ones; ties can't be, as merges have distinct ranks; an empty table
gives no rows; other columns are carried along, but for those with the names of the outputs, which give way.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.common import ship, table

CHUNK, CACHE, CACHE_CHARS = 1 << 16, 1 << 18, 1 << 23
#: Rows of a batch, and bytes of its texts or ids; one longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 24


#: The ranges of bytes that stand for themselves in the usual table.
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes ``token``: merge its bytes by rank until two parts are left."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    name = lambda token: "".join(chars[b] for b in token)
    vocab = {name(token): rank for token, rank in ranks.items()}
    long = sorted((token for token in ranks if len(token) > 1), key=ranks.__getitem__)
    merges = [tuple(map(name, merge_of(token, ranks))) for token in long]
    t = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t.to_str()


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Cut where no match of the pattern can span: before a space after a non-space, or white space after a letter or digit."""
    if len(text) <= size:
        return [text]
    out, at, edge = [], 0, re.compile(r"(?<=\S) |(?<=[^\W_])\s")
    while len(text) - at > size and (m := edge.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Codec:
    """A tokenizer with its tables, made once in each worker."""

    made: dict[int, Codec] = {}

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.pattern = regex.compile(json.loads(spec)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # gets single matches
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of the keys
        byte = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    @classmethod
    def of(cls, spec: str) -> Codec:
        if (key := hash(spec)) not in cls.made:
            cls.made[key] = cls(spec)
        return cls.made[key]

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in chunks(text):
            found = self.pattern.findall(part)
            if new := [x for x in {*found} if x not in self.known]:  # a set less the keys would walk all keys
                size = sum(map(len, new))
                if len(self.known) + len(new) > CACHE or self.held + size > CACHE_CHARS:
                    self.known.clear()
                    new = [*{*found}]
                    self.held, size = 0, sum(map(len, new))
                self.held += size
                for word, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                    self.known[word] = np.array(e.ids, dtype=np.int32).tobytes()
            out.append(b"".join(map(self.known.__getitem__, found)))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def char_starts(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The character in which each token begins; a token within a character has that character's place."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        return char[ends - self.lengths[ids]].astype(np.int32) if len(ids) else np.empty(0, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _rows(batches: Iterator[pa.RecordBatch], most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = max(1, min(most, BATCH_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, each):
            yield b.slice(at, each)


def encode(docs: DataFrame, spec: str, text_col: str = "text", ids_col: str = "ids", starts_col: str | None = "char_starts", bytes_col: str | None = None) -> DataFrame:
    """Replace ``text_col`` by token ids and, unless these are None, each token's first character and the bytes that the ids decode to.

    Decoding here rather than by ``decode`` saves the ids a way to another worker, and the executor that worker.
    """
    rest = [c for c in docs.columns if c not in (text_col, ids_col, starts_col, bytes_col)]
    made = [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in (ids_col, starts_col) if c] + [T.StructField(c, T.BinaryType()) for c in (bytes_col,) if c]
    schema = T.StructType([docs.schema[c] for c in rest] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(spec)
        for b in _rows(batches):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            ids = [codec.encode(t) for t in texts]
            cols = [b.column(c) for c in rest] + [_lists(ids)]
            if starts_col:
                cols.append(_lists([codec.char_starts(t, i) for t, i in zip(texts, ids)]))
            if bytes_col:
                cols.append(pa.array([codec.decode(i.tolist()) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    ship(docs.sparkSession)
    return docs.select(*rest, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, spec: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids_col`` stands for; they are UTF-8 as a whole even where a token ends inside a character."""
    rest = [c for c in encoded.columns if c != bytes_col]
    schema = T.StructType([encoded.schema[c] for c in rest] + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(spec)
        for b in _rows(batches):
            out = [codec.decode(ids or []) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.binary())], names=[f.name for f in schema])

    ship(encoded.sparkSession)
    return encoded.select(*rest).mapInArrow(run, schema)


def default_spec() -> str:
    import public_tokenizers

    return tokenizer_json(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def digests(docs: DataFrame, spec: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that begin within a character)."""
    spec = spec or default_spec()
    coded = encode(docs.select("doc_id", "text"), spec, bytes_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    inside = F.size("char_starts") - F.size(F.array_distinct("char_starts"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        inside.cast("long").alias("n_split"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
