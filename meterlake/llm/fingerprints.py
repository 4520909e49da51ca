"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every five-word shingle (A-Z in lower case) is hashed once; the top bits of the hash name one of ``BINS``
bins, which keeps its smallest remainder.  An empty bin takes the value of a bin that a fixed
table of hash functions names, tried in order until one is filled (the same order for every
document, so equal sets of filled bins borrow alike); after ``TRIES`` misses the next filled bin to the
right is used.  Of each value ``BITS`` low bits are stored, as hexadecimal digits.  Two unrelated values
agree in these with chance 2^-BITS, which the likeness corrects for.

Defined results: null, empty or wordless text has the empty fingerprint, which is like itself (1) and unlike
all others (0); a text of one to four words is one shingle; equal texts have equal fingerprints; repeated rows are
fingerprinted each, and rows of one id follow each other by their text, so the next of a repeated row is its copy; rows without an id come first;
a table of one row is its own next; an empty table gives no rows; other columns stay as they are in ``fingerprint`` (one of the output's name gives way)
and are ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm import textops
from meterlake.llm.common import ship, table, text_bytes, text_of

BINS, BITS, TRIES, SHINGLE = 512, 4, 64, 5
#: Bytes of text in a bucket of neighbouring documents, and how many buckets there may be.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 1 << 21, 512, 200_000
BATCH_ROWS = 256

_EMPTY = np.uint64(2**64 - 1)
_BIN_SALT = textops.mix(np.arange(BINS, dtype=np.uint64), 103)
_TABLE = (textops.mix(np.arange(TRIES * BINS, dtype=np.uint64), 101) % np.uint64(BINS)).astype(np.int64).reshape(TRIES, BINS)


def densify(mins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a filled one."""
    full = mins != _EMPTY
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    out = mins.copy()
    r, c = np.nonzero(~full[rows])
    r = rows[r]
    for t in range(TRIES):
        if not len(r):
            return out
        j = _TABLE[t, c]
        hit = full[r, j]
        out[r[hit], c[hit]] = mins[r[hit], j[hit]]
        r, c = r[~hit], c[~hit]
    for d in range(1, BINS):
        if not len(r):
            break
        j = (c + d) % BINS
        hit = full[r, j]
        out[r[hit], c[hit]] = mins[r[hit], j[hit]]
        r, c = r[~hit], c[~hit]
    return out


def fingerprint_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints, a row of BINS * BITS / 8 bytes each, and which texts have shingles at all."""
    raw, at = textops.buffers(texts)
    out = np.zeros((len(texts), BINS * BITS // 8), dtype=np.uint8)
    some = np.zeros(len(texts), dtype=bool)
    for a, b in textops.slices(at):
        w = textops.words(raw[at[a] : at[b]], at[a : b + 1] - at[a], lower=True)
        h, doc = textops.shingles(w, b - a, SHINGLE)
        shift = np.uint64(64 - (BINS - 1).bit_length())
        mins = np.full((b - a) * BINS, _EMPTY)
        np.minimum.at(mins, doc * BINS + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
        mins = mins.reshape(b - a, BINS)
        some[a:b] = (mins != _EMPTY).any(axis=1)
        # the bin goes into the bits, so one value in many bins does not agree by chance in all of them at once
        low = (textops.mix(densify(mins) ^ _BIN_SALT, 7) & np.uint64(2**BITS - 1)).astype(np.uint8)
        out[a:b] = (low[:, 0::2] << 4) | low[:, 1::2]
    return out, some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of packed fingerprints, from 0 to 1."""
    x = a ^ b
    same = ((x >> 4) == 0).sum(axis=1) + ((x & 15) == 0).sum(axis=1)
    chance = 2.0**-BITS
    j = np.clip((same / BINS - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, j, (some_a == some_b).astype(float))


def hex_of(packed: np.ndarray, some: np.ndarray) -> list[str]:
    return [row.tobytes().hex() if s else "" for row, s in zip(packed, some)]


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add ``out_col``; all rows and columns stay."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != out_col]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = hex_of(*fingerprint_batch(b.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(made, pa.string())], names=[f.name for f in schema])

    return docs.select(*rest).mapInArrow(run, schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, extra, doc_id, text), each partition in order, such that a row that isn't extra is followed by its next document.

    Buckets are ranges of ids; a bucket ends with an extra copy of the next one's first document
    (the last with the very first), so no row ever needs another task's. Only one id a bucket
    reaches the driver, at most ``MAX_BUCKETS``.
    """
    from pyspark.ml.feature import Bucketizer

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-text_bytes(d) // BUCKET_BYTES)))
    cuts = d.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n)
    cuts = sorted(set(cuts))
    inf = float("inf")
    d = d.withColumn("x", F.coalesce(F.col("doc_id").cast("double"), F.lit(-inf)))
    d = Bucketizer(splits=[-inf, *(cuts or [0.0]), inf], inputCol="x", outputCol="b", handleInvalid="keep").transform(d)
    d = d.select(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("b").cast("int")).alias("bucket"), "doc_id", "text")
    heads = sorted(d.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect())
    before = [(heads[i]["head"], heads[i - 1]["bucket"], heads[i]["bucket"]) for i in range(len(heads))]
    h = docs.sparkSession.createDataFrame(before, T.StructType.fromDDL("head bigint, prior int, own int"))
    j = d.join(F.broadcast(h), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("bucket") == F.col("own")), "left")
    place = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    also = F.when(F.col("own").isNotNull(), F.array(place, F.struct(F.col("prior").alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array(place))
    rows = j.select(F.explode(also).alias("p"), "doc_id", "text").select("p.bucket", "p.extra", "doc_id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")


def edited(text: str, after: str) -> str:
    """The last half of the text (rounded down) gives way to as many of the next text's first characters, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(rows: DataFrame) -> DataFrame:
    """From ``with_next``: each document's fingerprint against its edited text's and its next document's."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # one row, whose next is still to come
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = pa.Table.from_batches([*([last] if last is not None else []), b.slice(at, BATCH_ROWS)]).combine_chunks().to_batches()[0]
                last = part.slice(part.num_rows - 1)
                if part.num_rows > 1:
                    yield one(part)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        real = np.flatnonzero(~np.asarray(b.column("extra").to_pylist(), dtype=bool)[:-1])
        changed = [edited(texts[i], texts[i + 1]) for i in real]
        own, some = fingerprint_batch(b.column("text"))
        new, some_new = fingerprint_batch(pa.array(changed, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            b.column("doc_id").take(pa.array(real)), pa.array([len(texts[i]) for i in real], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(hex_of(own[real], some[real]), pa.string()), pa.array(hex_of(new, some_new), pa.string()),
            pa.array(likeness(own[real], new, some[real], some_new)), pa.array(likeness(own[real], own[real + 1], some[real], some[real + 1])),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, SCHEMA)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(with_next(table(spark, sf_dir, "documents")))
