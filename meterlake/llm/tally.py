"""How often hashed tokens occur in the whole corpus, told back to the texts that hold them.

Texts are dealt into batches by a hash of what they say, once: equal texts meet in one batch, where one of them counts.
(``once`` takes out the copies within a partition before, so a text in a third of all rows is one row a partition.)
A batch sends each of its distinct tokens once, with the number of its texts that
hold it, as packed blocks: one block a bucket of the token space, 32 bits a token beside the bucket.  A bucket adds the
counts of its blocks and answers each block by one byte a token (0: in one text alone, else 1 + the power of two of the
count), in the block's order.  The answers meet the batch's texts where these already lie (the exchange of the texts is used twice); their
tokens are derived anew.

Where batches and buckets are so many that a block would hold a few tokens, they meet by way of a grid (``group``): ``group`` batches are a super-batch and ``group`` buckets a part of the token space; a cell of the
two adds the counts of its batches' blocks, sends each of its buckets one block, and deals the answers out to its batches again.  At 100 TB a block holds 4.5 tokens on the straight way, and
about 1,000 on both legs of the other.

So a token costs 4 bytes (8 by the grid) there and less than one back, and one in every text is a single entry a batch, which
bounds what a task holds of it.  Tokens that agree in bucket and 32 bits are counted together (about one in
600): the count is never too small, and only a count of one may be relied on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import ship

#: Bytes of text in a batch (they grow with the fourth root of the input, so that blocks stay worth their row), batches' worth of text in a bucket.
BATCH_BYTES, GROWS_FROM, BATCHES_IN_BUCKET, LEAST = 1 << 21, 1 << 34, 8, 64
#: Tokens that a block should hold, and bytes of text a token.
BLOCK_TOKENS, TOKEN_BYTES = 1000, 6

Tokens = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sizes(text_bytes: int) -> tuple[int, int]:
    """(batches, buckets) for so many bytes of text."""
    batch = BATCH_BYTES * max(1.0, (text_bytes / GROWS_FROM) ** 0.25)
    return max(LEAST, -int(-text_bytes // batch)), max(LEAST, -int(-text_bytes // (batch * BATCHES_IN_BUCKET)))


def group_of(text_bytes: int) -> int:
    """Batches in a super-batch and buckets in a part, so that blocks hold ``BLOCK_TOKENS``; 1 where they do so without."""
    batches, buckets = sizes(text_bytes)
    held = max(text_bytes / batches / TOKEN_BYTES / buckets, 1e-9)
    return 1 if held >= BLOCK_TOKENS or batches <= LEAST else min(batches, buckets, -int(-BLOCK_TOKENS // held))


def digested(docs: DataFrame, *more: str) -> DataFrame:
    """``docs``' text (null: empty) with two 64-bit hashes, t1 and t2, which tell texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


def batch_of(key: Column, batches: int) -> Column:
    return F.pmod(key, F.lit(batches)).cast("int")


def once(rows: DataFrame, least: str | None = None) -> DataFrame:
    """``rows`` with t1 and t2, less those that repeat an earlier text of their partition (with a smaller or equal ``least``, if that is a column)."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            keys = zip(b.column("t1").to_numpy().tolist(), b.column("t2").to_numpy().tolist())
            new = []
            for k, i in zip(keys, b.column(least).to_pylist() if least else [0] * b.num_rows):
                new.append(seen.get(k, i + 1) > i)
                if new[-1]:
                    seen[k] = i
            yield b if all(new) else b.filter(pa.array(new, pa.bool_()))

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _one(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _distinct_texts(t: pa.Table, least: str | None = None) -> pa.Table:
    """One row of each text, that with the smallest ``least``."""
    t1, t2 = (_one(t, k).to_numpy() for k in ("t1", "t2"))
    order = np.lexsort((_one(t, least).to_numpy() if least else np.arange(len(t1)), t2, t1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(t1[order]) != 0) | (np.diff(t2[order]) != 0)
    return t if new.all() else t.take(pa.array(np.sort(order[new])))


def _places(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _counted(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all tokens in order, and how many (text, token) pairs have each."""
    v = np.sort(_places(h, buckets))
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return v[at], np.diff(np.append(at, len(v))).astype(np.uint32)


def _packed(a: np.ndarray) -> bytes:
    return (a.astype(np.uint8) if not len(a) or a.max() < 256 else a).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.uint32).astype(np.int64)


def tally(rows: DataFrame, buckets: int, tokens: Tokens, use: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table], schema: str,
          least: str | None = None, group: int = 1) -> DataFrame:
    """``use`` of every batch of distinct texts of ``rows`` (batch: int, text, t1, t2, and more), and of what gives its tokens' answers.

    ``tokens`` gives (hash, number of text), each pair once.  Of equal texts the row with the smallest ``least`` stands for all.  ``group``: see above.
    """
    ship(rows.sparkSession)
    if group > 1:
        return _by_grid(rows, buckets, tokens, use, schema, least, group)

    def send(t: pa.Table) -> pa.Table:
        v, n = _counted(tokens(_one(_distinct_texts(t), "text"))[0], buckets)
        bucket = (v >> np.uint64(32)).astype(np.int64)
        rest = v.astype(np.uint32)
        cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(v)]
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), "batch": pa.array([t.column("batch")[0].as_py()] * len(spans), pa.int32()),
            "rest": pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([_packed(n[a:b]) for a, b in spans], pa.binary())})

    blocks = rows.groupBy("batch").applyInArrow(send, "bucket int, batch int, rest binary, n binary")
    bands = blocks.groupBy("bucket").applyInArrow(_add, "batch int, bucket int, band binary")
    return _met(rows, bands, buckets, tokens, use, schema, least)


def _add(t: pa.Table) -> pa.Table:
    """The answers of a bucket to its blocks."""
    blocks = [np.frombuffer(x, np.uint32) for x in t.column("rest").to_pylist()]
    ends = np.cumsum([len(x) for x in blocks])
    counts = np.concatenate([_unpacked(x, len(b)) for x, b in zip(t.column("n").to_pylist(), blocks)])
    _, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    band = np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)[inverse]
    return pa.table({"batch": _one(t, "batch"), "bucket": _one(t, "bucket"), "band": pa.array([x.tobytes() for x in np.split(band, ends[:-1])], pa.binary())})


def _met(rows: DataFrame, bands: DataFrame, buckets: int, tokens: Tokens, use: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table], schema: str, least: str | None) -> DataFrame:
    """The answers (batch, bucket: their order, band) where the texts of their batch lie."""

    def meet(texts: pa.Table, bands: pa.Table) -> pa.Table:
        texts = _distinct_texts(texts, least)
        v, _ = _counted(tokens(_one(texts, "text"))[0], buckets)
        order = np.argsort(bands.column("bucket").to_numpy())
        told = bands.column("band").to_pylist()
        band = np.frombuffer(b"".join([told[i] for i in order]), np.uint8)
        if len(band) != len(v):
            raise RuntimeError(f"{len(band)} answers for {len(v)} tokens")

        def answer(h: np.ndarray) -> np.ndarray:
            return band[np.searchsorted(v, _places(h, buckets))] if len(h) else np.empty(0, np.uint8)

        return use(texts, answer)

    def met(texts: pa.Table, bands: pa.Table) -> pa.Table:
        return meet(texts, bands) if texts.num_rows else empty

    made = rows.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(made).empty_table()
    return rows.groupBy("batch").cogroup(bands.groupBy("batch")).applyInArrow(met, schema)


def _by_grid(rows: DataFrame, buckets: int, tokens: Tokens, use: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table], schema: str, least: str | None, group: int) -> DataFrame:
    g = np.uint64(group)

    def places(rest: bytes, held: bytes, part: int) -> np.ndarray:
        """A block's places: 32 bits each, and how many lie in each bucket of the part."""
        bucket = np.repeat(np.arange(group, dtype=np.uint64) + np.uint64(part * group), np.frombuffer(held, np.uint32))
        return bucket << np.uint64(32) | np.frombuffer(rest, np.uint32).astype(np.uint64)

    def send(t: pa.Table) -> pa.Table:
        v, n = _counted(tokens(_one(_distinct_texts(t), "text"))[0], buckets)
        bucket = v >> np.uint64(32)
        part = (bucket // g).astype(np.int64)
        rest = v.astype(np.uint32)
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(v)]
        spans, batch = list(zip(cuts[:-1], cuts[1:])), t.column("batch")[0].as_py()
        held = [np.bincount((bucket[a:b] % g).astype(np.int64), minlength=group).astype(np.uint32).tobytes() for a, b in spans]
        return pa.table({
            "super": pa.array([batch // group] * len(spans), pa.int32()), "part": pa.array([int(part[a]) for a, _ in spans], pa.int32()), "batch": pa.array([batch] * len(spans), pa.int32()),
            "rest": pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()), "held": pa.array(held, pa.binary()), "n": pa.array([_packed(n[a:b]) for a, b in spans], pa.binary())})

    def cell(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The cell's blocks as places, its distinct places in order, and which of them each token has."""
        part = t.column("part")[0].as_py()
        blocks = [places(r, h, part) for r, h in zip(t.column("rest").to_pylist(), t.column("held").to_pylist())]
        return blocks, *np.unique(np.concatenate(blocks), return_inverse=True)

    def gather(t: pa.Table) -> pa.Table:
        blocks, v, inverse = cell(t)
        counts = np.concatenate([_unpacked(x, len(b)) for x, b in zip(t.column("n").to_pylist(), blocks)])
        n = np.bincount(inverse, weights=counts).astype(np.uint32)
        bucket, rest = (v >> np.uint64(32)).astype(np.int64), v.astype(np.uint32)
        cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(v)]
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), "batch": pa.array([t.column("super")[0].as_py()] * len(spans), pa.int32()),
            "rest": pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()), "n": pa.array([_packed(n[a:b]) for a, b in spans], pa.binary())})

    def deal(t: pa.Table, told: pa.Table) -> pa.Table:
        blocks, v, inverse = cell(t)
        band = np.frombuffer(b"".join(told.column("band").take(pa.array(np.argsort(told.column("bucket").to_numpy()))).to_pylist()), np.uint8)
        if len(band) != len(v):
            raise RuntimeError(f"{len(band)} answers for {len(v)} tokens of a cell")
        parts = np.split(band[inverse], np.cumsum([len(b) for b in blocks])[:-1])
        return pa.table({"batch": _one(t, "batch"), "bucket": _one(t, "part"), "band": pa.array([x.tobytes() for x in parts], pa.binary())})

    blocks = rows.groupBy("batch").applyInArrow(send, "super int, part int, batch int, rest binary, held binary, n binary")
    sums = blocks.groupBy("super", "part").applyInArrow(gather, "bucket int, batch int, rest binary, n binary")
    told = sums.groupBy("bucket").applyInArrow(_add, "batch int, bucket int, band binary").select(F.col("batch").alias("super"), F.floor(F.col("bucket") / group).cast("int").alias("part"), "bucket", "band")
    bands = blocks.groupBy("super", "part").cogroup(told.groupBy("super", "part")).applyInArrow(deal, "batch int, bucket int, band binary")
    return _met(rows, bands, buckets, tokens, use, schema, least)
