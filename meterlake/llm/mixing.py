"""Mixing sources to target weights by Sainte-Lague apportionment.

The tokens (here: words) of a source, laid end to end in a seeded order of its documents, are cut into
equal blocks.  Sources get whole numbers of blocks by highest quotients target / (2k + 1); each source's
blocks go to its shards by the same rule; a shard then takes its quota of blocks from a seeded start on,
wrapping around, so most documents are taken whole.  A quota above the shard's block count means that
every block is taken once and the rest a second time; no block is taken more than ``cap`` times.

Highest quotients are found without listing them: rounding target / divisor to the nearest whole
number gives the same award for the right divisor, found by bisection; the last few seats go by
quotient.  The driver holds one row per source (as the apportionment is among all of them) and at most ``MAX_SHARDS`` + sources rows of shards,
whatever the input's size; documents never leave the executors.

Defined results: null text has size 0 and takes 0 words; null source is a source of its own, last in order;
repeated rows are rows of their own; ties in the seeded order are put in order by doc_id and size;
an empty table gives no rows; other columns are ignored, and those to keep come in one struct, so none can clash with what is made here.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from meterlake.llm.common import WORD, durable, table, text_of

#: Fixed values of the query's contract.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Words in a shard at least, shards at most, words in a block at most.
SHARD_WORDS, MAX_SHARDS, BLOCK_WORDS = 16_384, 65_536, 16
#: Rows (of some 50 bytes) that are sent to all executors at most.
MAX_BROADCAST = 200_000


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``cap`` times a size goes to the others, again and again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            open_.remove(i)
        left = float(total) - sum(out)
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), none above its ``most``; ties go to the earlier."""
    seats = min(seats, sum(most))
    if seats <= 0 or not any(v > 0 for v in votes):
        return [0] * len(votes)

    def award(divisor: float) -> list[int]:
        # quotient of seat k is at least 2 * divisor  <=>  k <= votes / divisor - 1/2
        return [min(m, max(0, int(v / divisor + 0.5))) if v > 0 else 0 for v, m in zip(votes, most)]

    low, high = 0.0, 4.0 * max(votes) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(award(mid)) > seats:
            low = mid
        else:
            high = mid
    got = award(high)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def small(df: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows to be joined with: sent to all executors while it is small, else joined by its key (a source's documents are many shards, so none is hot then)."""
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, first, second.

    ``first`` and ``second`` are the arrays of (from, to) word offsets inside the document that the
    base round and the extra round take; together they hold ``taken`` words.  Columns named in ``keep``
    are carried along in the struct ``kept``.  ``docs`` needs doc_id, source, text; other columns are ignored.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), text_of())
    more = [F.struct(*keep).alias("kept")] if keep else []
    sized = durable(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("__order"),
                    *more), "sized")

    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    total = sum(sizes)
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * total, cap)
    shards = [max(1, min(-(-s // SHARD_WORDS), -(-MAX_SHARDS * s // max(1, total)))) for s in sizes]
    schema = T.StructType.fromDDL("source string, source_size bigint, target double, __shards int")
    per_source = spark.createDataFrame(
        [(r["source"], s, t, n) for r, s, t, n in zip(rows, sizes, targets, shards)], schema)
    by_source = small(per_source.withColumnRenamed("source", "__source"), len(rows))
    dealt = sized.join(by_source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn(
        "__shard", F.pmod(F.xxhash64(F.lit(seed + 1), "__order", "doc_id"), F.col("__shards")).cast("int"))

    block = max(1, min(BLOCK_WORDS, int(min([t for t in targets if t > 0], default=1) // 256)))
    parts = dealt.groupBy("source", "__shard").agg(F.sum("size").alias("size")).collect()
    parts.sort(key=lambda r: (r["source"] is None, r["source"] or "", r["__shard"]))
    blocks = [-(-int(r["size"]) // block) for r in parts]
    mine: dict[str | None, list[int]] = {}
    for i, r in enumerate(parts):
        mine.setdefault(r["source"], []).append(i)
    quota = sainte_lague(targets, round(sum(targets) / block), [cap * sum(blocks[i] for i in mine[r["source"]]) for r in rows])
    quotas = [0] * len(parts)
    for r, q in zip(rows, quota):
        own = mine[r["source"]]
        for i, n in zip(own, sainte_lague([int(parts[i]["size"]) for i in own], q, [cap * blocks[i] for i in own])):
            quotas[i] = n
    schema = T.StructType.fromDDL("source string, shard int, __blocks bigint, __quota bigint")
    per_shard = spark.createDataFrame(
        [(r["source"], r["__shard"], b, q) for r, b, q in zip(parts, blocks, quotas)], schema)
    by_shard = small(per_shard.withColumnRenamed("source", "__source"), len(parts))

    w = Window.partitionBy("source", "__shard").orderBy("__order", "doc_id", "size")
    at = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("__at", at).join(
        by_shard, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("shard")))
    n, q = F.greatest(F.col("__blocks"), F.lit(1)), F.col("__quota")
    rest = q % n
    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.coalesce("source", F.lit("")), "__shard"), n)

    def inside(a: Column, b: Column) -> Column:
        """The part of words [a, b) of the shard that falls into this document, as offsets in it."""
        lo, hi = F.greatest(a, F.col("__at")), F.least(b, F.col("__at") + F.col("size"))
        return F.when(lo < hi, F.struct((lo - F.col("__at")).alias("from"), (hi - F.col("__at")).alias("to")))

    full = F.floor(q / n)
    whole = F.when((full > 0) & (F.col("size") > 0), F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to")))
    size_b = F.lit(block)
    some = F.filter(F.array(inside(start * size_b, F.least(start + rest, n) * size_b),
                            inside(F.lit(0), F.greatest(start + rest - n, F.lit(0)) * size_b)), lambda x: x.isNotNull())
    placed = placed.select(
        "doc_id", "source", "size", "source_size", "target", *(["kept"] if keep else []),
        full.cast("long").alias("rounds"), whole.alias("whole"), F.array_sort(some).alias("extra"))
    extra = F.aggregate("extra", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return placed.withColumn("taken", F.col("rounds") * F.col("size") + extra)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")
