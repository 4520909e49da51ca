"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

Two texts can only reach the threshold if, under ANY global order of shingles, they share one
of the first n - ceil(n * threshold) + 1.  All ``ORDERS`` orders put rare shingles first (by power of two of document frequency) and
differ in how they break ties.  Shingles of one text only come first in every order and can't be shared, so they use up places and are dropped
before anything is joined.  Texts count once each, however many rows hold them.

The work is a fixed number of steps, whatever the groups look like:

1. Module ``tally`` gives every text its shingles' frequencies; texts whose prefixes hold a shared shingle go on.
2. Texts that share a prefix shingle under the first order, in any number of steps, are a cell.  A token's members are joined in a star: within a
   partition by one pass of numpy, so that a token is one row for each of its groups in a partition, then across partitions by its least group.
   Linked texts always stand in one cell.
3. Cells of more than one block are cut again by the second order's prefixes within the cell, then by the third's: the filters are intersected.
4. Within a cell texts are compared in blocks of about ``BLOCK`` texts or ``BLOCK_GRAMS`` shingles, and only where their numbers of shingles allow a link.
   Of a pair of blocks, pairs that fail one of the orders' filters go first; of the rest the intersections are matrix products.
   Only sums of rows linked with each text, and one edge a text, leave it.

So no link is lost, none is written as a pair, and each pair of texts in a cell is compared once.  What grows
with the square of a group is only the comparison of a large cell's blocks, as many links are to be counted there; the blocks are separate tasks.

Texts are known by two 64-bit hashes, shingles by one.

Defined results: null, empty or wordless text has an empty set and links with nothing; fewer words than
a shingle make one shingle; repeated rows are rows of their own with equal results, linked with each other; a null id can't be
a component id (it gets the least id of its component, else null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import tally, textops
from meterlake.llm.common import durable, forget, join_counted, ship, table
from meterlake.llm.components import components, contracted

SHINGLE, PERCENT, ORDERS = 5, 75, 3
BLOCK, BLOCK_GRAMS = 1024, 4_000_000
#: Pairs of sets up to so many are compared one by one.
FEW = 6


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, shingle hashes, numbers of their texts from the first) of slices of texts, each shingle once a text."""
    raw, at = textops.buffers(texts)
    for a, b in textops.slices(at):
        w = textops.words(raw[at[a] : at[b]], at[a : b + 1] - at[a], lower=True)
        yield a, b, *textops.distinct(*textops.shingles(w, b - a, k), b - a)


def prefixes(texts: DataFrame, buckets: int, percent: int, orders: int, k: int, group: int = 1) -> DataFrame:
    """t1, t2, n (set size) and, where a prefix holds a shared shingle, grams (packed hashes) and marks (a byte a shingle: bit i for the prefix of order i)."""

    def tokens(t: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [(h, doc + a) for a, _, h, doc in _sets(t, k)] or [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        return np.concatenate([h for h, _ in parts]), np.concatenate([d for _, d in parts])

    def use(t: pa.Table, answer) -> pa.Table:  # noqa: ANN001
        size = np.zeros(t.num_rows, dtype=np.int64)
        grams: list[bytes | None] = [None] * t.num_rows
        marks: list[bytes | None] = [None] * t.num_rows
        for a, b, h, doc in _sets(tally._one(t, "text"), k):
            band = answer(h)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            n = np.diff(cut)
            size[a:b] = n
            shared = np.bincount(doc[band > 0], minlength=b - a)
            places = n - -(-n * percent // 100) + 1 - (n - shared)
            for i in np.flatnonzero((n > 0) & (shared > 0) & (places > 0)):
                s, f = h[cut[i] : cut[i + 1]], band[cut[i] : cut[i + 1]]
                at, mark = np.flatnonzero(f), np.zeros(len(s), dtype=np.uint8)
                for o in range(orders):
                    mark[at[np.lexsort((textops.mix(s[at], 20 + o), f[at]))[: places[i]]]] |= 1 << o
                grams[a + i], marks[a + i] = s.tobytes(), mark.tobytes()
        return pa.table({"t1": tally._one(t, "t1"), "t2": tally._one(t, "t2"), "n": pa.array(size), "grams": pa.array(grams, pa.binary()), "marks": pa.array(marks, pa.binary())})

    return tally.tally(texts, buckets, tokens, use, "t1 bigint, t2 bigint, n bigint, grams binary, marks binary", group=group)


def _unpack(column: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def cells(members: DataFrame, order: int) -> DataFrame:
    """(node, component) of ``members`` (cls, cell, grams, marks) that share a prefix shingle of ``order`` with another of their cell."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, classes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for b in batches:
            for c, cell, g, m in zip(b.column("cls").to_pylist(), b.column("cell").to_pylist(), _unpack(b.column("grams"), np.uint64), _unpack(b.column("marks"), np.uint8)):
                toks.append(textops.mix(g[m & (1 << order) != 0] ^ textops.mix(np.array([cell], dtype=np.int64).view(np.uint64), 31)))
                classes.append(np.full(len(toks[-1]), c, dtype=np.int64))
        tok, t = np.unique(np.concatenate(toks), return_inverse=True)
        cls, c = np.unique(np.concatenate(classes), return_inverse=True)
        _, root = contracted(c, len(cls) + t)  # classes come first, so each root is one
        own = np.flatnonzero(root[: len(cls)] != np.arange(len(cls)))
        token = pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(tok.view(np.int64))])
        u, v = np.concatenate((cls[own], cls[root[len(cls) :]])), np.concatenate((cls[root[own]], cls[root[len(cls) :]]))
        made = pa.table({"token": token, "a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})
        yield from made.to_batches(1 << 17)

    ship(members.sparkSession)
    post = durable(members.mapInArrow(stars, "token bigint, a bigint, b bigint"), "stars")
    held = post.filter("token IS NOT NULL").select("token", "a")
    least = held.groupBy("token").agg(F.min("a").alias("b"), F.count("*").alias("m")).filter("m > 1").drop("m")
    across = held.join(least, "token").filter("a != b").select("a", "b")
    found = components(post.filter("token IS NULL").select("a", "b").unionByName(across))
    made = durable(found, "cells")
    forget(post, found)
    return made


def _shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets, left by right."""
    if len(left) * len(right) <= FEW:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], dtype=np.float64)
    out = np.zeros((len(left), len(right)))
    grams, row = [np.concatenate(x) for x in (left, right)], [np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (left, right)]
    both = np.intersect1d(np.unique(grams[0]), np.unique(grams[1]), assume_unique=True)
    at = [np.searchsorted(both, g) for g in grams]
    for i, g in enumerate(grams):
        held = np.flatnonzero(both[np.minimum(at[i], len(both) - 1)] == g) if len(both) else np.zeros(0, dtype=np.int64)
        held = held[np.argsort(at[i][held], kind="stable")]
        at[i], row[i] = at[i][held], row[i][held]
    for a in range(0, len(both), width):
        dense = []
        for i, n in enumerate((len(left), len(right))):
            lo, hi = np.searchsorted(at[i], [a, a + width])
            dense.append(np.zeros((n, min(width, len(both) - a)), dtype=np.float32))
            dense[i][row[i][lo:hi], at[i][lo:hi] - a] = 1
        out += dense[0] @ dense[1].T
    return out


def _linked(sets: list[np.ndarray], marks: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, orders: int) -> np.ndarray:
    """Which of ``left`` and ``right`` are linked: what passes the filter of every order is verified."""
    hit = np.ones((len(left), len(right)), dtype=bool)
    for o in range(orders):
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(rows) or not len(cols):
            return hit
        a, b = ([sets[i][marks[i] & (1 << o) != 0] for i in part] for part in (left[rows], right[cols]))
        hit[np.ix_(rows, cols)] &= _shared(a, b) > 0
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if len(rows) and len(cols):
        a, b = [sets[i] for i in left[rows]], [sets[i] for i in right[cols]]
        both = _shared(a, b)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - both
        hit[np.ix_(rows, cols)] &= both * 100 >= union * percent
    return hit


def compared(inside: DataFrame, sets: DataFrame, percent: int, orders: int, block: int, block_grams: int) -> DataFrame:
    """Per class and pair of blocks: cls, m (rows of other classes that it is linked with there), root (the least class that its links lead to there).

    ``inside`` is (cls, cell, n, n_rows), ``sets`` (cls, grams, marks).
    """
    # sizes whose ratio can reach the threshold are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(105 / percent)).cast("int")
    size = inside.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("g")).withColumn("small", (F.col("m") <= block) & (F.col("g") <= block_grams))
    n, g = inside.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slots = 1 + max(n // block, g // block_grams)
    known = inside.join(size.select("cell", "small"), "cell")
    cols = ("cls", "cell", "n_rows")
    small = known.filter("small").select(*cols, F.pmod(F.xxhash64("cell"), F.lit(slots)).alias("key"), F.lit(-1).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    large = known.filter(~F.col("small")).withColumn("band", band)
    parts = large.groupBy("cell", "band").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks"))
    # a crowded band of a cell is known once a block, so no partition gets more than its share
    mine = large.join(parts, ["cell", "band"]).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(4)), F.col("blocks")).cast("int"))
    above = parts.select("cell", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = parts.select("cell", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    mine = mine.join(above, ["cell", "band"], "left").join(below, ["cell", "band"], "left")

    def meets(count: str, i: F.Column, j: F.Column, step: int, side: F.Column) -> F.Column:
        to = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(to, lambda o: F.struct((F.col("band") - int(step == -1)).cast("int").alias("band"), i(o).alias("i"), j(o).alias("j"), side(o).alias("side")))

    own = F.col("mine")
    one = meets("blocks", lambda o: F.least(own, o), lambda o: F.greatest(own, o), 0, lambda o: F.when(own < o, 1).when(own > o, 2).otherwise(0))
    up = meets("above", lambda o: -own - 1, lambda o: -o - 1, 1, lambda o: F.lit(1))  # blocks of neighbouring bands: numbers below 0
    down = meets("below", lambda o: -o - 1, lambda o: -own - 1, -1, lambda o: F.lit(2))
    large = mine.select(*cols, F.explode(F.concat(one, up, down)).alias("p")).select(*cols, F.col("cell").alias("key"), "p.band", "p.i", "p.j", "p.side")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        c, cell, w, side = (t.column(x).to_numpy() for x in ("cls", "cell", "n_rows", "side"))
        sets, marks = _unpack(t.column("grams"), np.uint64), _unpack(t.column("marks"), np.uint8)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            same = not side[rows].any()
            left, right = (rows, rows) if same else (rows[side[rows] == 1], rows[side[rows] == 2])
            if not len(left) or not len(right) or (same and len(rows) < 2):
                continue
            hit = _linked(sets, marks, left, right, percent, orders)
            if same:
                np.fill_diagonal(hit, False)
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            m = np.zeros(len(t), dtype=np.int64)
            m[left] += hit @ w[right]
            if not same:
                m[right] += w[left] @ hit
            node, root = contracted(c[left[a]], c[right[b]])
            at = rows[np.argsort(c[rows])]
            at = at[np.searchsorted(c[at], node)]
            out.append((node, m[at], root))
        return pa.table(dict(zip(("cls", "m", "root"), (pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)))))

    full = small.unionByName(large).join(sets, "cls")
    return full.groupBy("key", "band", "i", "j").applyInArrow(compare, "cls bigint, m bigint, root bigint")


def join(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, orders: int = ORDERS, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, detail: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, n_links (other rows at the threshold); with ``detail`` also t1 and t2 (hashes of its text) and component (null without words)."""
    spark = docs.sparkSession
    ship(spark)
    d = tally.digested(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rows = durable(d.select("doc_id", "t1", "t2", F.octet_length("text").alias("size")), "digests")
    total = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    batches, buckets = tally.sizes(total)
    texts = tally.once(d.select(tally.batch_of(F.col("t1"), batches).alias("batch"), "t1", "t2", "text"))
    made = prefixes(texts, buckets, percent, orders, k, tally.group_of(total)).withColumn("cls", F.monotonically_increasing_id())
    made = durable(made, "sets")
    sets = made.filter("grams IS NOT NULL").select("cls", "grams", "marks")
    told = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")).join(made.select("t1", "t2", "n", "cls"), ["t1", "t2"])
    told = durable(told, "told")
    comp = cells(sets.withColumn("cell", F.lit(0).cast("long")), 0)
    done = [made, told, comp]
    for o in range(1, orders):
        size = comp.join(told.select(F.col("cls").alias("node"), "n"), "node").groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("g"))
        big = durable(size.filter((F.col("m") > block) | (F.col("g") > block_grams)).select("component"), "big")
        done.append(big)
        if big.isEmpty():
            break
        open_ = comp.join(big, "component").select(F.col("node").alias("cls"), F.col("component").alias("cell"))
        finer = cells(sets.join(open_, "cls"), o)
        comp = durable(comp.join(big, "component", "left_anti").select("node", "component").unionByName(finer), "finer")
        done += [finer, comp]
    inside = comp.select(F.col("node").alias("cls"), F.col("component").alias("cell")).join(told.select("cls", "n", "n_rows"), "cls")
    inside = durable(inside, "inside")
    found = durable(compared(inside, sets, percent, orders, block, block_grams), "found")
    stars = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    linked = stars.withColumnRenamed("node", "cls")
    m = found.groupBy("cls").agg(F.sum("m").alias("m"))
    of = told.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(m, "cls", "left")
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    links = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n_rows") - 1 + F.coalesce("m", F.lit(0))).cast("long")
    of = durable(of.join(least, "component").select("t1", "t2", "n", "n_rows", "component", "component_id", links.alias("n_links")), "of")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    more = ["t1", "t2", F.when(F.col("n") > 0, F.col("component")).alias("component")] if detail else []
    result = join_counted(rows.select("doc_id", "t1", "t2"), of, ["t1", "t2"], "n_rows").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "n_links", *more)
    result = durable(result, "result")
    forget(*done, inside, found, stars, of, rows)
    return result


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
