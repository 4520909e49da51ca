r"""Hard-negative mining by product quantisation with stored residual norms.

A vector's components become integers, floor(256 x); a row's score for an anchor is their integer inner product.  A row is stored as codes (for every ``WIDTH`` components the nearest of
``CENTRES`` trained centres) and the length of what each code leaves over, rounded up.  For an anchor a and a row v,

    sum over parts of table[part, code]  +-  sum over parts of |a_part| * residual_part

bounds the score on both sides (Cauchy-Schwarz in every part), whatever the centres are, so the filter loses nothing.  Within a block of rows the k-th best lower bound says
which upper bounds can still be among the first k; only these are scored exactly, in integers.

Two passes of anchor blocks against row blocks, each pair of blocks a task of bounded size: the first finds each anchor's positives (the best rows of its label), the second
its negatives, the best rows of other labels in the window below each positive's score.  Blocks give the first few rows of each anchor (and positive), which are then ranked over all blocks.
Labels are no partition key, so one that holds a third of all rows is dealt out like any other.

The centres are fitted to the ``SAMPLE`` rows with the smallest hashes, for every length of which the sample holds ``CENTRES`` rows; rows of other lengths have a single centre, zero, and their own length as the residual.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; vectors of different lengths have no score and aren't compared; the empty vector scores 0;
integers stop at +-2^24 (|x| = 65,536), so that scores fit 64 bits; of rows that share a vec_id the least (label, vector) is the anchor, and as candidates they are one row, with
their best score (for a negative: in the window), that is never a candidate of the anchor of that id; a positive with a score below 0 has an empty window;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.common import durable, forget, ship, table

#: Fixed values of the query's contract.
SCALE, FIRST, LEAST_PERCENT, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 5, 80, 100, 7, 10
#: Components a code stands for, centres of each part, rows that they are fitted to at most, rounds of fitting.
WIDTH, CENTRES, SAMPLE, ROUNDS = 4, 256, 4096, 8
#: Rows and anchors in a block; blocks of rows at least; pairs that are bounded at once.
ROWS, ANCHORS, LEAST_BLOCKS, PAIRS = 16_384, 2_048, 64, 1 << 21
LIMIT = 1 << 24

Books = dict[int, np.ndarray]


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, dim, q (integers) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    rows = rows.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = lambda x: F.greatest(F.least(F.floor(F.least(x, F.lit(float(LIMIT))) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return rows.select("vec_id", "label", F.size("vec").alias("dim"), F.transform("vec", lambda x: whole(F.greatest(x, F.lit(-float(LIMIT))))).alias("q"))


def parts(x: np.ndarray) -> np.ndarray:
    """(n, dim) as (n, parts, WIDTH), filled up with zeros."""
    n, dim = x.shape
    m = -(-dim // WIDTH)
    out = np.zeros((n, m * WIDTH))
    out[:, :dim] = x
    return out.reshape(n, m, WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def fitted(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of each part, (parts, CENTRES, WIDTH), by Lloyd's rounds from evenly spaced rows."""
    p = parts(x)
    books = p[np.linspace(0, len(x) - 1, CENTRES).astype(int)].transpose(1, 0, 2).copy()
    for s, centres in enumerate(books):
        for _ in range(rounds):
            code = _nearest(p[:, s], centres)
            n = np.bincount(code, minlength=CENTRES)
            for d in range(WIDTH):
                total = np.bincount(code, weights=p[:, s, d], minlength=CENTRES)
                centres[:, d] = np.where(n > 0, total / np.maximum(n, 1), centres[:, d])
    return books


def train(rows: DataFrame, sample: int = SAMPLE) -> Books:
    """Centres by length of vector, from the ``sample`` rows with the smallest hashes."""
    took = rows.select("dim", "q", F.xxhash64("vec_id", "q").alias("at")).orderBy("at", "q").limit(sample).collect()
    by: dict[int, list[list[int]]] = {}
    for r in took:
        by.setdefault(r["dim"], []).append(r["q"])
    return {dim: fitted(np.array(x, dtype=np.float64)) for dim, x in by.items() if dim and len(x) >= CENTRES}


def book_of(books: Books, dim: int) -> np.ndarray:
    return books.get(dim, np.zeros((-(-dim // WIDTH), 1, WIDTH)))


def _matrix(t: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    q = t.column("q")
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dim)


def encoded(rows: DataFrame, books: Books) -> DataFrame:
    """Adds codes (a byte a part) and left (what each code leaves over, as 32-bit floats rounded up), and spot, by which rows are dealt into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes, left = [b""] * len(dims), [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, book = parts(_matrix(b.take(pa.array(at)), dim).astype(np.float64)), book_of(books, dim)
                code = np.empty(x.shape[:2], dtype=np.uint8)
                rest = np.empty(x.shape[:2])
                for s in range(x.shape[1]):
                    code[:, s] = _nearest(x[:, s], book[s])
                    rest[:, s] = np.linalg.norm(x[:, s] - book[s][code[:, s]], axis=1)
                up = np.nextafter((rest * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))
                for i, c, r in zip(at.tolist(), code, up):
                    codes[i], left[i] = c.tobytes(), r.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(left, pa.binary())], names=[*b.schema.names, "codes", "left"])

    spot = F.xxhash64("vec_id", "q", F.monotonically_increasing_id())
    return rows.withColumn("spot", spot).mapInArrow(run, "vec_id bigint, label bigint, dim int, q array<int>, spot bigint, codes binary, left binary")


class Block:
    """Rows of one block and length, and bounds of their scores for some anchors at a time."""

    def __init__(self, t: pa.Table, dim: int, books: Books) -> None:
        self.book, self.dim, n = book_of(books, dim), dim, t.num_rows
        m = len(self.book)
        self.id, self.label = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        self.q = _matrix(t, dim)
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(n, m)
        self.left = np.frombuffer(b"".join(t.column("left").to_pylist()), np.float32).reshape(n, m).astype(np.float64)
        self.length = np.linalg.norm(self.q.astype(np.float64), axis=1)
        self.once = np.zeros(n, dtype=bool)  # one row of each id
        self.once[np.unique(self.id, return_index=True)[1]] = True

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of every row for each of the anchors ``q``."""
        a = parts(q.astype(np.float64))
        tables = np.einsum("asw,skw->ask", a, self.book)
        middle = np.zeros((len(q), len(self.id)))
        for s in range(a.shape[1]):
            middle += tables[:, s, :][:, self.codes[:, s]]
        slack = np.linalg.norm(a, axis=2) @ self.left.T + 1e-3 + 1e-12 * np.linalg.norm(q.astype(np.float64), axis=1)[:, None] * self.length
        return middle - slack, middle + slack

    def exact(self, q: np.ndarray, who: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(who), dtype=np.int64)
        for at in range(0, len(who), PAIRS // 8):
            part = slice(at, at + PAIRS // 8)
            out[part] = np.einsum("ij,ij->i", q[who[part]], self.q[row[part]])
        return out


def kth_best(bound: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Per anchor the k-th largest of ``bound`` at ``among``; -inf where there are fewer."""
    if bound.shape[1] < k:
        return np.full(len(bound), -np.inf)
    return -np.partition(np.where(among, -bound, np.inf), k - 1, axis=1)[:, k - 1]


def first_rows(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` ids of every group, best score and then least id first, each id once."""
    order = np.lexsort((ids, -score, group))
    g, i = group[order], ids[order]
    # an id's further rows in its group
    back = np.lexsort((np.arange(len(order)), i, g))
    again = np.zeros(len(order), dtype=bool)
    again[back[1:]] = (g[back][1:] == g[back][:-1]) & (i[back][1:] == i[back][:-1])
    order, g = order[~again], g[~again]
    begin = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < k]


def _chunks(n: int, rows: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(1, rows))
    return (slice(a, a + step) for a in range(0, n, step))


def best_of_label(anchors: pa.Table, rows: pa.Table, dim: int, books: Books, k: int) -> pa.Table:
    """anchor_id, id, score: each anchor's first rows of its label in this block."""
    block, q = Block(rows, dim, books), _matrix(anchors, dim)
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c in _chunks(len(ids), len(block.id)):
        low, high = block.bounds(q[c])
        mine = (block.label == labels[c][:, None]) & (block.id != ids[c][:, None])
        who, row = np.nonzero(mine & (high >= kth_best(low, mine & block.once, k)[:, None]))
        score = block.exact(q[c], who, row)
        at = first_rows(who, score, block.id[row], k)
        out.append((ids[c][who[at]], block.id[row[at]], score[at]))
    return _table(out, ("anchor_id", "id", "score"))


def best_in_windows(anchors: pa.Table, rows: pa.Table, dim: int, books: Books, k: int) -> pa.Table:
    """anchor_id, place, id, score: each anchor's first rows of other labels in this block, in the window of each of its positives (``scores``, by place)."""
    block, q = Block(rows, dim, books), _matrix(anchors, dim)
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    wide = max(map(len, anchors.column("scores").to_pylist()))
    top = np.array([s + [-1] * (wide - len(s)) for s in anchors.column("scores").to_pylist()], dtype=np.int64)  # below 0: no window
    out: list[tuple[np.ndarray, ...]] = []
    for c in _chunks(len(ids), len(block.id)):
        low, high = block.bounds(q[c])
        other = (block.label != labels[c][:, None]) & (block.id != ids[c][:, None])
        wanted = np.zeros(other.shape, dtype=bool)
        for place in range(wide):
            t = top[c, place][:, None]
            least = -(-LEAST_PERCENT * t // 100)
            sure = other & block.once & (low >= least) & (high <= t)
            wanted |= other & (t >= 0) & (high >= np.maximum(least, kth_best(low, sure, k)[:, None])) & (low <= t)
        who, row = np.nonzero(wanted)
        score = block.exact(q[c], who, row)
        for place in range(wide):
            t = top[c, place][who]
            inside = np.flatnonzero((t >= 0) & (score <= t) & (100 * score >= LEAST_PERCENT * t))
            at = inside[first_rows(who[inside], score[inside], block.id[row[inside]], k)]
            out.append((ids[c][who[at]], np.full(len(at), place), block.id[row[at]], score[at]))
    return _table(out, ("anchor_id", "place", "id", "score"))


def _table(out: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64), pa.int64()) for i, n in enumerate(names)})


def in_blocks(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], books: Books, find: Callable[..., pa.Table], k: int, schema: str) -> DataFrame:
    """``find`` of every block of anchors and every block of rows of their length."""
    a, b = sizes
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("i", F.pmod("spot", F.lit(b)).cast("int")).drop("spot").withColumn("j", spread(a))
    right = anchors.withColumn("j", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(a)).cast("int")).withColumn("i", spread(b))
    names = tuple(x.split()[0] for x in schema.split(", "))

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, theirs: pa.Table) -> pa.Table:
        return find(theirs, mine, key[0].as_py(), books, k) if mine.num_rows and theirs.num_rows else _table([], names)

    return left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(run, schema)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` ids of every ``by``, with their rank from 1."""
    once = found.groupBy(*by, "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, k: int = FIRST, books: Books | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of rows (vec_id, label, dim, q)."""
    ship(rows.sparkSession)
    books = train(rows) if books is None else books
    kept = durable(encoded(rows, books), "encoded")
    anchors = kept.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "q")).alias("a")).select("vec_id", "a.*")
    anchors = durable(anchors, "anchors")
    sizes = max(1, -(-anchors.count() // ANCHORS)), max(LEAST_BLOCKS, -(-kept.count() // ROWS))
    near = in_blocks(anchors, kept, sizes, books, best_of_label, k, "anchor_id bigint, id bigint, score bigint")
    positives = durable(ranked(near, ["anchor_id"], k).select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))  # k of an anchor
    asked = anchors.join(scores, anchors["vec_id"] == scores["anchor_id"]).drop("anchor_id")
    found = in_blocks(asked, kept, sizes, books, best_in_windows, k, "anchor_id bigint, place bigint, id bigint, score bigint")
    negatives = durable(ranked(found, ["anchor_id", "place"], k), "negatives")
    forget(kept, anchors)
    return negatives.join(positives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, r.vec_id AS other, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS bigint) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS int) AS rank, s.other AS negative_id,
  p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""
