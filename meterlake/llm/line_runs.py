r"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z in lower case.  A run is a table of (two 64-bit hashes of a key, how many documents hold
it, the largest doc_id among these), one row a key, bucketed and sorted by hash.  Documents come in batches.  Each batch counts its own keys, merge-anti-joins
every run, so that a key which a run shows to be in enough documents (and in a larger one than any of this batch) is neither written nor counted again, and adds what is
left as a run of level 0.  ``FANOUT`` runs of one level are compacted to one of the next, where the counts of a key meet.  Runs and batches lie in the same
buckets, so runs are never shuffled again.

The query takes the documents in batches of descending doc_id: then a key's last holder is in the first run that has it.
Batches are bounded by quantiles of doc_id; where these lie changes no result.

When all batches are in, the keys that enough documents hold meet the lines (a join that adaptive execution splits where one line is in a third of all documents;
the keys' side has one row a key), and give each document the places of the lines that go.  Texts are read twice and shuffled once; in between a line is 20 bytes.

Defined results: null and empty text is one empty line; a line of fewer than ``LEAST_CHARS`` code points (as a key) always stays; a line that one document repeats is in one document, and all of
its lines go or stay together; rows that share a doc_id are one document for the counts, and each has its own result; a row without doc_id holds no key and keeps all its lines; ``\r``
is white space at a line's end and is kept in lines that stay; keys are known by two 64-bit hashes; long texts are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import durable, forget, remove, shared_dir, table, text_of

#: Fixed values of the query's contract.
LEAST_CHARS, LEAST_DOCS, WHITE = 20, 3, "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of a level that are made one; batches at least; rows of documents in a batch beyond that.
FANOUT, BATCHES, BATCH_ROWS = 3, 4, 1 << 28


class Runs:
    """The runs of one corpus, in the folder that all executors share."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/meterlake/{name}"

    def _write(self, df: DataFrame) -> str:
        name = f"meterlake_run_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self._path(name)).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self._path(name))

    def add(self, held: DataFrame) -> None:
        """A batch: h1, h2, doc_id, with repeats. A document is in one batch only."""
        own = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        for name in self.names():
            run = self.spark.table(name).filter(F.col("n") >= self.least).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("top").alias("seen")).hint("merge")
            own = own.join(run, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("seen") >= F.col("top")), "left_anti")
        self.levels[0].append(self._write(own))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(self.levels[level])))
            self._drop(self.levels[level])
            self.levels[level] = []
            level += 1

    def names(self) -> list[str]:
        return [n for level in reversed(self.levels) for n in level]

    def _merged(self, names: list[str]) -> DataFrame:
        # read as plain files: a union of tables in equal buckets passes for partitioned by them, and its rows aren't
        out = self.spark.read.schema("h1 bigint, h2 bigint, n bigint, top bigint").parquet(*map(self._path, names))
        return out.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def common(self) -> DataFrame:
        """h1, h2, n, top of the keys in at least ``least`` documents; n stops growing there."""
        return self._merged(self.names()).filter(F.col("n") >= self.least)

    def close(self) -> None:
        self._drop(self.names())
        self.levels = [[]]


def line_keys(text: Column, least: int = LEAST_CHARS) -> Column:
    """Of the lines whose key is long enough: pos (from 0), and two hashes of the key."""
    # only A-Z change; lower() does the same, and faster, where all is ASCII
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    keys = F.transform(F.split(plain, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(WHITE)).alias("key")))
    return F.transform(F.filter(keys, lambda k: F.length(k["key"]) >= least),
                       lambda k: F.struct(k["pos"].alias("pos"), F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(7), k["key"]).alias("h2")))


def in_batches(docs: DataFrame, batches: int) -> Column:
    """Number of a row's batch, from the largest doc_ids down; bounds are quantiles of doc_id."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    return sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in sorted({int(c) for c in cuts})), F.lit(0))


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, kept (text without the lines that go), n_lines, n_dropped."""
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_ROWS))
    keyed = rows.filter("doc_id IS NOT NULL").select("doc_id", "t1", "t2", in_batches(docs, batches).alias("batch"), line_keys(F.col("text"), least_chars).alias("keys")).filter(F.size("keys") > 0)
    runs = Runs(spark, least_docs, fanout)
    deal = F.pmod(F.xxhash64("t1", "doc_id"), F.lit(-(-runs.buckets // batches)))
    lines = durable(keyed.repartition(runs.buckets, "batch", deal), "lines", by="batch")
    try:
        for b in range(batches):
            runs.add(lines.filter(F.col("batch") == b).select("doc_id", F.explode(F.transform("keys", lambda k: F.struct(k["h1"], k["h2"]))).alias("k")).select("k.*", "doc_id"))
        common = durable(runs.common(), "common")
    finally:
        runs.close()
    placed = lines.select("doc_id", "t1", "t2", F.explode("keys").alias("k")).select("doc_id", "t1", "t2", "k.*")
    go = placed.join(common.select("h1", "h2", "top"), ["h1", "h2"]).filter("doc_id < top").groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    go = durable(go, "gone")
    forget(lines, common)
    met = rows.join(go, ["doc_id", "t1", "t2"], "left").withColumn("lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return met.select("doc_id", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ 	-
]+', ''), '[ 	-
]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE doc_id IS NOT NULL AND length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, coalesce(k.doc_id < c.top, false) AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS bigint) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
