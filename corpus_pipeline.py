"""The corpus pipeline: stages of meterlake.llm, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import bpe, jaccard, langid, mixing, secret_scan
from meterlake.llm.common import WORD, durable, table
from meterlake.llm.tally import digested

#: Below this calibrated score no language is accepted.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no learned language fits, go.

    Null and empty texts go (they have no letters); a null lang is never learned from and judged like any other; repeated rows are judged each, alike; very long
    texts are judged whole; an empty table, or one without labels, keeps none; other columns, whatever their names, stay as they are.
    """
    judged = langid.predict(docs.select(F.struct(*docs.columns).alias("kept"), "doc_id", "text"), langid.train(docs))
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("kept.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays (one without an id only where none has one; of equal ids the one with the least hash of its text).

    Documents without words (null or empty text) are in no group and stay; of rows that repeat id and text one stays; an empty table gives no rows;
    other columns, whatever their names, stay as they are.
    """
    j = jaccard.join(docs, detail=True)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    first = j.filter("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("p")).select("p.doc_id", "p.t1", "p.t2")
    stay = first.unionByName(j.filter("component IS NULL").select("doc_id", "t1", "t2"))
    # rows that repeat id and text are few as a rule; only these are gathered to keep one of each
    many = j.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("rows"))
    stay = durable(stay.distinct().join(many.withColumnsRenamed({"doc_id": "i", "t1": "u", "t2": "v"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("u")) & (F.col("t2") == F.col("v"))).select("doc_id", "t1", "t2", "rows"), "stay")
    d = digested(docs, F.struct(*docs.columns).alias("kept"), F.col("doc_id").cast("long").alias("id")).drop("text")

    def found(part: DataFrame) -> DataFrame:
        return d.join(part, (d["t1"] == part["t1"]) & (d["t2"] == part["t2"]) & d["id"].eqNullSafe(part["doc_id"]), "left_semi")

    one = found(stay.filter("rows = 1")).select("kept.*")
    again = stay.filter("rows > 1")
    return one if again.isEmpty() else one.unionByName(found(again).dropDuplicates(["id", "t1", "t2"]).select("kept.*"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; all documents stay.

    A null text stays null; repeated rows change alike; a null source counts as one; n_chars is that of the new text (null for null); an empty table gives no rows; other columns stay.
    """
    clean = secret_scan.redact(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text becomes the words that the mix takes of it, repeats included; documents of which it takes none go.

    Null and empty texts hold no words and go; a null source is one of its own; repeated rows are mixed each; whole rounds repeat the text as it is,
    parts are words joined by a space; an empty table gives no rows; other columns, whatever their names, stay as they are.
    """
    mixed = mixing.mix(docs, keep=docs.columns).filter("taken > 0")
    words = F.regexp_extract_all("kept.text", F.lit(WORD), F.lit(0))

    def part(x: Column) -> Column:
        return F.array_join(F.slice("words", x["from"].cast("int") + 1, (x["to"] - x["from"]).cast("int")), " ")

    cut = mixed.withColumn("words", F.when(F.size("extra") > 0, words))
    text = F.array_join(F.concat(F.array_repeat("kept.text", F.col("rounds").cast("int")), F.transform("extra", part)), "\n")
    cut = cut.select("kept", text.alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return cut.select(*[new.get(c, F.col("kept")[c]).alias(c) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of the bytes that they decode to.

    A null text counts as empty and has no ids; repeated rows are coded each; very long texts are coded in pieces with equal results; an empty table gives no rows;
    of other columns only lang and source are returned.
    """
    spec = bpe.default_spec()
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), spec, bytes_col="decoded")
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing", mix_sources),
    ("byte_level_bpe", byte_bpe),
]

#: The classifier is fitted, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
