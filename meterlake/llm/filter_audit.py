r"""Filter interaction audit: what each of several filters removes, under every order of applying them, and its Shapley value.

Each document is known by the set of filters that it fails (a mask), and counted: documents, good ones and toxic ones of each part and mask, at
most 2^k rows a part.  The counts give the part's removal polynomial, the multilinear extension of "how many documents go": a document
goes if any filter that it fails is switched on, so with x_i for filter i

    R(x) = sum over masks m of n_m (1 - prod over i in m of (1 - x_i)) = sum over sets T of c_T prod over i in T of x_i,
    c_T = (-1)^(|T| + 1) * the number of documents that fail all of T.

A corner of the cube is a set of filters; R there says how many documents that set removes in any order, and the difference of two corners is what a
step removes.  A filter's Shapley value is the integral of its partial derivative along the diagonal, the sum of c_T / |T| over the sets
that hold it: exact rationals with the common denominator lcm(1..k), scaled by k! to the sum over all orders.  The same polynomial,
formed of the good or of the toxic documents only, gives what a step loses of them.

The text is read once; rows of 50 bytes are shuffled.  Rows that repeat are counted before any shuffle, and a text in a third of all rows is one row a task when the
least id of each text is sought.

Defined results: null text is empty; a null part is the empty string; a null doc_id has no label, is no copy, and makes no other a copy; rows with
equal ids and texts are counted each and aren't copies of each other; a document with several labels is good (toxic) if one of them says so; null
labels say nothing; texts are compared by two 64-bit hashes and are read whole, however long; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.llm.common import table, text_of

#: Fixed values of the query's contract.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
COPY = "E"
MEASURES = ("n", "good", "toxic")


def text_filters() -> dict[str, Column]:
    """When a document fails, over its ``text`` and its ``words``."""
    n = F.size("words")
    return {"A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
            "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > UPPER_PERCENT * F.length("text"), "D": F.col("text").rlike(SYMBOLS)}


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail. Bit i of the mask is the i-th of ``filters``; the bit after them says that a smaller doc_id has the same text."""
    rows = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    rows = rows.groupBy("doc_id", "part", "mask", "t1", "t2").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in MEASURES[1:]})
    # of each text: how many rows have the least id of their sort, then which sort has the least of all (few rows a text, however many copies it has)
    sort = rows.groupBy("part", "mask", "t1", "t2", "good", "toxic", F.col("doc_id").isNull().alias("unknown")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    sort = sort.withColumn("first", F.min("least").over(Window.partitionBy("t1", "t2")))
    once = F.when(F.col("unknown"), F.col("n")).when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copy = 1 << len(filters)
    split = F.explode(F.array(F.struct(F.col("mask"), once.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - once).alias("n"))))
    counted = sort.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.*")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def polynomial(counts: DataFrame, k: int) -> DataFrame:
    """part, term (a set of filters as a mask), n, good, toxic: the coefficients of the removal polynomials; ``all``: the part's documents, beside the empty term."""
    subsets = counts.select("part", "mask", *MEASURES, F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("term")).filter(F.col("term").bitwiseAND(F.col("mask")) == F.col("term"))
    sign = F.when(F.col("term") == 0, 0).when(F.bit_count("term") % 2 == 1, 1).otherwise(-1)
    return subsets.groupBy("part", "term").agg(*[F.sum(sign * F.col(c)).alias(c) for c in MEASURES], F.sum(F.when(F.col("term") == 0, F.col("n")).otherwise(0)).alias("all"))


def corners(terms: DataFrame, k: int) -> DataFrame:
    """A row a part: all, at (array by set of filters, the empty one first: n, good, toxic that the set removes)."""
    sets = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("on")).filter(F.col("term").bitwiseAND(F.col("on")) == F.col("term"))
    value = sets.groupBy("part", "on").agg(*[F.sum(c).alias(c) for c in MEASURES], F.max("all").alias("all"))
    return value.groupBy("part").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.struct("on", *MEASURES))).alias("at"))  # 2^k entries


def shapley(terms: DataFrame, k: int) -> DataFrame:
    """part, i, shapley: the integral of the i-th partial derivative along the diagonal, times k!."""
    common = math.lcm(*range(1, k + 1))
    holds = terms.select("part", "term", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).filter("shiftright(term, i) & 1 = 1")
    part = F.col("n") * F.try_divide(F.lit(common), F.bit_count("term")).cast("long")  # numerators over the common denominator
    return holds.groupBy("part", "i").agg((F.sum(part) * F.lit(math.factorial(k) // common)).alias("shapley"))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """Per part, order of ``names`` (a letter a filter, bit i of a mask the i-th) and step: filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k = len(names)
    terms = polynomial(counts, k)
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])
    rows = corners(terms, k).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = lambda c: F.instr("filter_order", c)
    rows = rows.withColumns({"before": sum((F.when(place(c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0)),
                             "i": sum((F.when(place(c) == F.col("step"), i).otherwise(0) for i, c in enumerate(names)), F.lit(0))})
    rows = rows.withColumn("bit", F.expr("shiftleft(1, i)")).withColumn("after", F.col("before") + F.col("bit"))
    gone = lambda on, c="n": F.col("at")[on][c]
    step = lambda c: gone(F.col("after"), c) - gone(F.col("before"), c)
    every = F.lit((1 << k) - 1)
    return rows.join(shapley(terms, k), ["part", "i"], "left").select(
        "part", "filter_order", "step", (F.col("all") - gone(F.col("after"))).alias("kept"), step("n").alias("removed"), (gone(F.col("bit")) - step("n")).alias("redundant"),
        (gone(every) - gone(every - F.col("bit"))).alias("unique_fails"), step("good").alias("good_lost"), step("toxic").alias("toxic_lost"), F.coalesce("shapley", F.lit(0)).cast("long").alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = text_filters()
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filters), "".join(filters) + COPY)


OP11_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
seen AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
failing AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN s.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM seen s LEFT JOIN told ON s.doc_id = told.doc_id),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT '' AS o UNION ALL SELECT o || l FROM orders, letters WHERE NOT contains(o, l)),
steps AS (SELECT o, CAST(k AS int) AS step, substr(o, CAST(k AS int), 1) AS l, substr(o, 1, CAST(k AS int) - 1) AS before FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
taken AS (SELECT part, o, step, l, n, good, toxic, contains(fails, l) AS now, length(translate(before, fails, '')) < length(before) AS gone, fails = l AS alone FROM counts, steps),
summed AS (SELECT part, o, step, l, sum(CASE WHEN NOT now AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN now AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN now AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN now AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM taken GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails,
  CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS bigint) AS shapley FROM summed
"""
