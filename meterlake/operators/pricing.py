"""Token pricing: a dimension lookup of a few rates by model name, then arithmetic.

``rates`` (model, input, output, cache_read, cache_write_5m, cache_write_1h: USD a token) and ``aliases``
(alias, target; a null target is free of charge) are tables of a rate card: some hundred rows.
They are joined without a hint: a card is a small file or a local table, whose size Spark knows and broadcasts below
its own threshold, so no job is run to count it when a query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")


def usable_aliases(aliases: DataFrame) -> DataFrame:
    """Names that begin with an underscore are notes."""
    return aliases.filter(F.col("alias").isNotNull() & ~F.col("alias").startswith("_"))


def resolve(messages: DataFrame, rates: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``rate`` (struct or null) and ``free``: alias first, then the exact name, then without a date suffix."""
    card = rates.select(F.col("model").alias("__name"), F.struct(*RATES).alias("__rate"))
    a = usable_aliases(aliases).join(card.withColumnsRenamed({"__name": "target", "__rate": "__alias_rate"}), "target", "left")
    a = a.select(F.col("alias").alias("__alias"), "__alias_rate", F.col("target").isNull().alias("__free"))
    exact, bare = card.withColumnRenamed("__rate", "__exact"), card.withColumnsRenamed({"__name": "__bare_name", "__rate": "__bare"})
    m = messages.join(a, messages["model"] == F.col("__alias"), "left").join(exact, messages["model"] == F.col("__name"), "left")
    m = m.withColumn("__cut", F.regexp_replace("model", r"-[0-9]{8}$", "")).join(bare, F.col("__cut") == F.col("__bare_name"), "left")
    rate = F.when(F.col("__alias").isNotNull(), F.col("__alias_rate")).otherwise(F.coalesce("__exact", "__bare"))
    return m.select(*messages.columns, rate.alias("rate"), F.coalesce("__free", F.lit(False)).alias("free"))


def derived(rate: str = "rate") -> Column:
    """Tokens times rates; a missing rate counts as nothing."""
    return sum((F.coalesce(F.col(f"{n}_tokens"), F.lit(0)) * F.coalesce(F.col(f"{rate}.{n}"), F.lit(0.0)) for n in RATES), F.lit(0.0))


def price(messages: DataFrame, rates: DataFrame, aliases: DataFrame, version: str, priced_agent: str = "claude-code") -> DataFrame:
    """Add cost_usd, cost_source and pricing_version: what the agent reported wins, unknown prices stay null."""
    m = resolve(messages, rates, aliases)
    mine = F.col("agent") == priced_agent
    source = (F.when(F.col("reported_cost_usd").isNotNull(), "reported").when(~mine, "unknown").when(F.col("free"), "zero-rated")
              .when(F.col("rate").isNotNull(), "derived").otherwise("unknown"))
    m = m.withColumn("cost_source", source)
    cost = (F.when(F.col("cost_source") == "reported", F.col("reported_cost_usd")).when(F.col("cost_source") == "zero-rated", 0.0)
            .when(F.col("cost_source") == "derived", derived()))
    stamped = F.when(F.col("cost_source").isin("derived", "zero-rated"), F.lit(version))
    return m.withColumn("cost_usd", cost).withColumn("pricing_version", stamped).drop("rate", "free")
