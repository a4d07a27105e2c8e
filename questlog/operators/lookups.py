"""Dimension lookups: creatures through aliases, trainers by message, canonical families and rarities.

No join here is forced to broadcast: dimensions are usually small and Spark broadcasts them when their
size is known to be; a large one falls back to a shuffled join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.grammar import SYSTEM_OTHER, _trainer_of_message


def creature_index(bestiary: DataFrame, aliases: DataFrame) -> DataFrame:
    """(log_name, value, family, rarity, source): what a name in a log stands for; aliases come first."""
    entries = bestiary.select(F.col("name").alias("_target"), "value", "family", "rarity")
    pointed = aliases.filter("resolves_to is not null").select("log_name", F.col("resolves_to").alias("_target")).join(
        entries, "_target").select("log_name", "value", "family", "rarity", F.lit("alias").alias("source"))
    inline = aliases.filter("inline is not null").select("log_name", "inline.value", "inline.family", "inline.rarity",
                                                         F.lit("inline").alias("source"))
    plain = entries.select(F.col("_target").alias("log_name"), "value", "family", "rarity", F.lit("bestiary").alias("source"))
    every = pointed.unionByName(inline).unionByName(plain)
    # one entry per name: alias and inline before the bestiary
    return every.groupBy("log_name").agg(F.min(F.struct(
        F.when(F.col("source") == "bestiary", 1).otherwise(0).alias("_p"), "source", "value", "family", "rarity")).alias("e")).select(
        "log_name", "e.value", "e.family", "e.rarity", "e.source")


def lookup_creature(df: DataFrame, bestiary: DataFrame, aliases: DataFrame, name_col: str = "creature") -> DataFrame:
    """Add value, family, rarity and source; tried with the name as it is, then without a leading 'the '."""
    index = creature_index(bestiary, aliases)
    first = index.select(F.col("log_name").alias(name_col), F.struct("value", "family", "rarity", "source").alias("_a"))
    second = index.select(F.col("log_name").alias("_bare"), F.struct("value", "family", "rarity", "source").alias("_b"))
    # names without the article need no second lookup; their key is spread so that it cannot become a hot one
    bare = F.when(F.col(name_col).startswith("the "), F.expr(f"substring({name_col}, 5)")).otherwise(
        F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(name_col), F.lit(4096)).cast("string")))
    hit = F.coalesce("_a", "_b")
    return (df.join(first, name_col, "left").withColumn("_bare", bare).join(second, "_bare", "left")
            .withColumns({"value": F.coalesce(hit["value"], F.lit(0).cast("bigint")), "family": hit["family"],
                          "rarity": hit["rarity"], "source": hit["source"]}).drop("_a", "_b", "_bare"))


def alias_violations(bestiary: DataFrame, aliases: DataFrame) -> DataFrame:
    """(log_name, problem): pointers to missing entries and names that occur twice."""
    missing = aliases.filter("resolves_to is not null").join(
        bestiary.select(F.col("name").alias("resolves_to")), "resolves_to", "left_anti").select(
        "log_name", F.lit("missing target").alias("problem"))
    twice = aliases.groupBy("log_name").agg(F.count("*").alias("n")).filter("n > 1").select("log_name", F.lit("duplicate").alias("problem"))
    return missing.unionByName(twice)


def lookup_trainer(df: DataFrame, trainer_messages: DataFrame, trainer_meta: DataFrame, text_col: str = "text") -> DataFrame:
    """Add trainer, profession and multiplier for a rank message, with or without its final period."""
    staged = df.withColumn("_body", S.trim_all(text_col)).withColumn("_m", F.col("_body")).withColumn("_rule", F.lit(SYSTEM_OTHER))
    found = _trainer_of_message(staged, trainer_messages).withColumnRenamed("_trainer", "trainer").drop("_body", "_m", "_rule", "_key", "_variants")
    meta = trainer_meta.select("trainer", "profession", F.col("multiplier").alias("_mult"))
    return found.join(meta, "trainer", "left").withColumn("multiplier", F.coalesce("_mult", F.lit(1.0))).drop("_mult")


def canonical_family(bestiary: DataFrame) -> DataFrame:
    """(family, canonical): the most frequent casing of each family, smallest text on ties."""
    counts = bestiary.filter("family is not null").groupBy("family").agg(F.count("*").alias("n")).withColumn("_low", F.lower("family"))
    chosen = counts.groupBy("_low").agg(F.min(F.struct((-F.col("n")).alias("m"), "family")).alias("b"))
    return counts.join(chosen, "_low").select("family", F.col("b.family").alias("canonical"))


def labelled(bestiary: DataFrame) -> DataFrame:
    """Bestiary entries with `family_canonical` and `rarity_canonical`."""
    fam = canonical_family(bestiary).withColumnRenamed("canonical", "family_canonical")
    return bestiary.join(fam, "family", "left").withColumn("rarity_canonical", S.canonical_rarity("rarity"))


def rarity_rank(label: Column) -> Column:
    out = None
    for i, name in enumerate(S.RARITY_ORDER):
        out = F.when(label == name, i) if out is None else out.when(label == name, i)
    return out


def bestiary_table(bestiary: DataFrame) -> DataFrame:
    return labelled(bestiary).orderBy("name")
