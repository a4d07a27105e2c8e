"""Merged characters: reports over a character and those merged into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlog.functions.grammar import VERBS
from questlog.operators.rollups import COUNTERS


def merge_map(characters: DataFrame) -> DataFrame:
    """(name, target): a character reports to itself or to what it is merged into, one level deep.

    A character whose target is itself merged drops out of every report.
    """
    c = characters.select(F.col("character").alias("name"), "merged_into")
    gone = c.filter("merged_into is not null").select(F.col("name").alias("merged_into"))
    own = c.filter("merged_into is null").select("name", F.col("name").alias("target"))
    moved = c.filter("merged_into is not null").join(gone, "merged_into", "left_anti").select("name", F.col("merged_into").alias("target"))
    return own.unionByName(moved)


def merge_sources(characters: DataFrame, target: str) -> DataFrame:
    return characters.filter(F.col("merged_into") == target).select("character").orderBy("character")


def find_character(characters: DataFrame, name: str) -> DataFrame:
    return characters.filter(F.col("character") == name).select("character", "merged_into")


def _retarget(df: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("name").alias("character"), "target")
    return df.join(m, "character").withColumn("_own", F.col("character") == F.col("target"))


def merged_kills(kills: DataFrame, mapping: DataFrame) -> DataFrame:
    k = _retarget(kills, mapping)
    aggs = [F.sum(c).alias(c) for c in [*COUNTERS, "killed_by_count"]]
    aggs += [F.min("date_first").alias("date_first"), F.max("date_last").alias("date_last"), F.max("creature_value").alias("creature_value")]
    aggs += [F.min(f"date_first_{v}").alias(f"date_first_{v}") for v in VERBS] + [F.max(f"date_last_{v}").alias(f"date_last_{v}") for v in VERBS]
    if "best_loot_value" in kills.columns:
        aggs += [F.coalesce(F.max("best_loot_value"), F.lit(0)).alias("best_loot_value"),
                 F.coalesce(F.min(F.struct((-F.coalesce("best_loot_value", F.lit(0))).alias("m"), "best_loot_item"))["best_loot_item"],
                            F.lit("")).alias("best_loot_item")]
    return k.groupBy(F.col("target").alias("character"), "creature").agg(*aggs)


def merged_trainers(trainers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sums; mode, cutoff and notes come from the target's own row."""
    t = _retarget(trainers, mapping)
    own = lambda c: F.max(F.when(F.col("_own"), F.col(c))).alias(c)
    return t.groupBy(F.col("target").alias("character"), "trainer").agg(
        *[F.sum(c).alias(c) for c in ("ranks", "modified_ranks", "apply_learning_ranks", "apply_learning_unknown_count")],
        F.max("date_of_last_rank").alias("date_of_last_rank"),
        F.coalesce(F.max(F.when(F.col("_own"), F.col("rank_mode"))), F.lit("modifier")).alias("rank_mode"),
        own("override_date"), F.max("effective_multiplier").alias("effective_multiplier"), own("notes"))


def merged_pets(pets: DataFrame, mapping: DataFrame) -> DataFrame:
    return _retarget(pets, mapping).groupBy(F.col("target").alias("character"), "pet_name").agg(F.min("creature").alias("creature"))


def merged_lastys(lastys: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per creature and type (grouping by the creature alone would mix the types)."""
    return _retarget(lastys, mapping).groupBy(F.col("target").alias("character"), "creature", "lasty_type").agg(
        F.max("finished").alias("finished"), F.sum("message_count").alias("message_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.max("completed").alias("completed"), F.max("abandoned").alias("abandoned"))


def merged_characters(characters: DataFrame, mapping: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Sums of every counter, earliest start date, catches of fish added up by kind.

    A coin level is no counter: `levels(character, coin_level)`, computed over the merged kills, gives that of each target.
    """
    skip = {"character", "merged_into", "start_date", "profession", "coin_level"}
    counters = [c for c, t in characters.dtypes if t in ("bigint", "int") and c not in skip]
    aggs = [F.sum(c).alias(c) for c in counters]
    if "start_date" in characters.columns:
        aggs.append(F.min("start_date").alias("start_date"))
    rows = _retarget(characters, mapping)
    out = rows.groupBy(F.col("target").alias("character")).agg(*aggs, F.count("*").alias("members"))
    if "fishing_catches" in characters.columns:
        kinds = rows.select(F.col("target").alias("character"), F.explode("fishing_catches").alias("fish", "n")).groupBy("character", "fish").agg(F.sum("n").alias("n"))
        catches = kinds.groupBy("character").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fish", "n")))).alias("fishing_catches"))
        out = out.join(catches, "character", "left")
    return out if levels is None else out.join(levels.select("character", "coin_level"), "character", "left")


def merge_violations(requests: DataFrame, characters: DataFrame, trainers: DataFrame) -> DataFrame:
    """(source, target, reason) for each rule a merge request breaks."""
    c = characters.select("character", "merged_into")
    source = c.select(F.col("character").alias("source"), F.lit(True).alias("_s"), F.col("merged_into").alias("_s_into"))
    target = c.select(F.col("character").alias("target"), F.lit(True).alias("_t"), F.col("merged_into").alias("_t_into"))
    modes = trainers.filter("rank_mode <> 'modifier'").select("character").distinct()
    r = (requests.join(source, "source", "left").join(target, "target", "left")
         .join(modes.select(F.col("character").alias("source"), F.lit(True).alias("_s_mode")), "source", "left")
         .join(modes.select(F.col("character").alias("target"), F.lit(True).alias("_t_mode")), "target", "left"))
    checks = [
        (F.col("_t").isNull(), "unknown target"), (F.col("_t_into").isNotNull(), "target is merged"),
        (F.coalesce("_t_mode", F.lit(False)), "target has rank overrides"), (F.col("source") == F.col("target"), "merge into itself"),
        (F.coalesce("_s_mode", F.lit(False)), "source has rank overrides"), (F.col("_s").isNull(), "unknown source"),
        (F.col("_s_into").isNotNull(), "source is merged"),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))
    return r.select("source", "target", F.explode(reasons).alias("reason"))
