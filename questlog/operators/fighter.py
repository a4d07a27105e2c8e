"""Fighter statistics and profession detection from trainer ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.functions.catalogs import (BASE_CLASSES, DECAY_TRAINERS, FORMULA_NAMES, RACE_BASE, RANK_COSTS, SPECIALISATIONS,
                                         STAT_COEFFICIENTS, UNKNOWN_RANK_COST, race_points)

STATS = list(STAT_COEFFICIENTS)


def formula_name(trainer: Column) -> Column:
    out = None
    for alias, name in FORMULA_NAMES.items():
        out = F.when(trainer == alias, F.lit(name)) if out is None else out.when(trainer == alias, F.lit(name))
    return out.otherwise(trainer)


def coefficient(trainer: Column, stat: str) -> Column:
    """Points of `stat` per rank; other trainers add nothing. The table is small enough to be a CASE."""
    out = None
    for name, c in STAT_COEFFICIENTS[stat].items():
        out = F.when(trainer == name, c) if out is None else out.when(trainer == name, c)
    return out.otherwise(0)


def rank_cost(trainer: Column, unknown_cost: int = UNKNOWN_RANK_COST) -> Column:
    out = None
    for name, c in RANK_COSTS.items():
        out = F.when(trainer == name, c) if out is None else out.when(trainer == name, c)
    return out.otherwise(unknown_cost)


def linear_forms(unknown_cost: int = UNKNOWN_RANK_COST) -> list[Column]:
    """Aggregates over (trainer, total, multiplier): the ten linear forms, ranks, and slaughter points.

    Multipliers are summed as decimals, so the result does not depend on the order of the rows.
    """
    name, n = formula_name(F.col("trainer")), F.col("total")
    return [F.sum(n * coefficient(name, s)).alias(s) for s in STATS] + [
        F.sum(n).alias("trained_ranks"), F.sum(n * F.col("multiplier").cast("decimal(12,6)")).alias("_effective"),
        F.sum(n * rank_cost(name, unknown_cost)).alias("_cost")]


def derive(df: DataFrame) -> DataFrame:
    """From the linear forms to the shown statistics; integer divisions truncate."""
    base = df.withColumns({s: F.col(s) + b for s, b in RACE_BASE.items() if s in df.columns})
    base = base.withColumn("spirit_regen", F.lit(RACE_BASE["spirit_regen"]).cast("bigint"))
    offense = F.col("accuracy") + F.expr("(3 * damage_max + damage_min) div 4")
    drain = F.when(F.col("heen") < 50, F.round((1066 * 49 - 436 * F.col("heen")) / F.lit(49.0))).otherwise(
        F.round(F.lit(628.0 * 50) / F.col("heen")))
    out = base.withColumn("offense", offense)
    return out.withColumns({
        "effective_ranks": (F.round(F.col("_effective") * 10) / 10).cast("double"), "slaughter_points": F.col("_cost") + race_points(),
        "balance_per_swing": F.expr("(5 * greatest(offense, 200)) div 3"), "shieldstone_drain": drain.cast("bigint"),
        "health_per_frame": F.col("health_regen") / 100.0, "balance_per_frame": F.col("balance_regen") / 6.0,
        "spirit_per_frame": F.col("spirit_regen") / 100.0,
        "damage_min": F.greatest(F.col("damage_min"), F.lit(0)) + 100, "damage_max": F.greatest(F.col("damage_max") * 3, F.lit(0)) + 100,
    }).drop("_effective", "_cost", "heen")


def with_multiplier(trainers: DataFrame, trainer_meta: DataFrame) -> DataFrame:
    meta = trainer_meta.select("trainer", F.col("multiplier").alias("_m"))
    return trainers.join(meta, "trainer", "left").select(
        "character", "trainer", (F.col("ranks") + F.col("modified_ranks")).alias("total"),
        F.coalesce("_m", F.lit(1.0)).alias("multiplier"), "date_of_last_rank")


def fighter_stats(trainers: DataFrame, trainer_meta: DataFrame, unknown_cost: int = UNKNOWN_RANK_COST) -> DataFrame:
    rows = with_multiplier(trainers, trainer_meta)
    return derive(rows.groupBy("character").agg(*linear_forms(unknown_cost)))


def detect_profession(trainers: DataFrame, trainer_meta: DataFrame) -> DataFrame:
    """Profession by ranks: any specialisation beats the base classes; decay ranks count against theirs."""
    t = trainers.join(trainer_meta.select("trainer", "profession"), "trainer", "left")
    total, name = F.col("ranks") + F.col("modified_ranks"), F.col("trainer")
    decays = list(DECAY_TRAINERS)
    plain = ~name.isin(decays) & (total > 0)
    aggs = [F.coalesce(F.sum(F.when(plain & (F.col("profession") == p), total)), F.lit(0)).alias(p) for p in BASE_CLASSES + SPECIALISATIONS]
    aggs += [F.max(F.when(plain & (F.col("profession") == p), F.col("date_of_last_rank"))).alias(f"{p}_last") for p in SPECIALISATIONS]
    aggs += [F.coalesce(F.sum(F.when(name == d, total)), F.lit(0)).alias(f"{p}_decay") for d, p in DECAY_TRAINERS.items()]
    s = t.groupBy("character").agg(*aggs)
    # ordering per candidate: most ranks, then latest rank (none is earliest), then the fixed order
    spec = F.array(*[F.struct(
        F.greatest(F.col(p) - F.col(f"{p}_decay"), F.lit(0)).alias("n"), F.coalesce(f"{p}_last", F.lit("")).alias("last"),
        F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(SPECIALISATIONS)])
    base = F.array(*[F.struct(F.col(p).alias("n"), F.lit("").alias("last"), F.lit(-i).alias("i"), F.lit(p).alias("p"))
                     for i, p in enumerate(BASE_CLASSES)])
    top_spec, top_base = F.array_max(spec), F.array_max(base)
    return s.select("character", F.when(top_spec["n"] > 0, top_spec["p"]).when(top_base["n"] > 0, top_base["p"]).otherwise(
        F.lit("Unknown")).alias("detected"))


def final_profession(characters: DataFrame, detected: DataFrame, announced: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Manual override, announced or detected specialisation, announced base class, detected base class."""
    c = characters.select("character").join(detected, "character", "left").join(announced, "character", "left")
    if overrides is not None:
        c = c.join(overrides.select("character", "profession_override"), "character", "left")
    else:
        c = c.withColumn("profession_override", F.lit(None).cast("string"))
    said, found = F.coalesce("announced", F.lit("Unknown")), F.coalesce("detected", F.lit("Unknown"))
    return c.select("character", F.when(F.col("profession_override").isNotNull(), F.col("profession_override"))
                    .when(said.isin(SPECIALISATIONS), said).when(found.isin(SPECIALISATIONS), found)
                    .when(said != "Unknown", said).otherwise(found).alias("profession"))
