"""Best-of reports: top rows per character by aggregates (arg-max with partial results) or row_number.

Wherever the reference says "first row wins", the tie-break here is the name in ascending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.catalogs import COIN_LEVEL_MIN_KILLS, COIN_LEVEL_MIN_VALUE, SELF_INFLICTED
from questlog.functions.grammar import VERBS
from questlog.operators.rollups import ASSISTED, SOLO
from questlog.operators.scan import seq


def solo() -> Column:
    return sum((F.col(c) for c in SOLO.values()), F.lit(0).cast("bigint"))


def assisted() -> Column:
    return sum((F.col(c) for c in ASSISTED.values()), F.lit(0).cast("bigint"))


def total() -> Column:
    return solo() + assisted()


def verb_total(verb: str) -> Column:
    return F.col(SOLO[verb]) + F.col(ASSISTED[verb])


def best(metric: Column, name: str = "creature", when: Column | None = None) -> Column:
    """Aggregate: STRUCT<m, name> of the largest metric, smallest name on ties; NULL if no row qualifies.

    As a minimum over (-metric, name) it stays one partial aggregate per group.
    """
    row = F.struct((-metric).alias("m"), F.col(name).alias("name"))
    return F.min(row if when is None else F.when(when, row))


# --- checkpoints -------------------------------------------------------------------------------------------

def latest_checkpoints(checkpoints: DataFrame, order: Column | None = None) -> DataFrame:
    order = seq() if order is None else order
    return checkpoints.groupBy("character", "trainer").agg(
        F.max_by(F.struct("rank_min", "rank_max", "date"), F.struct(F.col("date"), order)).alias("c")).select(
        "character", "trainer", "c.rank_min", "c.rank_max", "c.date")


def checkpoint_history(checkpoints: DataFrame, trainer: str | None = None) -> DataFrame:
    """Ascending by date and scan order; per trainer by scan order alone."""
    if trainer is None:
        return checkpoints.orderBy("character", "date", seq())
    return checkpoints.filter(F.col("trainer") == trainer).orderBy("character", seq())


def _top(df: DataFrame, metric: Column, n: int, keys: str = "character", name: str = "trainer") -> DataFrame:
    w = Window.partitionBy(keys).orderBy(metric.desc(), F.col(name))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_checkpoints(checkpoints: DataFrame, n: int = 10) -> DataFrame:
    per = checkpoints.groupBy("character", "trainer").agg(F.max("rank_min").alias("rank_min"))
    return _top(per, F.col("rank_min"), n).drop("rank")


def top_trainers(trainers: DataFrame, n: int = 10) -> DataFrame:
    """Most ranks first, among trainers with a dated rank."""
    ranks = F.col("ranks") + F.col("modified_ranks")
    dated = trainers.filter(F.col("date_of_last_rank").isNotNull() & (ranks > 0)).withColumn("total", ranks)
    return _top(dated, F.col("total"), n)


# --- kills -------------------------------------------------------------------------------------------------

def kills_sorted(kills: DataFrame, by: str = "total", n: int | None = None) -> DataFrame:
    key = {"total": total().desc(), "solo": solo().desc(), "assisted": assisted().desc(),
           "value": F.desc("creature_value"), "name": F.asc("creature")}[by]
    out = kills.orderBy("character", key, "creature")
    if n is None:
        return out
    w = Window.partitionBy("character").orderBy(key, "creature")
    return kills.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def nemesis(kills: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    rows = kills.filter("killed_by_count > 0")
    if exclude:
        rows = rows.filter(~F.lower("creature").isin([e.lower() for e in exclude]))
    b = rows.groupBy("character").agg(best(F.col("killed_by_count")).alias("b"))
    return b.select("character", F.col("b.name").alias("creature"), (-F.col("b.m")).alias("killed_by"))


def nemesis_without_self_inflicted(kills: DataFrame) -> DataFrame:
    return nemesis(kills, SELF_INFLICTED)


def highest_kill(kills: DataFrame) -> DataFrame:
    """Largest solo kills x value."""
    b = kills.filter("creature_value > 0").groupBy("character").agg(best(solo() * F.col("creature_value")).alias("b"))
    return b.select("character", F.col("b.name").alias("creature"), (-F.col("b.m")).alias("score"))


def coin_level(kills: DataFrame, min_kills: int = COIN_LEVEL_MIN_KILLS, min_value: int = COIN_LEVEL_MIN_VALUE) -> DataFrame:
    """Highest value killed often enough by the kill verb; the interim level fills in while that is 0."""
    n, v = verb_total("killed"), F.col("creature_value")
    out = kills.groupBy("character").agg(
        F.coalesce(F.max(F.when((n >= min_kills) & (v >= min_value), v)), F.lit(0)).alias("coin_level"),
        F.coalesce(F.max(F.when((n >= 1) & (v > 0), v)), F.lit(0)).alias("_interim"))
    return out.select("character", "coin_level", F.when(F.col("coin_level") == 0, F.col("_interim")).otherwise(0).alias("coin_level_interim"))


def stuffable(kills: DataFrame, bestiary: DataFrame) -> DataFrame:
    """Kills with a `stuffable` flag: the family is known and its values are reliable."""
    from questlog.functions.catalogs import UNSTUFFABLE_FAMILY
    fam = bestiary.select(F.col("name").alias("creature"), F.col("family").alias("_family"))
    known = F.coalesce(F.col("_family"), F.lit(""))
    return kills.join(fam, "creature", "left").withColumn(
        "stuffable", (known != "") & (known != UNSTUFFABLE_FAMILY)).drop("_family")


def coin_level_stuffable(kills: DataFrame, bestiary: DataFrame, min_kills: int = COIN_LEVEL_MIN_KILLS) -> DataFrame:
    """The creature that sets the coin level among stuffable ones, and the level shown for the character."""
    b = stuffable(kills, bestiary).groupBy("character").agg(
        best(F.col("creature_value"), when=F.col("stuffable") & (verb_total("killed") >= min_kills) & (F.col("creature_value") > 0)).alias("b"))
    shown = b.join(coin_level(kills), "character")
    level = -F.col("b.m")
    return shown.select("character", F.col("b.name").alias("creature"), level.alias("stuffable_level"),
                        F.coalesce(level, F.nullif("coin_level", F.lit(0)), F.col("coin_level_interim")).alias("shown_level"))


EXTREMES = ("highest", "highest_killed", "highest_slaughtered", "highest_vanquished", "highest_dispatched",
            "highest_solo", "most_killed", "most_solo", "best_loot")


def kill_extremes(kills: DataFrame, bestiary: DataFrame) -> DataFrame:
    """All arg-max facts of a character in one aggregate: (…, <fact>, <fact>_n) columns."""
    v = F.col("creature_value")
    k = stuffable(kills, bestiary)
    facts = {
        "highest": best(v, when=(total() > 0) & (v > 0)),
        "highest_killed": best(v, when=(verb_total("killed") > 0) & F.col("stuffable") & (v > 0)),
        **{f"highest_{verb}": best(v, when=(verb_total(verb) > 0) & (v > 0)) for verb in VERBS[1:]},
        "highest_solo": best(v, when=(solo() > 0) & (v > 0)),
        "most_killed": best(total(), when=total() > 0),
        "most_solo": best(solo(), when=solo() > 0),
        "best_loot": best(F.col("best_loot_value"), when=F.col("best_loot_value") > 0),
    }
    out = k.groupBy("character").agg(*[c.alias(n) for n, c in facts.items()])
    return out.select("character", *[c for n in facts for c in (
        F.col(f"{n}.name").alias(n), (-F.col(f"{n}.m")).alias(f"{n}_n"))])


def lowest_recent(kills: DataFrame, verbs: list[str] = VERBS, n: int = 20, min_value: int = 2) -> DataFrame:
    """Per verb: the lowest value among the n creatures most recently hit by it. All verbs in one pass."""
    hits = kills.filter(F.col("creature_value") >= min_value).select("character", "creature", "creature_value", F.explode(F.array(*[
        F.struct(F.lit(v).alias("verb"), verb_total(v).alias("n"), F.col(f"date_last_{v}").alias("last")) for v in verbs])).alias("s"))
    hits = hits.filter("s.n > 0 and s.last is not null").select("character", "creature", "creature_value", "s.verb", "s.last")
    w = Window.partitionBy("character", "verb").orderBy(F.desc("last"), "creature")
    recent = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    # ties on the value go to the more recent one
    low = recent.groupBy("character", "verb").agg(F.min(F.struct("creature_value", "_rn", "creature")).alias("b"))
    return low.select("character", "verb", "b.creature", "b.creature_value")


def most_recent_kill(kills: DataFrame, roles: tuple[str, ...] = ("solo", "assisted")) -> DataFrame:
    """Per role: the creature with the latest last date, smallest name on ties."""
    count = {"solo": solo(), "assisted": assisted()}
    rows = kills.filter("date_last is not null").select("character", "creature", "date_last", F.explode(F.filter(F.array(*[
        F.when(count[r] > 0, F.lit(r)) for r in roles]), lambda r: r.isNotNull())).alias("role"))
    newest_first = (-F.unix_timestamp(F.to_timestamp("date_last"))).alias("m")
    best_row = rows.groupBy("character", "role").agg(F.min(F.struct(newest_first, "creature", "date_last")).alias("b"))
    return best_row.select("character", "role", "b.creature", "b.date_last")


def first_by_verb(kills: DataFrame) -> DataFrame:
    """Day of the first kill per verb, where there is one."""
    stacked = kills.select("character", "creature", F.explode(F.array(*[
        F.struct(F.lit(v).alias("verb"), verb_total(v).alias("n"), F.col(f"date_first_{v}").alias("d")) for v in VERBS])).alias("s"))
    return stacked.filter("s.n > 0 and s.d is not null").select(
        "character", "creature", "s.verb", S.date_only("s.d").alias("first_day"))
