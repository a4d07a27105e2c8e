"""Progress over time: monthly series per character.

All inputs are rollups (at most one row per catalogue entry of a character), so a window per character
is bounded by the catalogue and the calendar, not by the number of log lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlog.functions.catalogs import race_points
from questlog.operators import fighter
from questlog.operators.rankings import stuffable, top_checkpoints, top_trainers, verb_total

POINTS_PER_VALUE = 150  # fixed value: slaughter points per point of rank value


def day(c: Column | str) -> Column:
    return F.substring(c, 1, 10)


def months_between(lo: Column, hi: Column) -> Column:
    """ARRAY of 'YYYY-MM-01' from the month of lo to the month of hi."""
    first = lambda c: F.to_date(F.concat(F.substring(c, 1, 7), F.lit("-01")))
    return F.transform(F.sequence(first(lo), first(hi), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM-dd"))


def month_spine(df: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    """Every month start between the first and the last date of a key, as `date`."""
    span = df.filter(F.col(date_col).isNotNull()).groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    return span.select(*keys, F.explode(months_between(F.col("_lo"), F.col("_hi"))).alias("date"))


def _steps_and_months(steps: DataFrame, keys: list[str]) -> DataFrame:
    return steps.select(*keys, "date").unionByName(month_spine(steps, "date", keys)).distinct()


def kill_value_steps(kills: DataFrame, bestiary: DataFrame) -> DataFrame:
    """(character, date, value, creature): each time a more valuable creature was killed often enough."""
    when = F.coalesce("date_first_killed", "date_last_killed")
    rows = stuffable(kills, bestiary).filter((verb_total("killed") >= 5) & when.isNotNull() & F.col("stuffable")).withColumn("_at", when)
    before = Window.partitionBy("character").orderBy("_at", "creature").rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.max("creature_value").over(before), F.lit(0))
    return rows.withColumn("_high", high).filter(F.col("creature_value") > F.col("_high")).select(
        "character", day("_at").alias("date"), F.col("creature_value").alias("value"), "creature", "_at")


def kill_value_timeline(kills: DataFrame, bestiary: DataFrame) -> DataFrame:
    """The running best value on step dates and month starts; several steps of one day show the last one."""
    steps = kill_value_steps(kills, bestiary)
    last = steps.groupBy("character", "date").agg(F.max_by(F.struct("value", "creature"), "value").alias("s"))
    points = _steps_and_months(steps, ["character"]).join(last, ["character", "date"], "left")
    w = Window.partitionBy("character").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return points.select("character", "date", F.last("s.value", ignorenulls=True).over(w).alias("kill_value"), F.col("s.creature").alias("kill_creature"))


def rank_value_timeline(trainers: DataFrame, kill_steps: DataFrame | None = None) -> DataFrame:
    """Slaughter points / 150, growing by each trainer's points at its last rank.

    The line starts at the earliest known date (kill steps count) with the points of an untrained character;
    what no date explains is added at the latest one.
    """
    total = F.col("ranks") + F.col("modified_ranks")
    t = trainers.withColumn("points", total * fighter.rank_cost(fighter.formula_name(F.col("trainer")))).withColumn("_total", total)
    dated = t.filter("date_of_last_rank is not null and _total > 0").withColumn("date", day("date_of_last_rank"))
    per_day = dated.groupBy("character", "date").agg(F.sum("points").alias("points"))
    known = per_day.select("character", "date")
    if kill_steps is not None:
        known = known.unionByName(kill_steps.select("character", "date"))
    span = known.groupBy("character").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    rest = t.groupBy("character").agg(F.sum("points").alias("_all"))
    explained = per_day.groupBy("character").agg(F.sum("points").alias("_dated"))
    ends = span.join(rest, "character", "left").join(explained, "character", "left").withColumn(
        "_rest", F.coalesce("_all", F.lit(0)) - F.coalesce("_dated", F.lit(0)))
    start = ends.select("character", F.col("_lo").alias("date"), F.lit(0).cast("bigint").alias("points"))
    late = ends.filter(F.col("_rest") / float(POINTS_PER_VALUE) > 0.01).select("character", F.col("_hi").alias("date"), F.col("_rest").alias("points"))
    steps = per_day.unionByName(start).unionByName(late).groupBy("character", "date").agg(F.sum("points").alias("points"))
    points = _steps_and_months(steps, ["character"]).join(steps, ["character", "date"], "left")
    w = Window.partitionBy("character").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("points").over(w)  # a month start before the first step has no value yet
    return points.withColumn("_run", running).select("character", "date", F.when(
        F.col("_run").isNotNull(), F.round((F.col("_run") + race_points()) / float(POINTS_PER_VALUE) * 10) / 10).alias("rank_value"))


def _origin(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(month), -1), "yyyy-MM-dd")


def trainer_timeline(trainers: DataFrame, n: int = 10) -> DataFrame:
    """Ranks of the n top trainers by month of their last rank, cumulative, from zero one month earlier."""
    top = top_trainers(trainers, n).select("character", "trainer", "rank", "total", F.concat(F.substring("date_of_last_rank", 1, 7), F.lit("-01")).alias("_month"))
    spine = month_spine(top, "_month", ["character"])
    start = spine.groupBy("character").agg(_origin(F.min("date")).alias("date"))
    grid = spine.unionByName(start).join(top.select("character", "trainer", "rank", "total", "_month"), "character")
    return grid.select("character", "date", "trainer", "rank", F.when(F.col("date") >= F.col("_month"), F.col("total")).otherwise(0).alias("ranks"))


def studies_timeline(lastys: DataFrame) -> DataFrame:
    """Completed studies per type, counted up by completion date and carried over month starts."""
    done = lastys.filter("finished and completed is not null").select(
        "character", F.col("completed").alias("date"), "creature", "lasty_type").withColumn("_filler", F.lit(0))
    months = month_spine(done, "date", ["character"]).join(
        done.select("character", day("date").alias("date")).distinct(), ["character", "date"], "left_anti")
    months = months.select("character", "date", F.lit(None).cast("string").alias("creature"), F.lit(None).cast("string").alias("lasty_type"), F.lit(1).alias("_filler"))
    order = F.array_position(F.array(*[F.lit(t) for t in ("Movements", "Befriend", "Morph")]), F.col("lasty_type"))
    w = Window.partitionBy("character").orderBy("date", "_filler", order, "creature").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda t: F.sum(F.when(F.col("lasty_type") == t, 1).otherwise(0)).over(w)
    return done.unionByName(months).select("character", "date", "lasty_type", "creature", n("Movements").alias("movements"),
                                           n("Befriend").alias("befriends"), n("Morph").alias("morphs"))


def stats_timeline(trainers: DataFrame, trainer_meta: DataFrame) -> DataFrame:
    """Trained and effective ranks and slaughter points / 150 per month, from trainers last ranked by then."""
    rows = fighter.with_multiplier(trainers, trainer_meta).filter("date_of_last_rank is not null and total > 0").withColumn(
        "date", F.concat(F.substring("date_of_last_rank", 1, 7), F.lit("-01")))
    per_month = rows.groupBy("character", "date").agg(*fighter.linear_forms())
    points = month_spine(rows, "date", ["character"]).join(per_month.select("character", "date", "trained_ranks", "_effective", "_cost"), ["character", "date"], "left")
    w = Window.partitionBy("character").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(w)
    return points.select("character", "date", run("trained_ranks").alias("trained_ranks"),
                         F.floor(F.round(run("_effective") * 10) / 10 + F.lit(0.5).cast("decimal(2,1)")).cast("bigint").alias("effective_ranks"),
                         F.floor((run("_cost") + race_points()) / float(POINTS_PER_VALUE) + 0.5).alias("slaughter_ranks"))


def checkpoint_timeline(checkpoints: DataFrame, n: int = 10) -> DataFrame:
    """Lowest rank known per top trainer on event dates and month starts, with a flag on event dates."""
    from questlog.operators.scan import seq
    top = top_checkpoints(checkpoints, n).select("character", "trainer")
    rows = checkpoints.join(top, ["character", "trainer"]).withColumn("_ts", F.col("date")).withColumn("date", day("date"))
    last = rows.groupBy("character", "trainer", "date").agg(F.max_by("rank_min", F.struct(F.col("_ts"), seq())).alias("_rank"))
    dates = _steps_and_months(last, ["character"])
    start = dates.groupBy("character").agg(F.min(F.concat(F.substring("date", 1, 7), F.lit("-01"))).alias("_m")).select(
        "character", _origin(F.col("_m")).alias("date"))
    grid = dates.unionByName(start).join(top, "character").join(last, ["character", "trainer", "date"], "left")
    w = Window.partitionBy("character", "trainer").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("character", "trainer", "date", F.last("_rank", ignorenulls=True).over(w).alias("rank_min"),
                       F.col("_rank").isNotNull().cast("int").alias("is_event"))
