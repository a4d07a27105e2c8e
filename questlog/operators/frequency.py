"""Best day and best two hours per creature, from hour buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questlog.functions.grammar import VERBS
from questlog.operators.rollups import ASSISTED, SOLO

TWO_HOURS = 7_200
HOURS_PER_TASK = 200_000


def kill_frequency(hourly: DataFrame, merge_map: DataFrame | None = None, include_assisted: bool = True) -> DataFrame:
    """Per (character, creature): the day and the span of under two hours with most kills, with verb counts.

    `hourly` is a table, as its rows are counted first. Buckets of merged characters are summed first. Days are sums of hours; a window, of one frame of at most two rows, holds the hours of one creature of one
    character: bounded by the calendar, whatever the number of kills.
    """
    tasks = max(1, -(-hourly.count() // HOURS_PER_TASK))
    if merge_map is not None:
        m = merge_map.select(F.col("name").alias("character"), "target")
        hourly = hourly.join(m, "character").drop("character").withColumnRenamed("target", "character")
    per_verb = {v: F.sum(F.col(SOLO[v]) + (F.col(ASSISTED[v]) if include_assisted else F.lit(0))) for v in VERBS}
    keys = ["character", "creature"]
    # one shuffle: days, spans and the best of both are sums inside the partition of a creature; partitions of the same size, whatever the input, bound a task's memory
    hours = hourly.repartition(tasks, *keys).groupBy(*keys, "hour").agg(*[c.alias(v) for v, c in per_verb.items()])
    total = sum((F.col(v) for v in VERBS), F.lit(0))
    hours = hours.withColumn("n", total).withColumn("day", F.substring("hour", 1, 10)).withColumn(
        "at", F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.concat("hour", F.lit(":00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0)))
    verbs = F.struct(*VERBS)
    days = hours.groupBy(*keys, "day").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in VERBS])
    day = days.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "day", verbs.alias("v"))).alias("d")).filter("d.m < 0")
    span = Window.partitionBy(*keys).orderBy("at").rangeBetween(-(TWO_HOURS - 1), 0)
    spans = hours.select(*keys, "hour", *[F.sum(c).over(span).alias(c) for c in ("n", *VERBS)], F.min("hour").over(span).alias("span_start"))
    best = day.join(spans.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("hour").alias("right"), "span_start", verbs.alias("v"))).alias("s")), keys)
    as_map = lambda c: F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(v) for v in VERBS]), F.array(*[F.col(f"{c}.v.{v}") for v in VERBS])), lambda _, n: n > 0)
    return best.select(
        *keys, (-F.col("d.m")).alias("best_day_count"), F.col("d.day").alias("best_day_date"), as_map("d").alias("best_day_verbs"),
        (-F.col("s.m")).alias("best_2h_count"), F.concat("s.span_start", F.lit(":00")).alias("best_2h_start"), as_map("s").alias("best_2h_verbs"))


def frequency_order(freq: DataFrame) -> DataFrame:
    return freq.orderBy("character", F.desc("best_day_count"), "creature")


def with_frequency(kills: DataFrame, freq: DataFrame) -> DataFrame:
    return kills.join(freq, ["character", "creature"], "left")
