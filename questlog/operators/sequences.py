"""Operators on classified events that depend on the order of lines.

`events` are attributed, classified lines: the scan-order columns, `date`, `character`, `kind` and the
event fields. Running state is a prefix scan (see `scan`), everything else an aggregate and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.operators.scan import FILE_BLOCKS, SEQ, SEQ_BLOCKS, by_crowd, prefix_scan

RANK_KINDS = ["TrainerRank", "ApplyLearningRank"]


def about_self() -> Column:
    return S.iequals("subject", "character")


def gate_ranks(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Mark rank events with `counted`: false in mode 'override', and up to the cutoff in 'override_until_date'.

    `overrides(character, trainer, rank_mode, override_date)` has one row per (character, trainer).
    """
    return with_rank_gate(events.filter(counts_as_rank()), overrides)


def counts_as_rank() -> Column:
    return F.col("kind").isin(RANK_KINDS) & ((F.col("kind") == "TrainerRank") | about_self())


def with_rank_gate(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """`counted` of every line, as if it were a rank line; `lines` may be a stream."""
    o = overrides.select("character", "trainer", "rank_mode", "override_date")
    counted = F.when(F.col("rank_mode") == "override", F.lit(False)).when(
        (F.col("rank_mode") == "override_until_date") & F.col("override_date").isNotNull(),
        S.date_after("date", "override_date")).otherwise(F.lit(True))
    return lines.join(o, ["character", "trainer"], "left").withColumn("counted", counted).drop("rank_mode", "override_date")


def rank_skips(gated: DataFrame) -> DataFrame:
    return gated.filter(~F.col("counted")).groupBy("path", "trainer").agg(F.count("*").alias("skipped"))


def bow_checkpoints(events: DataFrame) -> DataFrame:
    """Greeting, bow, known phrase: the phrase is a checkpoint if the trainer bowed since the last greeting.

    State per (file, trainer): the last greeting, bow and phrase lines before the phrase. A phrase disarms,
    so a phrase that follows another one without a new greeting does not count.
    """
    return confirmed_bows(bow_steps(events))


def bow_steps(events: DataFrame) -> DataFrame:
    """The lines that move a bow sequence; `step`: greeted, bowed or spoken."""
    greeting = F.col("kind").isin("TrainerGreetingSimple", "TrainerGreetingWithUnknownCheckpoint") & about_self()
    step = F.when(greeting, F.lit("greeted")).when(F.col("kind") == "TrainerBow", F.lit("bowed")).when(F.col("kind") == "TrainerCheckpointUnhailed", F.lit("spoken"))
    return events.withColumn("step", step).filter("step is not null")


def confirmed_bows(steps: DataFrame) -> DataFrame:
    """Phrases that end a bow sequence, of `bow_steps`."""
    at = lambda step: ("max", F.when(F.col("step") == step, F.col("line_no")))
    scanned = prefix_scan(steps, ["path", "trainer"], ["line_no"], {"_greeted": at("greeted"), "_bowed": at("bowed"), "_spoken": at("spoken")}, FILE_BLOCKS, inclusive=False)
    armed = F.col("_greeted").isNotNull() & (F.col("_greeted") > F.coalesce("_spoken", F.lit(-1)))
    return scanned.filter((F.col("step") == "spoken") & armed & (F.col("_bowed") > F.col("_greeted"))).drop("_greeted", "_bowed", "_spoken", "step")


def checkpoints(events: DataFrame) -> DataFrame:
    """All checkpoints: greetings that carry a known phrase, and confirmed bow sequences."""
    hailed = events.filter((F.col("kind") == "TrainerCheckpoint") & about_self())
    return hailed.unionByName(bow_checkpoints(events))


def reflect_lists(events: DataFrame) -> DataFrame:
    """Creatures of the newest complete study list per (character, type).

    A header opens a list; lines ending in ',' continue it, one ending in '.' closes it; any other line
    drops it. A line belongs to the number of headers before it in its file, so each list is one group of
    which only the first closing and the first foreign line matter.
    """
    listing = (F.col("kind") == "Ignored") & ~F.col("message").rlike("^[¥•]")
    text = S.trim_all("message")
    closing, going = listing & text.endswith("."), listing & text.endswith(",")
    is_header = F.col("kind") == "ReflectListHeader"
    numbered = prefix_scan(events, ["path"], ["line_no"], {"list_no": ("sum", is_header.cast("int"))}, FILE_BLOCKS).filter("list_no > 0")
    lists = numbered.groupBy("path", "list_no").agg(
        F.max(F.when(is_header, F.col("lasty_type"))).alias("lasty_type"),
        F.max(F.when(is_header, F.col("date"))).alias("date"),
        F.min(F.when(closing, F.col("line_no"))).alias("end"),
        F.min(F.when(~closing & ~going & ~is_header, F.col("line_no"))).alias("broken"),
        F.min_by("character", F.when(closing, F.col("line_no"))).alias("character"),
        F.min_by(F.struct("root_no", "loose", "folder", "path", "line_no"), F.when(closing, F.col("line_no"))).alias("at"),
    ).filter("end is not null and (broken is null or end < broken) and date <> ''")
    latest = lists.groupBy("character", "lasty_type").agg(F.max("date").alias("date"))
    # ties on the date go to the list that came first
    newest = lists.join(latest, ["character", "lasty_type", "date"]).groupBy("character", "lasty_type", "date").agg(
        F.min_by(F.struct("path", "list_no", "end"), "at").alias("l")).select(
        "character", "lasty_type", "date", "l.path", "l.list_no", "l.end")
    parts = numbered.filter(closing | going).select("path", "list_no", "line_no", text.alias("_text"))
    named = parts.join(newest, ["path", "list_no"]).filter("line_no <= end").select(
        "character", "lasty_type", "date", "path", "end",
        F.explode(F.split(S.trim_all(F.regexp_replace("_text", "[.,]+$", "")), ", ")).alias("_name"))
    named = named.withColumn("creature", S.trim_all("_name")).filter("creature <> ''")
    unfinished = events.filter("kind = 'StudyProgress'").groupBy("path", "creature").agg(F.min("line_no").alias("_since"))
    return (named.join(unfinished, ["path", "creature"], "left")
            .filter(~((F.col("lasty_type") == "Movements") & F.coalesce(F.col("_since") < F.col("end"), F.lit(False))))
            .select("character", "lasty_type", "creature", "date"))


STUDY_KINDS = ["StudyProgress", "StudyAbandon", "LastyBeginStudy", "LastyProgress", "LastyFinished"]


def gate_studies(events: DataFrame, blocks: list[list[str]] = SEQ_BLOCKS) -> DataFrame:
    """Study events without the progress lines of an abandoned creature.

    A creature stays abandoned, for all types and over all files, until it is begun again or finished.
    """
    studies = events.filter(F.col("kind").isin(STUDY_KINDS))
    return by_crowd(studies, "character", ["character", "creature"], lambda rows, whole: gated_studies(rows, [] if whole else blocks))


def gated_studies(studies: DataFrame, blocks: list[list[str]], order: list[str] = SEQ) -> DataFrame:
    """`gate_studies` of study lines, with one window (by `order`) for each creature of a character if there are no blocks."""
    state = F.when(F.col("kind") == "StudyAbandon", F.lit(True)).when(
        F.col("kind").isin("LastyBeginStudy", "LastyFinished"), F.lit(False))
    scanned = prefix_scan(studies, ["character", "creature"], ["line_no"] if blocks else order, {"_gone": ("last", state)}, blocks, inclusive=False)
    return scanned.filter(~((F.col("kind") == "LastyProgress") & F.coalesce("_gone", F.lit(False)))).drop("_gone")


def departs(events: DataFrame, seq: Column) -> DataFrame:
    """Last absolute count, plus the first departs that came after it."""
    rows = events.filter(F.col("kind").isin("Depart", "FirstDepart")).select("character", "kind", "amount", seq.alias("_at"))
    absolute = rows.filter("kind = 'Depart'").groupBy("character").agg(
        F.max_by("amount", "_at").alias("_count"), F.max("_at").alias("_set"))
    return (rows.join(absolute, "character", "left")
            .groupBy("character").agg(
                (F.coalesce(F.max("_count"), F.lit(0)) + F.count(F.when(
                    (F.col("kind") == "FirstDepart") & (F.col("_set").isNull() | (F.col("_at") > F.col("_set"))), 1))).alias("departs")))


def makes_kill_row() -> Column:
    return F.col("kind").isin("SoloKill", "AssistedKill") | ((F.col("kind") == "Fallen") & about_self())


def loot_kind() -> Column:
    return F.when(F.col("loot_type") == "mandible", F.lit("mandibles")).otherwise(F.coalesce("loot_type", F.lit("loot")))


def loot_label() -> Column:
    return F.concat_ws(" ", "item", loot_kind())


def best_loot(events: DataFrame, seq: Column, first: DataFrame | None = None) -> DataFrame:
    """Largest own share per (character, creature); only loot after the first kill or death row counts.

    `first(character, creature, _since)` is the place of that row where it is known already: the rows are then not read for it.
    """
    if first is None:
        rows = events.filter(makes_kill_row()).select("character", "creature", seq.alias("_at"))
        first = rows.groupBy("character", "creature").agg(F.min("_at").alias("_since"))
    loot = events.filter("kind = 'LootShare' and amount > 0").select("character", F.col("item").alias("creature"), "amount", seq.alias("_at"), loot_kind().alias("_kind"))
    best = loot.join(first, ["character", "creature"]).filter("_at > _since").groupBy("character", "creature").agg(
        F.min(F.struct((-F.col("amount")).alias("m"), F.col("_at"), F.col("_kind"))).alias("b"))
    return best.select("character", "creature", (-F.col("b.m")).alias("best_loot_value"), F.concat_ws(" ", "creature", "b._kind").alias("best_loot_item"))
