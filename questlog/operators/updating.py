"""Updates of all rollups from new lines alone, equal to a rebuild from all lines.

The lines that one update adds to a file are a segment. Every rollup is made of parts, one row for each of its keys and segment, which know what can be said of
the segment alone and what depends on earlier lines: sums and extremes with their place, loot before a segment's own first kill, first departs
after its last count, progress before its first change of a study. Parts never change. Put in scan order they give the rollup, whether a segment came
first or last, so new files may stand before old ones, and tails after the heads of theirs. An update writes the parts of its lines, rebuilds the
characters it saw from all their parts, and publishes parts, rollups and the manifest as one generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questlog.operators import rollups as R
from questlog.operators import sequences as Q
from questlog.operators.scan import FILE_BLOCKS, SEQ, path_head, prefix_scan, seq
from questlog.sources import generations as G

SEGMENT = [*R.FILE_KEYS, "part"]
AT = [*SEGMENT, "line_no"]
COMPACT = 16


def _segment() -> Column:
    return F.struct(*SEGMENT)


# ---- parts of new lines

def loot_parts(events: DataFrame) -> DataFrame:
    """Per segment: the first line that makes a kill row; the best loot before it, which counts if an earlier segment has such a line; the best
    after it."""
    keys = ["character", "creature", *SEGMENT]
    best = lambda when: F.min(F.when(when, F.struct((-F.col("amount")).alias("least"), "line_no", "label")))
    first = events.filter(Q.makes_kill_row()).groupBy(*keys).agg(F.min("line_no").alias("first_line"))
    loot = events.filter("kind = 'LootShare' and amount > 0").select("character", F.col("item").alias("creature"), *SEGMENT, "amount", "line_no", Q.loot_label().alias("label"))
    before = F.col("first_line").isNull() | (F.col("line_no") < F.col("first_line"))
    found = loot.join(first, keys, "left").groupBy(*keys).agg(best(before).alias("lead"), best(~before).alias("own"))
    return first.unionByName(found, allowMissingColumns=True)


def loot_of(parts: DataFrame) -> DataFrame:
    since = parts.groupBy("character", "creature").agg(F.min(F.when(F.col("first_line").isNotNull(), _segment())).alias("since"))
    placed = lambda c: F.struct(F.col(f"{c}.least").alias("least"), *SEGMENT, F.col(f"{c}.line_no").alias("line_no"), F.col(f"{c}.label").alias("label"))
    best = parts.join(since, ["character", "creature"]).groupBy("character", "creature").agg(F.min(F.least(
        F.when(F.col("own").isNotNull(), placed("own")), F.when(F.col("lead").isNotNull() & (_segment() > F.col("since")), placed("lead")))).alias("b"))
    return best.filter("b is not null").select("character", "creature", (-F.col("b.least")).alias("best_loot_value"), F.col("b.label").alias("best_loot_item"))


def depart_parts(events: DataFrame) -> DataFrame:
    """Per segment: its last absolute count, and its first departs after that."""
    rows = events.filter(F.col("kind").isin("Depart", "FirstDepart")).select("character", *SEGMENT, "kind", "amount", "line_no")
    counted = rows.filter("kind = 'Depart'").groupBy("character", *SEGMENT).agg(F.max(F.struct("line_no", "amount")).alias("last"))
    after = (F.col("kind") == "FirstDepart") & (F.col("last").isNull() | (F.col("line_no") > F.col("last.line_no")))
    return rows.join(counted, ["character", *SEGMENT], "left").groupBy("character", *SEGMENT).agg(F.max("last").alias("last"), F.count_if(after).alias("firsts"))


def departs_of(parts: DataFrame) -> DataFrame:
    last = parts.groupBy("character").agg(F.max(F.when(F.col("last").isNotNull(), F.struct(_segment().alias("at"), F.col("last.amount").alias("amount")))).alias("count"))
    return parts.join(last, "character").groupBy("character").agg(
        (F.coalesce(F.max("count.amount"), F.lit(0)) + F.sum(F.when(F.col("count").isNull() | (_segment() >= F.col("count.at")), F.col("firsts")).otherwise(0))).alias("departs"))


def bow_parts(events: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(checkpoints that the new lines confirm, the last step of each kind per file and trainer). Of older segments of a file only those three steps matter."""
    steps = Q.bow_steps(events)
    newest = lambda df: df.groupBy("path", "trainer", "step").agg(F.max("line_no").alias("line_no"))
    last, seen = newest(steps), steps
    if old is not None:
        before = newest(old.join(steps.select("path", "trainer").distinct(), ["path", "trainer"], "left_semi"))
        seen = steps.unionByName(before.withColumn("line_block", F.lit(-1).cast("bigint")), allowMissingColumns=True)  # older lines of a file stand before newer ones
    confirmed = Q.confirmed_bows(seen).filter("part is not null")
    hailed = events.filter((F.col("kind") == "TrainerCheckpoint") & Q.about_self())
    columns = ["character", "trainer", "rank_min", "rank_max", "date", *AT]
    return hailed.select(*columns).unionByName(confirmed.select(*columns)), last


def study_parts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per segment the counted rows of each study, apart where they count only if the creature is not abandoned before; per segment the state that it leaves a creature
    in and its last abandon or begin line)."""
    rows = events.filter(F.col("kind").isin(Q.STUDY_KINDS)).withColumn("lasty_type", F.when(F.col("kind") == "StudyProgress", F.lit("Movements")).otherwise(F.col("lasty_type")))
    state = F.when(F.col("kind") == "StudyAbandon", F.lit(True)).when(F.col("kind").isin("LastyBeginStudy", "LastyFinished"), F.lit(False))
    keys = ["character", "creature", *SEGMENT]
    scanned = prefix_scan(rows, keys, ["line_no"], {"gone": ("last", state)}, FILE_BLOCKS, inclusive=False)
    progress, fin = F.col("kind") == "LastyProgress", F.col("kind") == "LastyFinished"
    lead = (progress & F.col("gone").isNull()).alias("lead")
    place = F.struct(F.col("line_no"), *[F.col(c) for c in ("path_head", "line_block", "date")])
    touched = scanned.filter(F.col("kind").isin(R._TOUCHES) & ~(progress & F.coalesce("gone", F.lit(False))))
    parts = touched.groupBy("lasty_type", lead, *keys).agg(
        F.count("*").alias("messages"), F.min(place).alias("first"), F.max(place).alias("last"), F.min(F.when(fin, place)).alias("first_fin"), F.max(F.when(fin, place)).alias("last_fin"))
    marks = F.col("kind").isin("StudyAbandon", "LastyBeginStudy")
    controls = rows.groupBy(*keys).agg(
        F.max_by(state, F.when(state.isNotNull(), F.col("line_no"))).alias("gone"),
        F.max(F.when(marks, F.struct("line_no", F.when(F.col("kind") == "StudyAbandon", F.col("date")).alias("date")))).alias("mark"))
    return parts, controls


def studies_of(parts: DataFrame, controls: DataFrame, done: DataFrame) -> DataFrame:
    key = ["character", "creature"]
    states = controls.withColumn("path_head", path_head())
    before = prefix_scan(states, key, SEGMENT, {"before": ("last", F.col("gone"))}, [["root_no", "loose", "folder"], ["path_head"]], inclusive=False)
    kept = parts.join(before.select(*key, *SEGMENT, "before"), [*key, *SEGMENT], "left").filter(~(F.col("lead") & F.coalesce("before", F.lit(False))))
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(*SEGMENT, F.col(f"{c}.line_no").alias("line_no")))
    place = lambda c: F.struct(*R.FILE_KEYS, *[F.col(f"{c}.{x}").alias(x) for x in ("line_no", "path_head", "line_block")])
    rows = kept.groupBy("character", "creature", "lasty_type").agg(
        F.sum("messages").alias("message_count"), F.min_by("first.date", at("first")).alias("first_seen"), F.max_by("last.date", at("last")).alias("last_seen"),
        F.max(F.col("last_fin").isNotNull()).alias("finished"), F.max_by("last_fin.date", at("last_fin")).alias("completed"),
        F.min_by(place("first"), at("first")).alias("_new"), F.min_by(place("first_fin"), at("first_fin")).alias("_fin"))
    control = controls.filter("mark is not null").groupBy(*key).agg(F.max_by(
        F.struct(F.col("mark.date").alias("date"), F.struct(*R.FILE_KEYS, F.col("mark.line_no").alias("line_no")).alias("at")), at("mark")).alias("_ctl"))
    return R.studies_of_rows(rows, control, done)


def parts_of(events: DataFrame, part: int, overrides: DataFrame, old_bows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of new lines, by table."""
    events = events.withColumn("part", F.lit(part))
    checkpoints, bows = bow_parts(events, old_bows)
    studies, controls = study_parts(events)
    announced = events.filter((F.col("kind") == "ProfessionAnnouncement") & Q.about_self()).groupBy("character").agg(F.max(F.struct(seq().alias("at"), "text")).alias("last"))
    return {
        "kills": R.kills_per_file(events, SEGMENT), "hours": R.kill_hourly(events), "ranks": R.ranks_per_file(Q.gate_ranks(events, overrides), SEGMENT),
        "counters": R.character_counters(events), "fishing": R.fishing_counts(events), "loot": loot_parts(events), "departs": depart_parts(events), "checkpoints": checkpoints, "bows": bows,
        "professions": announced, "studies": studies, "controls": controls, "completions": R.completions(events)}


def rollups_of(parts: dict[str, DataFrame], values: DataFrame | None = None, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """All rollups from all parts."""
    summed = lambda df, *keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in df.columns if c not in keys])
    loot = loot_of(parts["loot"])
    fish = summed(parts["fishing"], "character", "item")
    return {
        "kill_table": R.with_best_loot(R.with_values(R.kills_of_files(parts["kills"], SEGMENT), values), loot), "kill_hours": summed(parts["hours"], "character", "creature", "hour"),
        "trainer_ranks": R.with_multiplier(R.ranks_of_files(parts["ranks"], SEGMENT), meta), "character_counters": summed(parts["counters"], "character"),
        "fishing_catches": fish.groupBy("character").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("fishing_catches")),
        "best_loot": loot, "depart_counts": departs_of(parts["departs"]),
        "checkpoint_table": parts["checkpoints"].select("character", "trainer", "rank_min", "rank_max", "date", *SEQ),
        "announced": parts["professions"].groupBy("character").agg(F.max("last").alias("last")).select("character", F.col("last.text").alias("announced")),
        "study_table": studies_of(parts["studies"], parts["controls"], parts["completions"])}


# ---- generations

def rescan(spark: SparkSession, root: str, events: DataFrame | None, overrides: DataFrame, values: DataFrame | None = None, meta: DataFrame | None = None,
           manifest: DataFrame | None = None) -> G.Generation | None:
    """Build all rollups anew from all lines (attributed, classified `events`) and publish them; `overrides` are kept as they are given. Without events nothing
    is done: no source is no reason to empty the tables."""
    return _ingest(spark, root, events, overrides, values, meta, manifest, None)


def update(spark: SparkSession, root: str, events: DataFrame | None, overrides: DataFrame, values: DataFrame | None = None, meta: DataFrame | None = None,
           manifest: DataFrame | None = None) -> G.Generation | None:
    """Fold new lines into the rollups and publish them. Lines of a file must come in order over several updates (tails after heads), files in any.

    Only characters with new lines are rebuilt, from their parts. `manifest` is published with them, so that a killed update leaves both as they were, and the next one
    reads the same files again. A rank counts by the `overrides` of its update; a rescan applies others to all ranks.
    """
    return _ingest(spark, root, events, overrides, values, meta, manifest, G.current(spark, root))


def _ingest(spark, root, events, overrides, values, meta, manifest, old) -> G.Generation | None:
    newest = G.current(spark, root)
    if events is None:
        return newest
    number = newest.number + 1 if newest else 0
    folder = G.new_folder(root, number)
    written, tables, schemas = {}, {}, {}
    for name, df in parts_of(events, number, overrides, old.read(spark, "part_bows") if old else None).items():
        path = G.write(df, folder, f"part_{name}")
        own = [path]
        if old and len(old.tables[f"part_{name}"]) + 1 >= COMPACT:
            own = [G.write(spark.read.schema(df.schema).parquet(*old.tables[f"part_{name}"], path), folder, f"compact_{name}")]
        elif old:
            own = [*old.tables[f"part_{name}"], path]
        tables[f"part_{name}"], schemas[f"part_{name}"] = own, df.schema.json()
        written[name] = spark.read.schema(df.schema).parquet(*own)
    written.pop("bows")  # carried from update to update, not shown
    if old:
        seen = spark.read.schema("character string").parquet(f"{folder}/part_counters")  # a row for each character of the new lines
        written = {n: df.join(seen, "character", "left_semi") for n, df in written.items()}
    for name, df in rollups_of(written, values, meta).items():
        if old:
            df = old.read(spark, name).join(seen, "character", "left_anti").unionByName(df)
        tables[name], schemas[name] = [G.write(df, folder, name)], df.schema.json()
    if manifest is not None:
        tables["manifest"], schemas["manifest"] = [G.write(manifest, folder, "manifest")], manifest.schema.json()
    elif newest and "manifest" in newest.tables:
        tables["manifest"], schemas["manifest"] = newest.tables["manifest"], newest.schemas["manifest"]
    return G.publish(spark, root, G.Generation(number, tables, schemas))

