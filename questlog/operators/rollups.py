"""Rollups of the event table: each is a pure function of it, so a rescan can never double-count.

Every rollup is a hash aggregate with map-side partial results; what depends on scan order uses
`min_by`/`max_by` over the order columns instead of a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.grammar import VERBS
from questlog.operators.scan import SEQ, SEQ_BLOCKS, by_crowd, prefix_scan, seq
from questlog.operators.sequences import STUDY_KINDS, about_self, best_loot, gated_studies
from questlog.session import materialise

SOLO = {v: f"{v}_count" for v in VERBS}
ASSISTED = {"killed": "assisted_kill_count", "slaughtered": "assisted_slaughter_count",
            "vanquished": "assisted_vanquish_count", "dispatched": "assisted_dispatch_count"}
COUNTERS = [*SOLO.values(), *ASSISTED.values()]


def _act() -> Column:
    """Kind and verb of a kill or death line as one small number: -1 a death, 1 to 4 own kills by verb, 6 to 9 assisted ones, 0 and 5 other verbs."""
    verb = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in VERBS]), F.col("verb")), F.lit(0))
    return F.when(F.col("kind") == "Fallen", F.lit(-1)).otherwise(verb + F.when(F.col("kind") == "AssistedKill", F.lit(len(VERBS) + 1)).otherwise(F.lit(0))).cast("byte")


def _acts(verb: str) -> list[int]:
    own = VERBS.index(verb) + 1
    return [own, own + len(VERBS) + 1]


def _kill_counters() -> list[Column]:
    return [F.count_if(F.col("_act") == _acts(v)[k]).alias(c) for k, names in enumerate((SOLO, ASSISTED)) for v, c in names.items()]


def is_kill() -> Column:
    return F.col("kind").isin("SoloKill", "AssistedKill")


def own_death() -> Column:
    return (F.col("kind") == "Fallen") & about_self()


FILE_KEYS = ["root_no", "loose", "folder", "path"]


def kills_per_file(events: DataFrame, file_keys: list[str] = FILE_KEYS, first_line: bool = False) -> DataFrame:
    """The kill rollup of each file; with `first_line` also the number of its first kill or death line. Every aggregate buffer has a fixed width (counts, timestamps, line
    numbers), so this is a hash aggregate; what needs the order of files comes after, on far fewer rows.

    Lines are narrowed and dealt by creature of a character first. Most such pairs have few lines, spread over many tasks, so that the partial sums of each task, of two
    dozen columns, would be nearly as many as the lines and several times as wide.
    """
    at = F.when(is_kill(), F.col("date").try_cast("timestamp_ntz"))
    rows = events.filter(is_kill() | own_death()).select("character", "creature", *file_keys, "line_no", _act().alias("_act"), at.alias("_on"))
    by_verb = lambda v: F.when(F.col("_act").isin(_acts(v)), F.col("_on"))
    return rows.repartition("character", "creature").groupBy("character", "creature", *file_keys).agg(
        *_kill_counters(),
        F.count_if(F.col("_act") == -1).alias("killed_by_count"),
        F.min_by("_on", F.when(F.col("_on").isNotNull(), F.col("line_no"))).alias("date_first"),
        F.max("_on").alias("date_last"),
        *[F.min(by_verb(v)).alias(f"date_first_{v}") for v in VERBS],
        *[F.max(by_verb(v)).alias(f"date_last_{v}") for v in VERBS],
        *([F.min("line_no").alias("first_line")] if first_line else []),
    )


def kills(events: DataFrame, values: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Per (character, creature): counters by verb and role, deaths, dates, value.

    `date_first` is the first date in scan order, not the smallest. `values(name, value)` is the creature
    lookup; it is joined to the small rollup, not to the events. With `aliases(log_name, resolves_to, inline)` the
    value is that of the alias, else of the name, else of the name without `the `; `values` then is a bestiary with family and rarity.
    """
    return with_values(kills_of_files(kills_per_file(events)), values, aliases)


def kills_of_files(per_file: DataFrame, file_keys: list[str] = FILE_KEYS) -> DataFrame:
    """The kill rollup from those of its files, which `file_keys` put in order."""
    text = lambda c: c.cast("string")
    first = F.min_by("date_first", F.when(F.col("date_first").isNotNull(), F.struct(*file_keys)))
    return per_file.groupBy("character", "creature").agg(
        *[F.sum(c).alias(c) for c in [*COUNTERS, "killed_by_count"]],
        text(first).alias("date_first"), text(F.max("date_last")).alias("date_last"),
        *[text(F.min(f"date_first_{v}")).alias(f"date_first_{v}") for v in VERBS],
        *[text(F.max(f"date_last_{v}")).alias(f"date_last_{v}") for v in VERBS],
        *([F.min(F.struct(*file_keys, F.col("first_line").alias("line_no"))).alias("_since")] if "first_line" in per_file.columns else []))


def with_values(rollup: DataFrame, values: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """`creature_value` of a kill rollup, as `kills` describes it."""
    if values is None:
        return rollup.withColumn("creature_value", F.lit(0).cast("bigint"))
    if aliases is not None:
        from questlog.operators.lookups import lookup_creature
        found = lookup_creature(rollup, values, aliases)
        return found.withColumn("creature_value", F.col("value").cast("bigint")).drop("value", "family", "rarity", "source")
    v = values.select(F.col("name").alias("creature"), F.col("value").cast("bigint").alias("creature_value"))
    return rollup.join(v, "creature", "left").withColumn("creature_value", F.coalesce("creature_value", F.lit(0).cast("bigint")))


def with_best_loot(rollup: DataFrame, loot: DataFrame) -> DataFrame:
    """The largest own share of each creature's loot; 0 and '' where there was none."""
    return rollup.join(loot, ["character", "creature"], "left").withColumns(
        {"best_loot_value": F.coalesce("best_loot_value", F.lit(0).cast("bigint")), "best_loot_item": F.coalesce("best_loot_item", F.lit(""))})


def kills_with_loot(events: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """`kills` with the best loot. Lines of kills are read once: the rollup is written with the place of each creature's first line, which loot is then held to."""
    rollup = materialise(kills_of_files(kills_per_file(events, first_line=True)))
    loot = best_loot(events, seq(), rollup.select("character", "creature", "_since"))
    return with_best_loot(with_values(rollup.drop("_since"), values), loot)


LINES_PER_TASK = 300_000


def kill_hourly(events: DataFrame, lines: int | None = None) -> DataFrame:
    """Kills by verb per hour, of lines dealt by creature as in `kills_per_file`: few share an hour. With the number of `lines`, if it is known, tasks of the same
    size whatever the input, and so of the same memory."""
    rows = events.filter(is_kill()).select("character", "creature", S.hour_bucket("date").alias("hour"), _act().alias("_act"))
    tasks = [] if lines is None else [max(1, -(-lines // LINES_PER_TASK))]
    return rows.repartition(*tasks, "character", "creature").groupBy("character", "creature", "hour").agg(*_kill_counters())


# counter column -> (kinds, amount or None for 1, extra condition)
_COUNTERS: list[tuple[str, list[str], str | None, str | None]] = [
    ("esteem", ["EsteemGain"], None, None),
    ("coins_picked_up", ["CoinsPickedUp"], "amount", None),
    ("fur_coins", ["LootShare"], "amount", "loot_type = 'fur'"),
    ("fur_worth", ["LootShare"], "worth", "loot_type = 'fur'"),
    ("blood_coins", ["LootShare"], "amount", "loot_type = 'blood'"),
    ("blood_worth", ["LootShare"], "worth", "loot_type = 'blood'"),
    ("mandible_coins", ["LootShare"], "amount", "loot_type = 'mandible'"),
    ("mandible_worth", ["LootShare"], "worth", "loot_type = 'mandible'"),
    ("bounty_coins", ["LootShare"], "amount", "coalesce(loot_type, '') not in ('fur', 'blood', 'mandible')"),
    ("chest_coins", ["StudyCharge"], "amount", None),
    ("bells_used", ["BellUsed"], None, None),
    ("bells_broken", ["BellBroken"], None, None),
    ("chains_used", ["ChainUsed"], None, None),
    ("chains_broken", ["ChainBreak", "ChainShatter", "ChainSnap"], None, None),
    ("shieldstones_used", ["ShieldstoneUsed"], None, None),
    ("shieldstones_broken", ["ShieldstoneBroken"], None, None),
    ("ethereal_portals", ["EtherealPortalOpened", "EtherealPortalStoneUsed"], None, None),
    ("eps_broken", ["EtherealPortalStoneUsed"], None, None),
    ("ore_found", ["OreFound"], None, None),
    ("iron_ore_found", ["OreFound"], None, "item = 'iron'"),
    ("copper_ore_found", ["OreFound"], None, "item = 'copper'"),
    ("tin_ore_found", ["OreFound"], None, "item = 'tin'"),
    ("gold_ore_found", ["OreFound"], None, "item = 'gold'"),
    ("wood_taken", ["WoodTaken"], None, None),
    ("wood_useless", ["WoodUseless"], None, None),
    ("fishing_attempts", ["FishingMiss"], None, None),
    ("mimics_caught", ["FishCaught"], None, "item = 'Mimic'"),
    ("good_karma", ["KarmaReceived"], None, "flag"),
    ("bad_karma", ["KarmaReceived"], None, "not flag"),
    ("gave_good_karma", ["KarmaGiven"], None, "flag"),
    ("gave_bad_karma", ["KarmaGiven"], None, "not flag"),
    ("untraining_count", ["Untrained"], None, None),
]
COUNTER_COLUMNS = ["deaths", *[c for c, *_ in _COUNTERS]]


def character_counters(events: DataFrame) -> DataFrame:
    """All plain counters of a character in one pass."""
    aggs = [F.count_if(own_death()).alias("deaths")]
    for name, kinds, amount, extra in _COUNTERS:
        cond = F.col("kind").isin(kinds)
        if extra:
            cond = cond & F.coalesce(F.expr(extra), F.lit(False))
        value = F.lit(1) if amount is None else F.col(amount)
        aggs.append(F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint").alias(name))
    return events.groupBy("character").agg(*aggs)


def deaths(events: DataFrame) -> DataFrame:
    return events.filter(own_death()).groupBy("character").agg(F.count("*").alias("deaths"))


def fishing_counts(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'FishCaught'").groupBy("character", "item").agg(F.count("*").alias("n"))


def fishing_catches(events: DataFrame) -> DataFrame:
    """MAP item -> count per character; counted first, so a map holds only the distinct items."""
    return fishing_counts(events).groupBy("character").agg(
        F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("fishing_catches"))


def trainer_ranks(gated: DataFrame, trainer_meta: DataFrame | None = None) -> DataFrame:
    """Counted rank events per (character, trainer): ranks, confirmed and unknown apply-learning, last date.

    Per file first, with fixed-width buffers; the last date in scan order is then chosen among files.
    """
    return with_multiplier(ranks_of_files(ranks_per_file(gated)), trainer_meta)


def ranks_per_file(gated: DataFrame, file_keys: list[str] = FILE_KEYS) -> DataFrame:
    learning = F.col("kind") == "ApplyLearningRank"
    return gated.filter("counted").groupBy("character", "trainer", *file_keys).agg(
        F.count_if(F.col("kind") == "TrainerRank").alias("ranks"),
        F.count_if(learning & F.col("flag")).alias("full"), F.count_if(learning & ~F.col("flag")).alias("part_learned"),
        F.max_by(F.col("date").try_cast("timestamp_ntz"), "line_no").alias("last"))


def ranks_of_files(per_file: DataFrame, file_keys: list[str] = FILE_KEYS) -> DataFrame:
    return per_file.groupBy("character", "trainer").agg(
        F.sum("ranks").alias("ranks"), (F.sum("full") * 10).alias("apply_learning_ranks"), F.sum("part_learned").alias("apply_learning_unknown_count"),
        F.max_by("last", F.struct(*file_keys)).cast("string").alias("date_of_last_rank"))


def with_multiplier(out: DataFrame, trainer_meta: DataFrame | None = None) -> DataFrame:
    if trainer_meta is None:
        return out.withColumn("effective_multiplier", F.lit(1.0))
    meta = trainer_meta.select("trainer", F.col("multiplier").alias("effective_multiplier"))
    return out.join(meta, "trainer", "left").withColumn("effective_multiplier", F.coalesce("effective_multiplier", F.lit(1.0)))


def announced_profession(events: DataFrame, order: Column | None = None) -> DataFrame:
    order = seq() if order is None else order
    return events.filter((F.col("kind") == "ProfessionAnnouncement") & about_self()).groupBy("character").agg(
        F.max_by("text", order).alias("announced"))


def pets(imported: DataFrame) -> DataFrame:
    return imported.groupBy("character", "pet_name").agg(F.min("creature").alias("creature"))


# --- studies -----------------------------------------------------------------------------------------------

_TOUCHES = ["StudyProgress", "LastyBeginStudy", "LastyProgress", "LastyFinished"]

PLACE = ["root_no", "loose", "folder", "path", "line_no", "path_head", "line_block"]


def completions(events: DataFrame) -> DataFrame:
    """'Training completed' lines with their place."""
    return events.filter("kind = 'LastyCompleted'").select("character", *PLACE)


def _popped(done: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbers (`_row`) of the rows finished by 'training completed', which names no creature.

    Each such line finishes the newest unfinished row. Only two moments of a row matter, its insertion and
    its first finish, and consecutive completions act as one number of pops; so a character comes down to
    at most two entries per catalogue creature and type, plus one count between two entries, whatever the
    number of lines. Lines are brought to that by a prefix scan and an aggregate; the bounded list is then folded over a stack of open rows.
    """
    done = done.withColumns({"_row": F.lit(None).cast("bigint"), "op": F.lit("pop")})
    marks = rows.select("character", "_row", F.lit("open").alias("op"), "_new.*").unionByName(
        rows.filter("_fin is not null").select("character", "_row", F.lit("shut").alias("op"), "_fin.*"))
    return by_crowd(marks.select(*done.columns).unionByName(done), "character", ["character"], lambda lines, whole: _pops(lines, [] if whole else SEQ_BLOCKS))


def _pops(lines: DataFrame, blocks: list[list[str]]) -> DataFrame:
    order = ["line_no"] if blocks else SEQ
    steps = prefix_scan(lines, ["character"], [*order, "op"], {"step": ("sum", (F.col("op") != "pop").cast("int"))}, blocks)
    steps = steps.groupBy("character", "step", "op", "_row").agg(F.count("*").cast("int").alias("n"))
    listed = steps.groupBy("character").agg(F.array_sort(F.collect_list(F.struct("step", (F.col("op") == "pop").alias("late"), F.col("_row").alias("row"), "op", "n"))).alias("steps"),
                                            F.max(F.col("op") == "pop").alias("_pops")).filter("_pops")
    return listed.select(F.explode(_fold(F.col("steps"), "bigint")).alias("_row"))


def _fold(steps: Column, number: str) -> Column:
    """Numbers of the rows that the pops of `steps` (op, row, n), in their order, take from the stack of open rows."""
    none = F.array().cast(f"array<{number}>")

    def fold(state: Column, s: Column) -> Column:
        open_, out, n = state["open"], state["out"], F.least(s["n"], F.size(state["open"]))
        left = F.size(open_) - n
        is_pop = s["op"] == "pop"
        return F.struct(
            F.when(is_pop, F.slice(open_, 1, left)).when(s["op"] == "open", F.array_append(open_, s["row"])).otherwise(
                F.array_remove(open_, s["row"])).alias("open"),
            F.when(is_pop & (n > 0), F.concat(out, F.slice(open_, left + 1, n))).otherwise(out).alias("out"))

    return F.aggregate(steps, F.struct(none.alias("open"), none.alias("out")), fold, lambda s: s["out"])


def lastys(events: DataFrame, reflected: DataFrame | None = None) -> DataFrame:
    """Studies per (character, creature, type): counts, first and last seen, finished, completed, abandoned.

    `reflected(character, lasty_type, creature, date)` are the lists applied after the scan; they come last.
    """
    lines = materialise(events.filter(F.col("kind").isin(*STUDY_KINDS, "LastyCompleted")).select("character", "creature", "lasty_type", "kind", "date", *PLACE))
    return with_reflected(by_crowd(lines, "character", ["character"], lambda rows, whole: _whole_studies(rows) if whole else _block_studies(rows)), reflected)


def _study_kind() -> Column:
    return F.when(F.col("kind") == "StudyProgress", F.lit("Movements")).otherwise(F.col("lasty_type")).alias("lasty_type")


def _counted() -> list[Column]:
    """What the lines of a (character, creature, type) come to; `_at` orders them. `_since`: their first line, `_ctl`: the last that abandons or begins the creature."""
    kind = F.col("kind")
    touch, fin = F.when(kind.isin(_TOUCHES), F.col("_at")), F.when(kind == "LastyFinished", F.col("_at"))
    mark = F.when(kind.isin("StudyAbandon", "LastyBeginStudy"), F.struct("_at", F.when(kind == "StudyAbandon", F.col("date")).alias("date")))
    return [F.count(touch).alias("message_count"), F.min_by("date", touch).alias("first_seen"), F.max_by("date", touch).alias("last_seen"),
            (F.count(fin) > 0).alias("finished"), F.max_by("date", fin).alias("completed"), F.min(touch).alias("_since"), F.max(mark).alias("_ctl")]


def _with_abandoned(rows: DataFrame) -> DataFrame:
    """Abandoning marks the rows that exist; beginning any type of the creature clears all of them."""
    ctl = F.max("_ctl").over(Window.partitionBy("character", "creature"))
    return rows.withColumn("_ctl", ctl).withColumn("abandoned", F.when(F.col("_since") < F.col("_ctl._at"), F.col("_ctl.date"))).drop("_ctl")


def _whole_studies(lines: DataFrame) -> DataFrame:
    """`lastys` of characters whose lines lie in one task: all further steps keep to the character, so nothing is shuffled or written between them.

    Lines are numbered inside their character. A row goes by the number of its first line; completions are rows of their own (`_done`).
    """
    numbered = lines.select("character", "creature", "lasty_type", "kind", "date", F.row_number().over(Window.partitionBy("character").orderBy(*SEQ)).alias("_at"))
    kept = gated_studies(numbered, [], ["_at"])
    fin = F.min(F.when(F.col("kind") == "LastyFinished", F.col("_at")))
    rows = _with_abandoned(kept.groupBy("character", "creature", _study_kind(), F.when(F.col("kind") == "LastyCompleted", F.col("_at")).alias("_done")).agg(*_counted(), fin.alias("_fin")))
    row = F.struct("creature", "lasty_type", "message_count", "first_seen", "last_seen", "finished", "completed", "abandoned", "_since", "_fin")
    held = rows.groupBy("character").agg(F.collect_list(F.when(F.col("message_count") > 0, row)).alias("rows"), F.collect_list("_done").alias("done"))
    step = lambda at, op, of: F.struct(at.alias("at"), F.lit(op).alias("op"), of.alias("row"), F.lit(1).alias("n"))
    steps = F.array_sort(F.concat(
        F.transform("rows", lambda r: step(r["_since"], "open", r["_since"])),
        F.transform(F.filter("rows", lambda r: r["_fin"].isNotNull()), lambda r: step(r["_fin"], "shut", r["_since"])),
        F.transform("done", lambda at: step(at, "pop", F.lit(None).cast("int")))))
    none = F.array().cast("array<int>")
    # the fold is a column of its own below the explode, or it would run once for each row
    popped = held.withColumn("popped", F.when(F.size("done") > 0, _fold(steps, "int")).otherwise(none)).drop("done")
    r = F.col("r")
    return popped.select("character", "popped", F.explode("rows").alias("r")).select(
        "character", *[r[c].alias(c) for c in ("creature", "lasty_type", "message_count", "first_seen", "last_seen")],
        (r["finished"] | F.array_contains("popped", r["_since"])).alias("finished"), r["completed"].alias("completed"), r["abandoned"].alias("abandoned"))


def _block_studies(lines: DataFrame) -> DataFrame:
    """`lastys` of characters with so many lines that they are taken by blocks."""
    kind, place = F.col("kind"), F.struct(*PLACE)
    studied = gated_studies(lines.filter(kind != "LastyCompleted").withColumn("_at", seq()), SEQ_BLOCKS)
    rows = studied.groupBy("character", "creature", _study_kind()).agg(
        *_counted(), F.min_by(place, F.when(kind.isin(_TOUCHES), F.col("_at"))).alias("_new"), F.min_by(place, F.when(kind == "LastyFinished", F.col("_at"))).alias("_fin"))
    return _with_popped(_with_abandoned(rows).filter("message_count > 0").drop("_since"), completions(lines))


def studies_of_rows(rows: DataFrame, control: DataFrame, done: DataFrame) -> DataFrame:
    """Studies from their counted rows (`_new` and `_fin`: places of the first line and of the first finish), the last abandon or begin line of each creature, and
    the completions."""
    since = F.struct(*[F.col(f"_new.{c}") for c in SEQ])
    return _with_popped(rows.join(control, ["character", "creature"], "left").withColumn("abandoned", F.when(since < F.col("_ctl.at"), F.col("_ctl.date"))).drop("_ctl"), done)


def _with_popped(rows: DataFrame, done: DataFrame) -> DataFrame:
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))  # numbers hold once written
    popped = _popped(done, rows).withColumn("_popped", F.lit(True))
    return rows.join(popped, "_row", "left").select(
        "character", "creature", "lasty_type", "message_count", "first_seen", "last_seen",
        (F.col("finished") | F.coalesce("_popped", F.lit(False))).alias("finished"), "completed", "abandoned")


def with_reflected(out: DataFrame, reflected: DataFrame | None) -> DataFrame:
    if reflected is None:
        return out
    extra = reflected.groupBy("character", "creature", "lasty_type").agg(
        F.count("*").alias("_more"), F.max("date").alias("_reflect"))
    merged = out.join(extra, ["character", "creature", "lasty_type"], "full")
    seen = F.col("_reflect").isNotNull()
    return merged.select(
        "character", "creature", "lasty_type",
        (F.coalesce("message_count", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("message_count"),
        F.coalesce("first_seen", "_reflect").alias("first_seen"), F.coalesce("_reflect", "last_seen").alias("last_seen"),
        (seen | F.coalesce("finished", F.lit(False))).alias("finished"), F.coalesce("completed", "_reflect").alias("completed"),
        "abandoned")


# --- scan report -------------------------------------------------------------------------------------------

_SILENT = ["Ignored", "CoinBalance", "ExperienceGain", "ClanningChange", "Disconnect", "Recovered", "ReflectListHeader",
           "TrainerGreetingSimple", "TrainerGreetingWithUnknownCheckpoint", "TrainerBow"]
_CONDITIONAL = ["Fallen", "TrainerCheckpoint", "TrainerCheckpointUnhailed", "LastyProgress", "TrainerRank", "ApplyLearningRank"]


def scan_report(parsed: DataFrame, events: DataFrame, gated: DataFrame, confirmed: DataFrame, studies: DataFrame) -> DataFrame:
    """One row: characters, files scanned and skipped, lines, events that counted.

    `confirmed` are the bow checkpoints, `studies` the gated study events, `gated` the rank events. Each input is read once; what is known
    of it is counted per character or file in partial aggregates, and the small counts are added up together.
    """
    kept = ~F.col("kind").isin(_SILENT + _CONDITIONAL) | (F.col("kind").isin("Fallen", "TrainerCheckpoint") & about_self())
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, **columns: Column) -> DataFrame:
        names = ("characters", "events", "scanned", "skipped", "lines")
        return df.select(*[columns.get(n, zero).alias(n) for n in names])

    people = events.groupBy("character").agg(F.count_if(kept).alias("n"))
    files = parsed.groupBy("path").agg(F.count("*").alias("n"), F.min("undetermined").alias("lost"))
    once = lambda c: c.cast("bigint")
    parts = [
        part(people, characters=once(F.col("character").isNotNull()), events=F.col("n")),
        part(gated.agg(F.count_if("counted").alias("n")), events=F.col("n")),
        part(confirmed.agg(F.count("*").alias("n")), events=F.col("n")),
        part(studies.agg(F.count_if(F.col("kind") == "LastyProgress").alias("n")), events=F.col("n")),
        part(files, scanned=once(~F.col("lost")), skipped=once(F.col("lost")), lines=F.when(~F.col("lost"), F.col("n"))),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    total = lambda c: F.coalesce(F.sum(c), zero)
    return every.agg(total("characters").alias("characters"), total("scanned").alias("files_scanned"), total("skipped").alias("files_skipped"),
                     total("lines").alias("lines_parsed"), total("events").alias("events_found"))


def process_log(df: DataFrame, level: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest entries first, at most `limit` if given; `logged_at` orders them."""
    rows = df if level is None else df.filter(F.col("level") == level)
    rows = rows.orderBy(F.desc("logged_at"), F.desc("message"))
    return rows if limit is None else rows.limit(limit)


def process_log_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count("*").alias("n"))


def scan_messages(parsed: DataFrame, events: DataFrame, skips: DataFrame, undetermined: DataFrame) -> DataFrame:
    """Diagnostics of a scan as (level, message, file_path)."""
    name = F.element_at(F.split("path", "/"), -1)
    files = parsed.groupBy("path").agg(F.count("ts").alias("_stamped"), F.max("file_ts").alias("_file_ts")).filter("_stamped = 0")
    no_ts = files.select(
        F.when(F.col("_file_ts").isNotNull(), F.lit("warn")).otherwise(F.lit("error")).alias("level"),
        F.concat(F.when(F.col("_file_ts").isNotNull(), F.lit("No timestamps in log lines — used filename date: ")).otherwise(
            F.lit("No timestamps in log lines and filename date could not be parsed: ")), name).alias("message"),
        F.col("path").alias("file_path"))
    unknown = events.filter((F.col("kind") == "TrainerGreetingWithUnknownCheckpoint") & about_self()).select(
        F.lit("warn").alias("level"),
        F.concat(F.lit("Unrecognized trainer checkpoint from "), "trainer", F.lit(" in "), name, F.lit(': "'), "text", F.lit('"')).alias("message"),
        F.col("path").alias("file_path"))
    skipped = skips.select(F.lit("info").alias("level"),
                           F.concat(F.lit("Skipped "), F.col("skipped").cast("string"), F.lit(" rank(s) for "), "trainer",
                                    F.lit(" — override active: "), name).alias("message"),
                           F.col("path").alias("file_path"))
    lost = undetermined.select(F.lit("warn").alias("level"), F.concat(F.lit("skipped: could not determine character ("), "path", F.lit(")")).alias("message"),
                               F.col("path").alias("file_path"))
    return no_ts.unionByName(unknown).unionByName(skipped).unionByName(lost)
