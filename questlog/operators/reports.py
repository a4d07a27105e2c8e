"""Reports over the rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.grammar import VERBS
from questlog.operators import rankings as RK
from questlog.operators.lookups import labelled, rarity_rank
from questlog.operators.rollups import ASSISTED, COUNTERS, SOLO

# Display order of trainer professions.
PROFESSION_ORDER = ["Fighter", "Healer", "Mystic", "Ranger", "Bloodmage", "Champion", "Language", "Arts", "Trades", "Other"]
COIN_SOURCES = ["fur_coins", "mandible_coins", "blood_coins", "bounty_coins", "chest_coins", "coins_picked_up", "casino_won",
                "esteem", "darkstone"]


def _or_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0).cast("bigint") for c in columns})


def one_decimal(c: Column) -> Column:
    """Tenths as the reference counts them: the tenfold is rounded, so 7.65 in binary becomes 7.7."""
    return F.round(c * 10) / 10


GRID_BUCKETS = 16


def per_entry(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every row of `df` with every row of a catalogue, for reports whose result is that grid: the catalogue is dealt into
    buckets and each row of `df` meets every bucket in an equi-join, so that neither side is gathered."""
    dealt = catalogue.withColumn("_bucket", F.pmod(F.xxhash64(*catalogue.columns[:1]), F.lit(GRID_BUCKETS)).cast("int"))
    asked = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID_BUCKETS - 1))).alias("_bucket"))
    return asked.join(dealt, "_bucket").drop("_bucket")


# --- kills -------------------------------------------------------------------------------------------------

def kill_totals(kills: DataFrame) -> DataFrame:
    return kills.groupBy("character").agg(
        F.sum(RK.solo()).alias("solo"), F.sum(RK.assisted()).alias("assisted"), F.sum("killed_by_count").alias("killed_by"),
        *[F.sum(RK.verb_total(v)).alias(v) for v in VERBS], F.count("*").alias("creatures"))


def with_labels(kills: DataFrame, bestiary: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add family_canonical, rarity_canonical and is_seasonal of each creature: those of its alias, else of its name; with aliases, else of the name without a leading
    'the '. An inline alias brings its own labels and is not seasonal."""
    labels = ["family_canonical", "rarity_canonical", "is_seasonal"]
    b = labelled(bestiary).select("name", *labels)
    if aliases is None:
        return kills.join(b.withColumnRenamed("name", "creature"), "creature", "left")
    pointed = aliases.filter("resolves_to is not null").select("log_name", F.col("resolves_to").alias("name")).join(b, "name").drop("name")
    inline = aliases.filter("inline is not null").select("log_name", F.col("inline.family").alias("family_canonical"), S.canonical_rarity("inline.rarity").alias("rarity_canonical"), F.lit(False).alias("is_seasonal"))
    every = pointed.unionByName(inline).withColumn("p", F.lit(0)).unionByName(b.withColumnRenamed("name", "log_name").withColumn("p", F.lit(1)))
    index = every.groupBy("log_name").agg(F.min(F.struct("p", *labels)).alias("e"))
    # names without the article need no second look; their key is spread so that it cannot become a hot one
    bare = F.when(F.col("creature").startswith("the "), F.expr("substring(creature, 5)")).otherwise(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("creature"), F.lit(4096)).cast("string")))
    rows = kills.join(index.select(F.col("log_name").alias("creature"), F.col("e").alias("_a")), "creature", "left").withColumn("_bare", bare).join(
        index.select(F.col("log_name").alias("_bare"), F.col("e").alias("_b")), "_bare", "left")
    return rows.select(*kills.columns, *[F.coalesce("_a", "_b")[c].alias(c) for c in labels])


def filter_kills(kills: DataFrame, bestiary: DataFrame, family: str | None = None, rarity: str | None = None,
                 seasonal: bool | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Canonical labels, compared without case, found as by `with_labels`; a creature without entry is family '', rarity Unknown, not seasonal."""
    rows = with_labels(kills, bestiary, aliases)
    if family is not None:
        rows = rows.filter(F.lower(F.coalesce("family_canonical", F.lit(""))) == family.lower())
    if rarity is not None:
        rows = rows.filter(F.lower(F.coalesce("rarity_canonical", F.lit("Unknown"))) == rarity.lower())
    if seasonal is not None:
        rows = rows.filter(F.coalesce("is_seasonal", F.lit(False)) == seasonal)
    return rows.select(*kills.columns)


def filter_kills_multi(kills: DataFrame, bestiary: DataFrame, families=(), rarities=(), seasonal: bool = False) -> DataFrame:
    """Sets of labels; the creature must have an entry."""
    b = labelled(bestiary).select(F.col("name").alias("creature"), "family_canonical", "rarity_canonical", "is_seasonal")
    if families:
        b = b.filter(F.col("family_canonical").isin(list(families)))
    if rarities:
        b = b.filter(F.col("rarity_canonical").isin(list(rarities)))
    if seasonal:
        b = b.filter("is_seasonal")
    return kills.join(b.select("creature"), "creature", "left_semi") if (families or rarities or seasonal) else kills


def kill_facets(kills: DataFrame, bestiary: DataFrame) -> DataFrame:
    """(facet, value, rank): families and rarities that occur among the killed creatures."""
    b = labelled(bestiary).join(kills.select(F.col("creature").alias("name")), "name", "left_semi")
    fam = b.filter("family_canonical is not null").select(F.lit("family").alias("facet"), F.col("family_canonical").alias("value"),
                                                          F.lit(0).alias("rank")).distinct()
    rar = b.select(F.lit("rarity").alias("facet"), F.col("rarity_canonical").alias("value"),
                   rarity_rank(F.col("rarity_canonical")).alias("rank")).distinct()
    return fam.unionByName(rar).orderBy("facet", "rank", "value")


def kill_breakdown(kills: DataFrame, bestiary: DataFrame, by: str) -> DataFrame:
    """Kills and their share per family or rarity with kills; 'Unknown' where the creature has no entry."""
    label = {"family": "family_canonical", "rarity": "rarity_canonical"}[by]
    b = labelled(bestiary).select(F.col("name").alias("creature"), F.col(label).alias("_label"))
    per = kills.join(b, "creature", "left").groupBy("character", F.coalesce("_label", F.lit("Unknown")).alias(by)).agg(
        F.sum(RK.total()).alias("kills"), F.count("*").alias("creatures")).filter("kills > 0")
    share = F.try_divide(F.col("kills") * 100.0, F.sum("kills").over(Window.partitionBy("character")))
    return per.withColumn("share", F.round(share, 6))


def encountered(kills: DataFrame, lastys: DataFrame | None = None) -> DataFrame:
    seen = kills.filter((RK.total() + F.col("killed_by_count")) > 0).select("character", "creature")
    if lastys is not None:
        seen = seen.unionByName(lastys.select("character", "creature"))
    return seen.distinct()


def bestiary_completion(bestiary: DataFrame, seen: DataFrame, by_family: bool) -> DataFrame:
    """Share of the bestiary met by each character, overall or per canonical family."""
    b = labelled(bestiary).select(F.col("name").alias("creature"), F.coalesce("family_canonical", F.lit("Unknown")).alias("family"))
    group = ["family"] if by_family else []
    totals = b.groupBy(*group).agg(F.count("*").alias("total"))
    met = seen.join(b, "creature").groupBy("character", *group).agg(F.count("*").alias("met"))
    people = seen.select("character").distinct()
    grid = per_entry(people, totals)
    out = grid.join(met, ["character", *group], "left").withColumn("met", F.coalesce("met", F.lit(0)))
    return out.withColumn("pct", F.round(F.try_divide(F.col("met") * 100.0, F.col("total")), 1))


# --- trainers ----------------------------------------------------------------------------------------------

def effective_ranks() -> Column:
    """Override modes count the modified ranks only in mode 'override'."""
    return F.when(F.col("rank_mode") == "override", F.col("modified_ranks")).otherwise(
        F.col("ranks") + F.col("modified_ranks") + F.col("apply_learning_ranks"))


def apply_overrides(trainers: DataFrame, rank_overrides: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Rank mode, baseline, cutoff and notes onto the rollup; a trainer with only an override still appears."""
    o = rank_overrides.select("character", "trainer", "rank_mode", "override_date", F.col("modified_ranks").alias("_mod"))
    out = trainers.join(o, ["character", "trainer"], "full")
    if notes is not None:
        out = out.join(notes.select("character", "trainer", "notes"), ["character", "trainer"], "full")
    else:
        out = out.withColumn("notes", F.lit(None).cast("string"))
    return out.select(
        "character", "trainer",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ranks", "apply_learning_ranks", "apply_learning_unknown_count")],
        F.coalesce("_mod", F.lit(0).cast("bigint")).alias("modified_ranks"), "date_of_last_rank",
        F.coalesce("rank_mode", F.lit("modifier")).alias("rank_mode"), "override_date",
        F.coalesce("effective_multiplier", F.lit(1.0)).alias("effective_multiplier"), "notes")


def total_ranks(trainers: DataFrame) -> DataFrame:
    return trainers.groupBy("character").agg(
        F.sum(F.col("ranks") + F.col("apply_learning_ranks") + F.col("modified_ranks")).alias("total_ranks"))


def enrich_trainers(trainers: DataFrame, trainer_meta: DataFrame, show_zero: bool = False) -> DataFrame:
    """Profession and multiplier from the catalogue; with show_zero every catalogue trainer of every character."""
    meta = trainer_meta.select("trainer", "profession", F.col("multiplier").alias("_m"))
    if show_zero:
        grid = per_entry(trainers.select("character").distinct(), meta)
        rows = grid.join(trainers, ["character", "trainer"], "full")
    else:
        rows = trainers.join(meta, "trainer", "left")
    zero = ["ranks", "modified_ranks", "apply_learning_ranks", "apply_learning_unknown_count"]
    return rows.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in zero},
                             "rank_mode": F.coalesce("rank_mode", F.lit("modifier")),
                             "effective_multiplier": F.coalesce("effective_multiplier", "_m", F.lit(1.0))}).drop("_m")


def trainer_report(trainers: DataFrame, trainer_meta: DataFrame) -> DataFrame:
    """Effective and weighted ranks per trainer, with the place of its profession in the display order."""
    out = enrich_trainers(trainers, trainer_meta).withColumn("effective", effective_ranks())
    group = F.when(F.col("profession").isin(PROFESSION_ORDER), F.col("profession")).otherwise(F.lit("Other"))
    place = F.array_position(F.array(*[F.lit(p) for p in PROFESSION_ORDER]), group)
    return out.withColumn("weighted", one_decimal(F.col("effective") * F.col("effective_multiplier"))).withColumn(
        "profession_order", place)


def weighted_ranks(trainers: DataFrame, trainer_meta: DataFrame) -> DataFrame:
    """Sum of weighted ranks per character; a combo trainer counts only if none of its parts has ranks."""
    t = trainers.withColumn("effective", effective_ranks())
    active = t.filter("effective > 0").select("character", F.col("trainer").alias("part"))
    combos = trainer_meta.filter(F.size("combo_components") > 0).select("trainer", F.explode("combo_components").alias("part"))
    doubled = t.select("character", "trainer").join(combos, "trainer").join(active, ["character", "part"], "left_semi").select(
        "character", "trainer").distinct()
    return t.join(doubled, ["character", "trainer"], "left_anti").groupBy("character").agg(
        F.sum(F.round(F.col("effective") * F.col("effective_multiplier")).cast("bigint")).alias("weighted_ranks"))


def contains_any(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return df.filter(cond)


def trainer_catalog(trainer_meta: DataFrame, profession: str | None = None) -> DataFrame:
    rows = trainer_meta.dropDuplicates(["trainer"])
    return (rows if profession is None else rows.filter(F.lower("profession") == profession.lower())).orderBy("trainer")


# --- characters --------------------------------------------------------------------------------------------

def list_characters(characters: DataFrame, trainers: DataFrame, min_ranks: int = 0, exclude_unknown: bool = False,
                    contains: str | None = None) -> DataFrame:
    """Visible characters with their total ranks: not merged away, with logins."""
    rows = characters.filter("merged_into is null and logins > 0").join(total_ranks(trainers), "character", "left").withColumn(
        "total_ranks", F.coalesce("total_ranks", F.lit(0)))
    rows = rows.filter(F.col("total_ranks") >= min_ranks)
    if exclude_unknown:
        rows = rows.filter((F.coalesce("profession", F.lit("Unknown")) != "Unknown") & ~F.lower("character").startswith("agratis"))
    if contains:
        rows = rows.filter(F.lower("character").contains(contains.lower()))
    return rows.orderBy("character")


def coins_report(characters: DataFrame) -> DataFrame:
    """Net coins, loot worth, casino balance, and one row per source that is not zero."""
    c = _or_zero(characters, [*COIN_SOURCES, "casino_lost", "fur_worth", "mandible_worth", "blood_worth"])
    gains = sum((F.col(s) for s in COIN_SOURCES), F.lit(0))
    c = c.withColumn("net", gains - F.col("casino_lost")).withColumn(
        "loot_worth", F.col("fur_worth") + F.col("mandible_worth") + F.col("blood_worth")).withColumn(
        "casino_net", F.col("casino_won") - F.col("casino_lost"))
    source = F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("coins")) for s in COIN_SOURCES]),
                                lambda s: s["coins"] != 0)).alias("s")
    return c.select("character", "net", "loot_worth", "casino_net", source).select(
        "character", "net", "loot_worth", "casino_net", "s.source", "s.coins")


def equipment_report(characters: DataFrame, fishing: DataFrame) -> DataFrame:
    """Gathering success, bag slots, fishing attempts, and the catches in descending order."""
    c = _or_zero(characters, ["wood_taken", "wood_useless", "fishing_attempts", "mimics_caught"])
    caught = F.aggregate(F.map_values("fishing_catches"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    order = F.array_sort(F.transform(F.map_entries("fishing_catches"), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("item"))))
    c = c.join(fishing, "character", "left")
    return c.select(
        "character",
        F.round(F.try_divide(F.col("wood_taken") * 100.0, F.col("wood_taken") + F.col("wood_useless")), 1).alias("wood_success"),
        (F.col("mimics_caught") + 3).alias("bag_slots"),
        (F.col("fishing_attempts") + F.coalesce(caught, F.lit(0))).alias("fishing_attempts"),
        F.array_join(F.transform(order, lambda e: F.concat(e["item"], F.lit(":"), (-e["m"]).cast("string"))), ", ").alias("catches"))


def summary(characters: DataFrame, kills: DataFrame, trainers: DataFrame, lastys: DataFrame | None = None,
            pets: DataFrame | None = None) -> DataFrame:
    """One row per character: kills, ranks, survival rates, studies, pets."""
    k = kill_totals(kills).select("character", "solo", "assisted", "killed_by", "creatures").join(
        kills.filter(RK.total() > 0).groupBy("character").agg(RK.best(RK.total()).alias("b")).select(
            "character", F.col("b.name").alias("most_killed")), "character", "left")
    t = trainers.groupBy("character").agg(
        F.sum("ranks").alias("ranks"), one_decimal(F.sum(effective_ranks() * F.col("effective_multiplier").cast("decimal(12,6)"))).cast("double").alias("effective_ranks"),
        F.count("*").alias("trainers"))
    out = characters.join(k, "character", "left").join(t, "character", "left")
    if lastys is not None:
        out = out.join(lastys.groupBy("character").agg(F.count("*").alias("studies"), F.count_if("finished").alias("studies_done")), "character", "left")
    if pets is not None:
        out = out.join(pets.groupBy("character").agg(F.count("*").alias("pets")), "character", "left")
    pct = lambda a, b: F.round(F.try_divide(a * 100.0, a + b), 1)
    return out.withColumn("depart_rate", pct(F.col("departs"), F.col("deaths"))).withColumn(
        "chain_break_rate", pct(F.col("chains_broken"), F.col("chains_used")))


def update_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Characters whose logins or deaths differ between two snapshots."""
    b = before.select("character", F.col("logins").alias("_l"), F.col("deaths").alias("_d"))
    d = lambda new, old: F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0))
    return after.select("character", "logins", "deaths").join(b, "character", "full").select(
        "character", d("logins", "_l").alias("logins"), d("deaths", "_d").alias("deaths")).filter("logins <> 0 or deaths <> 0")


# --- exports -----------------------------------------------------------------------------------------------

def kills_export(kills: DataFrame, freq: DataFrame) -> DataFrame:
    """The 13 export columns, most kills first; cells as text, blank where there is nothing to say."""
    j = kills.join(freq, ["character", "creature"], "left")
    some = (F.coalesce("best_day_count", F.lit(0)) > 0) | (F.coalesce("best_2h_count", F.lit(0)) > 0)
    blank = lambda c: F.when(some & (F.col(c) > 0), F.col(c).cast("string")).otherwise(F.lit(""))
    # a character's rows, one for each creature at most, stay together and in order; characters are not sorted among one another
    return j.repartition("character").sortWithinPartitions("character", RK.total().desc(), "creature").select(
        "character", F.col("creature").alias("Creature"),
        *[RK.verb_total(v).cast("string").alias(v.capitalize()) for v in ("vanquished", "killed", "dispatched", "slaughtered")],
        F.col("killed_by_count").cast("string").alias("Killed By"), F.col("creature_value").cast("string").alias("Value"),
        S.date_only("date_first").alias("First Kill"), S.date_only("date_last").alias("Last Kill"),
        blank("best_day_count").alias("Best Day"), F.when(some, F.coalesce("best_day_date", F.lit(""))).otherwise("").alias("Best Day Date"),
        blank("best_2h_count").alias("Best 2h"),
        F.when(some, F.coalesce(S.two_hour_window("best_2h_start"), F.lit(""))).otherwise("").alias("Best 2h Window"))


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV text under the export's quoting rule; write with `.write.text`."""
    cells = [S.csv_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def frequency_export(freq: DataFrame, bin: str = "both", by_verb: bool = False) -> DataFrame:
    """Columns for the day, the two hours or both, with the verb counts as text on demand."""
    columns = ["character", "creature"]
    for part, fields in (("day", ["best_day_count", "best_day_date"]), ("2h", ["best_2h_count", "best_2h_start"])):
        if bin in (part, "both"):
            columns += fields
            if by_verb:
                columns.append(S.verb_text(F.col(f"best_{part}_verbs")).alias(f"best_{part}_verbs"))
    return freq.select(*columns)


COUNTER_ORDER = [*SOLO.values(), *ASSISTED.values()]
assert COUNTER_ORDER == COUNTERS
