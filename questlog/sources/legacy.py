"""Import of the five tables of the older desktop program."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.operators.reports import weighted_ranks

# The legacy counters and the columns they become.
COUNTERS = {
    "ZLOGINS": "logins", "ZDEPARTS": "departs", "ZFALLS": "deaths", "ZESTEEM": "esteem", "ZCASINOCOINSWON": "casino_won",
    "ZCASINOCOINSLOST": "casino_lost", "ZCHESTVALUE": "chest_coins", "ZMYBOUNTY": "bounty_coins", "ZMYFURS": "fur_coins",
    "ZMYMANDIBLES": "mandible_coins", "ZMYBLOOD": "blood_coins", "ZBELLSUSED": "bells_used", "ZBELLSBROKEN": "bells_broken",
    "ZCHAINSUSED": "chains_used", "ZCHAINSBROKEN": "chains_broken", "ZSHIELDSTONESUSED": "shieldstones_used",
    "ZSHIELDSTONESBROKEN": "shieldstones_broken", "ZDARKSTONE": "darkstone", "ZPURG": "purgatory_pendant", "ZGK": "good_karma",
    "ZMYRECOVEREDFURS": "fur_worth", "ZMYRECOVEREDMANDIBLES": "mandible_worth", "ZMYRECOVEREDBLOOD": "blood_worth",
    "ZEPS": "ethereal_portals", "ZEPSBREAKS": "eps_broken", "ZCASINOCOINSFIXED": "coins_picked_up",
}
PROFESSIONS = ["Fighter", "Healer", "Mystic", "Ranger", "Bloodmage", "Champion"]
RELATED = {"trainers": "ZRELATIONSHIP", "kills": "ZRELATIONSHIP", "pets": "ZRELATIONSHIP", "lastys": "ZCHARACTERRELATIONSHIP"}


def _first_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row that came first per key: later duplicates are ignored."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def _number(df: DataFrame, c: str):
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0)) if c in df.columns else F.lit(0).cast("bigint")


def import_legacy(tables: dict[str, DataFrame], bestiary_values: DataFrame, trainer_meta: DataFrame) -> dict[str, DataFrame]:
    """Characters, trainers, kills, pets, studies and a report of counts and warnings.

    A character is kept if it has related rows, a profession, or a valid name with logins; one with an
    invalid name is never kept. Missing tables count as empty.
    """
    raw = tables["characters"]
    name = F.coalesce("ZCHARACTERNAME", F.lit(""))
    prof = F.when(F.col("ZPROFESSION").isin(PROFESSIONS), F.col("ZPROFESSION")).otherwise(F.lit("Unknown"))
    related = None
    for t, key in RELATED.items():
        if t in tables:
            keys = tables[t].select(F.col(key).alias("Z_PK"))
            related = keys if related is None else related.unionByName(keys)
    c = raw.join(related.distinct().withColumn("_rel", F.lit(True)), "Z_PK", "left") if related is not None else raw.withColumn("_rel", F.lit(None).cast("boolean"))
    valid = S.valid_character_name(name)
    wanted = F.coalesce("_rel", F.lit(False)) | (prof != "Unknown") | (valid & (_number(raw, "ZLOGINS") > 0))
    judged = c.select(
        "Z_PK", name.alias("character"), prof.alias("profession"), *[_number(raw, z).alias(n) for z, n in COUNTERS.items()],
        _number(raw, "ZARMOR").cast("string").alias("armor"), S.legacy_date("ZSTARTDATE").alias("start_date"),
        wanted.alias("_wanted"), valid.alias("_valid"))
    kept = judged.filter("_wanted and _valid").drop("_wanted", "_valid")
    ids = kept.select("Z_PK", "character")
    characters = _first_row(kept, ["character"], "Z_PK")

    def owned(t: str) -> DataFrame:
        # rows come in the order of their primary key; without one, in that of their values
        order = ["Z_PK"] if "Z_PK" in tables[t].columns else sorted(tables[t].columns)
        rows = tables[t].withColumn("_row", F.struct(*order))
        return rows.drop("Z_PK").join(ids.withColumnRenamed("Z_PK", RELATED[t]), RELATED[t])

    out: dict[str, DataFrame] = {}
    counts = [judged.agg(F.count_if(F.col("_wanted") & F.col("_valid")).alias("n")).select(F.lit("characters_imported").alias("item"), "n"),
              judged.agg(F.count_if(~(F.col("_wanted") & F.col("_valid"))).alias("n")).select(F.lit("characters_skipped").alias("item"), "n")]
    if "trainers" in tables:
        t = owned("trainers").filter(F.coalesce("ZTRAINERNAME", F.lit("")) != "")
        notes = F.col("ZNOTES") if "ZNOTES" in t.columns else F.lit(None).cast("string")
        counts.append(t.agg(F.count("*").alias("n")).select(F.lit("trainers_imported").alias("item"), "n"))
        t = t.select("character", F.col("ZTRAINERNAME").alias("trainer"), _number(t, "ZRANKS").alias("ranks"), _number(t, "ZMODIFIEDRANKS").alias("modified_ranks"),
                     F.lit(0).cast("bigint").alias("apply_learning_ranks"), F.lit("modifier").alias("rank_mode"),
                     S.legacy_date("ZLASTTRAINED").alias("date_of_last_rank"), notes.alias("notes"), "_row")
        meta = trainer_meta.select("trainer", F.col("multiplier").alias("_m"))
        out["trainers"] = _first_row(t, ["character", "trainer"], "_row").drop("_row").join(meta, "trainer", "left").withColumn(
            "effective_multiplier", F.coalesce("_m", F.lit(1.0))).drop("_m")
        levels = weighted_ranks(out["trainers"], trainer_meta).withColumnRenamed("weighted_ranks", "coin_level")
        characters = characters.join(levels, "character", "left").withColumn("coin_level", F.coalesce("coin_level", F.lit(0)))
    if "kills" in tables:
        k = owned("kills").filter(F.coalesce("ZNAME", F.lit("")) != "")
        counts.append(k.agg(F.count("*").alias("n")).select(F.lit("kills_imported").alias("item"), "n"))
        stamp = lambda z: F.nullif(F.coalesce(F.col(z), F.lit(0.0)), F.lit(0.0))
        k = k.select("character", F.col("ZNAME").alias("creature"), _number(k, "ZKILL").alias("killed_count"), _number(k, "ZSLAUGHTER").alias("slaughtered_count"),
                     _number(k, "ZDISP").alias("dispatched_count"), _number(k, "ZVANQ").alias("vanquished_count"), _number(k, "ZKILLEDBY").alias("killed_by_count"),
                     _number(k, "ZCOINLEVEL").alias("_legacy_value"),
                     S.legacy_date(F.least(stamp("ZDATEFIRSTKILL"), stamp("ZDATEFIRSTSLAUGHTER"), stamp("ZDATEFIRSTDISP"))).alias("date_first"),
                     S.legacy_date("ZDATEFIRSTKILL").alias("date_first_killed"), S.legacy_date("ZDATELASTENCOUNTER").alias("date_last"), "_row")
        v = bestiary_values.select(F.col("name").alias("creature"), F.col("value").cast("bigint").alias("_v"))
        out["kills"] = _first_row(k, ["character", "creature"], "_row").drop("_row").join(v, "creature", "left").withColumn(
            "creature_value", F.coalesce("_v", "_legacy_value")).drop("_v", "_legacy_value")
    if "pets" in tables:
        p = owned("pets").filter(F.coalesce("ZPETNAME", F.lit("")) != "")
        counts.append(p.agg(F.count("*").alias("n")).select(F.lit("pets_imported").alias("item"), "n"))
        p = p.select("character", F.col("ZPETNAME").alias("pet_name"), F.coalesce(S.blank_to_null("ZMAXCREATURENAME"), "ZPETNAME").alias("creature"), "_row")
        out["pets"] = _first_row(p, ["character", "pet_name"], "_row").drop("_row")
    if "lastys" in tables:
        s = owned("lastys").filter(F.coalesce("ZCREATURENAME", F.lit("")) != "")
        counts.append(s.agg(F.count("*").alias("n")).select(F.lit("lastys_imported").alias("item"), "n"))
        s = s.select("character", F.col("ZCREATURENAME").alias("creature"), F.coalesce("ZLASTYTYPE", F.lit("")).alias("lasty_type"),
                     (_number(s, "ZFINISHED") != 0).alias("finished"), _number(s, "ZMESSAGECOUNT").alias("message_count"), "_row")
        out["lastys"] = _first_row(s, ["character", "creature", "lasty_type"], "_row").drop("_row")
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    out["characters"] = characters
    out["import_report"] = report
    out["import_warnings"] = judged.filter("_wanted and not _valid").select(
        F.concat(F.lit("Skipped character with invalid name: "), "character").alias("message"))
    return out
