"""Dimension sources: bestiary (XML, JSON), aliases, trainer catalogue, creature values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from questlog.functions import scalars as S

# Columns of a bestiary entry -> (column of the XML dump, type).
ENTRY_FIELDS: dict[str, tuple[str, str]] = {
    "name": ("name", "string"), "family": ("family", "string"), "location": ("location", "string"), "information": ("information", "string"),
    "value": ("exp_taxidermy", "int"), "rarity": ("rarity", "string"), "worth": ("worth", "int"), "worth_range": ("worth_range", "string"),
    "frames_per_swing": ("framesperswing", "double"), "difficulty": ("difficulty", "string"), "attack": ("attack", "int"),
    "defense": ("defense", "int"), "damage": ("damage", "int"), "health": ("health", "int"),
    "attack_measured": ("attack_ismeasured", "boolean"), "defense_measured": ("defense_ismeasured", "boolean"),
    "damage_measured": ("damage_ismeasured", "boolean"), "health_measured": ("health_ismeasured", "boolean"),
    "luck_hits": ("luck_hits", "int"), "is_seasonal": ("is_seasonal", "boolean"), "first_update": ("first_update", "string"),
    "last_update": ("last_update", "string"), "static_pic": ("static_pic", "string"), "static_width": ("static_width", "int"),
    "static_height": ("static_height", "int"), "action_pic": ("action_pic", "string"), "action_width": ("action_width", "int"),
    "action_height": ("action_height", "int"),
}
JSON_NAMES = {"value": "exp_taxidermy"}  # fixed value: the JSON file keeps the dump's name for the value


def _value(text: Column, type_: str) -> Column:
    known = F.when(text != "NULL", text)
    if type_ == "string":
        return S.blank_to_null(known)
    if type_ == "boolean":
        return F.coalesce(text == "1", F.lit(False))
    return known.try_cast(type_)


def read_bestiary_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the `creatures` table of a phpMyAdmin XML dump; a row without a name is an error."""
    schema = "_name string, column array<struct<_VALUE: string, _name: string>>"
    raw = spark.read.format("xml").option("rowTag", "table").schema(schema).load(path).filter("_name = 'creatures'")
    cells = F.map_from_entries(F.transform("column", lambda c: F.struct(c["_name"], F.coalesce(c["_VALUE"], F.lit("")))))
    rows = raw.select(cells.alias("c"))
    out = rows.select(*[_value(F.col("c")[src], t).alias(n) for n, (src, t) in ENTRY_FIELDS.items() if n != "name"],
                      F.coalesce(F.col("c")["name"], F.raise_error(F.lit("bestiary entry missing 'name' column")).cast("string")).alias("name"))
    return out.withColumn("value", F.coalesce("value", F.lit(0))).select(*ENTRY_FIELDS)


def read_bestiary_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a `{version, entries: [...]}` file."""
    fields = ", ".join(f"{JSON_NAMES.get(n, n)}: {t}" for n, (_, t) in ENTRY_FIELDS.items())
    raw = spark.read.option("multiLine", True).schema(f"version string, entries array<struct<{fields}>>").json(path)
    e = raw.select("version", F.explode("entries").alias("e"))
    return e.select(*[F.col(f"e.{JSON_NAMES.get(n, n)}").alias(n) for n in ENTRY_FIELDS], "version")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(log_name, resolves_to, inline STRUCT<value, family, rarity>)."""
    schema = "log_name string, resolves_to string, inline struct<exp_taxidermy: bigint, family: string, rarity: string, location: string, information: string>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    inline = F.when(F.col("inline").isNotNull(), F.struct(
        F.coalesce("inline.exp_taxidermy", F.lit(0)).alias("value"), F.col("inline.family").alias("family"), F.col("inline.rarity").alias("rarity")))
    return raw.select("log_name", "resolves_to", inline.alias("inline"))


def _json_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string, {value_type}>")).alias("key", "v"))


def read_trainers(spark: SparkSession, path: str) -> DataFrame:
    """(message, trainer, profession, multiplier, combo_components): one row per message, mark stripped."""
    rows = _json_map(spark, path, "struct<trainer: string, profession: string, effective_rank_multiplier: double, combo_components: array<string>>")
    return rows.filter("v.trainer is not null").select(
        S.trim_all(F.regexp_replace("key", "^¥", "")).alias("message"), "v.trainer", "v.profession",
        F.col("v.effective_rank_multiplier").alias("multiplier"), F.col("v.combo_components").alias("combo_components"))


def trainer_meta(messages: DataFrame) -> DataFrame:
    """One row per trainer; whatever any of its messages states holds for it."""
    return messages.groupBy("trainer").agg(
        F.max("profession").alias("profession"), F.coalesce(F.max("multiplier"), F.lit(1.0)).alias("multiplier"),
        F.coalesce(F.max_by("combo_components", F.size("combo_components")), F.array().cast("array<string>")).alias("combo_components"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    return _json_map(spark, path, "bigint").select(F.col("key").alias("name"), F.col("v").alias("value"))
