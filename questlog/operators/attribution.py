"""Who was playing: from parsed lines to lines with a character and a filled timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.operators.scan import FILE_BLOCKS, prefix_scan
from questlog.sources.logs import welcome_back, welcome_login


def folder_character(parsed: DataFrame, per_file: bool = False) -> DataFrame:
    """Fallback character of each folder: the first welcome in its earliest file that has one, else its name.

    With per_file=True (explicit file lists) the unit is the file, and the fallback the title-cased folder.
    """
    unit = ["root_no", "folder", "path"] if per_file else ["root_no", "folder"]
    name = F.col("welcome")
    fallback = S.titlecase_name("folder") if per_file else F.col("folder")
    found = parsed.filter(~F.col("loose")).groupBy(*unit).agg(
        F.min_by(name, F.when(name.isNotNull(), F.struct("path", "line_no"))).alias("_welcome"))
    return found.select(*unit, F.coalesce(F.col("_welcome"), fallback).alias("folder_character"))


def fill_timestamps(parsed: DataFrame) -> DataFrame:
    """`date`: the line's own stamp, else the last one before it in the file, else the file name's, else ''."""
    scanned = prefix_scan(parsed, ["path"], ["line_no"], {"_last_ts": ("last", F.col("ts"))}, FILE_BLOCKS)
    return _filled(scanned).drop("_last_ts")


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.coalesce("_last_ts", "file_ts", F.lit("")))


def attribute(parsed: DataFrame, folders: DataFrame | None = None, keep_unknown: bool = False) -> DataFrame:
    """Add `date` and `character`. A welcome line switches the character for itself and what follows.

    Both running values come from one scan over the file. Lines before the first welcome of a loose file
    have no character and are dropped unless keep_unknown is set.
    """
    folders = folder_character(parsed) if folders is None else folders
    # the folder's fallback joins the block summaries, not the lines
    scanned = prefix_scan(parsed, ["root_no", "folder", "path"], ["line_no"],
                          {"_last_ts": ("last", F.col("ts")), "_active": ("last", F.col("welcome"))}, FILE_BLOCKS, attach=folders)
    out = _filled(scanned)
    out = out.withColumn("folder_character", F.when(~F.col("loose"), F.col("folder_character")))
    out = out.withColumn("character", F.coalesce("_active", "folder_character")).drop("_last_ts", "_active")
    return out if keep_unknown else out.filter(F.col("character").isNotNull())


def undetermined_files(parsed: DataFrame) -> DataFrame:
    """Loose files without any welcome line: nobody to attribute them to."""
    return (parsed.filter("loose").groupBy("path").agg(F.count("welcome").alias("_n"))
            .filter("_n = 0").select("path"))


def _welcomed() -> Column:
    """The start-date rule looks at the trimmed line; switching the character looks at the line as it is."""
    m = S.ltrim_all("message")
    return F.coalesce(welcome_login(m), welcome_back(m)).isNotNull()


def _per_file(attributed: DataFrame) -> DataFrame:
    """One row per file with a folder character: does it have a login, any welcome, and its first date."""
    seen = attributed.filter(F.col("folder_character").isNotNull())
    return seen.groupBy("path", "folder_character").agg(
        F.count("login").alias("logins"), F.count_if(_welcomed()).alias("welcomes"),
        F.min_by("date", F.when(F.col("date") != "", F.col("line_no"))).alias("first_date"))


def logins(attributed: DataFrame) -> DataFrame:
    """One per login line, plus one for the folder character of every file without a login line."""
    own = attributed.filter("login is not null").groupBy("character").agg(F.count("*").alias("n"))
    fallback = _per_file(attributed).filter("logins = 0").groupBy(F.col("folder_character").alias("character")).agg(
        F.count("*").alias("n"))
    return own.unionByName(fallback).groupBy("character").agg(F.sum("n").alias("logins"))


def start_dates(attributed: DataFrame) -> DataFrame:
    """Earliest dated welcome; a file without a welcome counts with its first date for its folder character."""
    own = attributed.filter(_welcomed() & (F.col("date") != "")).select("character", "date")
    fallback = _per_file(attributed).filter("welcomes = 0 and first_date is not null").select(
        F.col("folder_character").alias("character"), F.col("first_date").alias("date"))
    return own.unionByName(fallback).groupBy("character").agg(F.min("date").alias("start_date"))
