"""Writers: exports, the bestiary file, and the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.session import materialise

# layout of the derived tables: the big ones are split by a hash of the character, so that a hot character
# never decides a file's size and a report on one character reads one bucket
BUCKETS = 64
ROWS_PER_FILE = 4_000_000
MOST_HOT = 200_000
BUCKETED = {"events", "kill_hourly", "log_lines"}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files, each with the header line; cells are quoted where they hold a comma, a quote or a line end."""
    cells = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    cells.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_bestiary(bestiary: DataFrame, path: str, source_name: str) -> None:
    """Entries by name, with the version taken from the name of the dump they came from."""
    version = S.version_from_filename(F.lit(source_name))
    bestiary.withColumn("version", version).orderBy("name").write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One Parquet folder per rollup; large ones in character buckets.

    The rows of a bucket go to one task and file, but those of a character with more than `rows_per_file` are dealt over as many files as that takes, planned from a count per
    character. Readers need not know: all files of a bucket are in its folder.
    """
    for name, df in tables.items():
        if name in BUCKETED:
            hot, files = _files_of(df, rows_per_file)
            dealt = df.withColumn("bucket", F.pmod(F.xxhash64("character"), F.lit(buckets))).join(hot, "character", "left")
            slice_ = F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1)))  # equal rows stay together
            dealt.withColumn("_slice", slice_).repartition(2 * (buckets + files), "bucket", "_slice").drop("_files", "_slice").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def _files_of(df: DataFrame, rows_per_file: int) -> tuple[DataFrame, int]:
    """(character, _files) of the characters that need several files, and how many that are in all: at most one for every `rows_per_file` rows of the table, so few that they are broadcast unless the table is
    beyond MOST_HOT such files."""
    hot = materialise(df.groupBy("character").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_file).select("character", F.ceil(F.col("n") / rows_per_file).alias("_files")))
    characters, files = hot.agg(F.count("*"), F.coalesce(F.sum("_files"), F.lit(0))).first()
    return F.broadcast(hot) if characters <= MOST_HOT else hot, files


def read_table(spark: SparkSession, path: str, name: str, character: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    if name in BUCKETED:
        if character is not None:
            df = df.filter(F.col("bucket") == F.pmod(F.xxhash64(F.lit(character)), F.lit(buckets)))
        df = df.drop("bucket")
    return df if character is None else df.filter(F.col("character") == character)
