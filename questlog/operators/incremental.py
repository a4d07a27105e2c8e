"""Incremental ingest: which files to read, from where, and what a new manifest says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.functions.grammar import VERBS
from questlog.operators.rollups import COUNTERS
from questlog.session import materialise

BROADCAST_PATHS = 200_000


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def plan_scan(files: DataFrame, manifest: DataFrame, force: bool = False, order: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(path, action, offset, content_hash, length) for every candidate file.

    `files(path, length, content)`, `manifest(path, content_hash, byte_len)`. Bytes are not shuffled while at most BROADCAST_PATHS files are open. Actions: scan, tail, skip,
    duplicate, changed, and error for a file that is to be read but has no content. Copies of one content inside the batch count as duplicates of the first in scan
    order: found by an aggregate on the hash, so any number of copies is one partial minimum per task.

    A new file also is a duplicate of what was read before: of every content that the manifest knows, or with `known(content_hash)` of those alone.
    """
    order = order or ["path"]
    prior = manifest.select("path", F.col("byte_len").alias("_len"), F.col("content_hash").alias("_hash"))
    # first the sizes alone decide which files are open; only those are read, hashed once and written
    sized = materialise(files.select("path", "length", F.struct(*order).alias("_at")).join(prior, "path", "left"))
    same_size = F.col("_len") == F.col("length")
    needs = F.lit(True) if force else F.col("_len").isNull() | ((F.col("_len") > 0) & ~same_size)
    open_ = materialise(sized.filter(needs).select("path", "length", "_len"))
    wanted = open_.drop("length")
    if open_.count() <= BROADCAST_PATHS:
        wanted = F.broadcast(wanted)
    hashed = materialise(files.select("path", "content").join(wanted, "path").select(
        "path", content_hash(F.col("content")).alias("content_hash"),
        F.when(F.octet_length("content") > F.col("_len"), content_hash(F.substring(F.col("content"), F.lit(1), F.col("_len").cast("int")))).alias("_prefix")))
    f = sized.join(hashed, "path", "left")
    if force:
        return f.select("path", F.lit("scan").alias("action"), F.lit(0).cast("bigint").alias("offset"), "content_hash", "length")
    known = (manifest if known is None else known).select("content_hash").distinct().withColumn("_known", F.lit(True))
    fresh = f.filter("_len is null")
    first = fresh.groupBy("content_hash").agg(F.min("_at").alias("_first"))
    unread = f.filter(F.col("content_hash").isNull() & (F.col("_len").isNull() | ((F.col("_len") > 0) & ~same_size))).select(
        "path", F.lit("error").alias("action"), F.lit(0).cast("bigint").alias("offset"), "content_hash", "length")
    new = fresh.join(first, "content_hash").join(known, "content_hash", "left").select(
        "path", F.when(F.col("_known") | (F.col("_at") != F.col("_first")), F.lit("duplicate")).otherwise(F.lit("scan")).alias("action"),
        F.lit(0).cast("bigint").alias("offset"), "content_hash", "length")
    old = f.filter(F.col("_len").isNotNull() & (F.col("content_hash").isNotNull() | (F.col("_len") <= 0) | same_size)).select(
        "path",
        F.when((F.col("_len") <= 0) | same_size, F.lit("skip"))
        .when((F.col("length") > F.col("_len")) & (F.col("_prefix") == F.col("_hash")), F.lit("tail")).otherwise(F.lit("changed")).alias("action"),
        F.col("_len"), "content_hash", "length")
    old = old.withColumn("offset", F.when(F.col("action") == "tail", F.col("_len")).otherwise(F.lit(0)).cast("bigint"))
    return new.unionByName(old.select("path", "action", "offset", "content_hash", "length")).unionByName(unread)


# Fixed texts of the process log.
MESSAGES = {
    "duplicate": ("info", "Skipped duplicate file (same content already scanned): "),
    "changed": ("warn", "Log file changed unexpectedly (rotated/truncated); skipped — run Rescan Logs to reconcile: "),
    "error": ("error", "Could not read file: "),
}


def plan_messages(plan: DataFrame) -> DataFrame:
    """(level, message, file_path) for every file that the plan leaves out for a reason; unreadable files are named by their whole path."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for a, m in MESSAGES.items() for x in (a, m[i])]), F.col("action"))
    name = F.when(F.col("action") == "error", F.col("path")).otherwise(F.element_at(F.split("path", "/"), -1))
    return plan.filter(F.col("action").isin(list(MESSAGES))).select(pick(0).alias("level"), F.concat(pick(1), name).alias("message"), F.col("path").alias("file_path"))


def plan_report(plan: DataFrame) -> DataFrame:
    """One row: files scanned (whole or from an offset), skipped for any reason, and unreadable; bytes to read."""
    a = F.col("action")
    return plan.agg(F.count_if(a.isin("scan", "tail")).alias("files_scanned"), F.count_if(a.isin("skip", "duplicate", "changed")).alias("files_skipped"), F.count_if(a == "error").alias("errors"),
                    F.coalesce(F.sum(F.when(a.isin("scan", "tail"), F.col("length") - F.col("offset"))), F.lit(0)).alias("bytes"))


def pending(plan: DataFrame, undetermined: DataFrame | None = None) -> DataFrame:
    """Files a scan would touch; loose files that nobody can be attributed to are left out."""
    rows = plan.filter(F.col("action").isin("scan", "tail"))
    if undetermined is not None:
        rows = rows.join(undetermined.select("path"), "path", "left_anti")
    return rows


def update_manifest(manifest: DataFrame, plan: DataFrame, read_at: str) -> DataFrame:
    """The newest state per path after the planned files were read."""
    read = plan.filter(F.col("action").isin("scan", "tail")).select(
        "path", "content_hash", F.col("length").alias("byte_len"), F.lit(read_at).alias("date_read"), F.lit(1).alias("_new"))
    old = manifest.select("path", "content_hash", "byte_len", "date_read", F.lit(0).alias("_new"))
    latest = old.unionByName(read).groupBy("path").agg(F.max_by(F.struct("content_hash", "byte_len", "date_read"), "_new").alias("m"))
    return latest.select("path", "m.*")


def with_byte_offsets(lines: DataFrame) -> DataFrame:
    """Byte position of each line's start in its file; scanned in blocks like every running value.

    `raw_len` and `head_len` of `decode_lines(positions=True)` give it for any encoding and line ends. Lines without them count as UTF-8
    with LF line ends, as the rendered log has.
    """
    from questlog.operators.scan import FILE_BLOCKS, line_block, prefix_scan
    sized = lines.withColumn("line_block", line_block())
    raw = "raw_len" in lines.columns
    size = F.col("raw_len") if raw else (F.octet_length("content") + 1).cast("bigint")
    out = prefix_scan(sized, ["path"], ["line_no"], {"byte_pos": ("sum", size)}, FILE_BLOCKS, inclusive=False)
    return out.withColumn("byte_pos", F.coalesce("byte_pos", F.lit(0)) + F.col("head_len")).drop("raw_len", "head_len") if raw else out


def tail_lines(attributed: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines at or after each file's offset, attributed from the whole file so that the tail starts with the
    character that was active before it. `attributed` carries `byte_pos`."""
    p = plan.filter(F.col("action").isin("scan", "tail")).select("path", "offset")
    return attributed.join(p, "path").filter(F.col("byte_pos") >= F.col("offset")).drop("offset")


def fold_kills(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two partial kill rollups of disjoint lines; every column merges by sum, min, or max.

    `old` comes first in scan order, so its first date wins where it has one.
    """
    keys = ["character", "creature"]
    both = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in [*COUNTERS, "killed_by_count"]],
        F.min_by("date_first", F.when(F.col("date_first").isNotNull(), F.col("_part"))).alias("date_first"), F.max("date_last").alias("date_last"),
        *[F.min(f"date_first_{v}").alias(f"date_first_{v}") for v in VERBS], *[F.max(f"date_last_{v}").alias(f"date_last_{v}") for v in VERBS],
        F.max("creature_value").alias("creature_value"))


def fold_hourly(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("character", "creature", "hour").agg(*[F.sum(c).alias(c) for c in COUNTERS])
