"""Registered queries over the rendered log."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlog.functions import scalars as S
from questlog.functions.grammar import EVENT_FIELDS
from questlog.operators import attribution as AT
from questlog.operators import rankings as RK
from questlog.operators import rollups as R
from questlog.operators import sequences as Q
from questlog.operators import updating as U
from questlog.operators.scan import seq
from questlog.plans import adapters as A
from questlog.session import scratch_path


@cache
def gated(spark: SparkSession, d: str) -> DataFrame:
    return Q.gate_ranks(A.log_events(spark, d), A.overrides(spark, d))


def filename_date(spark, d):
    lines = A.render_log(spark, d)
    return lines.select("path", S.filename_date(F.element_at(F.split("path", "/"), -1)).alias("file_ts")).distinct()


def line_timestamp(spark, d):
    return A.render_log(spark, d).select("path", "line_no", S.parse_line_ts("content")["ts"].cast("string").alias("ts"))


def ts_fallback(spark, d):
    return AT.fill_timestamps(A.parsed_log(spark, d)).select("path", "line_no", "date")


def classify_lines(spark, d):
    from questlog.functions.grammar import classify
    ev = classify(A.parsed_log(spark, d), "message", A.trainer_messages(spark))
    return ev.select("path", "line_no", "kind", *[c for c in EVENT_FIELDS if c != "text"],
                     F.when(F.col("kind") == "ProfessionAnnouncement", F.col("text")).alias("profession"))


def active_character(spark, d):
    return A.attributed_log(spark, d).select("path", "line_no", "character")


def folder_character(spark, d):
    return AT.folder_character(A.parsed_log(spark, d)).select("folder", "folder_character")


def undetermined_files(spark, d):
    return AT.undetermined_files(A.parsed_log(spark, d))


def logins(spark, d):
    return AT.logins(A.attributed_log(spark, d))


def start_date(spark, d):
    return AT.start_dates(A.attributed_log(spark, d))


def deaths(spark, d):
    return R.deaths(A.log_events(spark, d))


def rank_gate(spark, d):
    return gated(spark, d).select("path", "line_no", "character", "trainer", "counted")


def rank_skips(spark, d):
    return Q.rank_skips(gated(spark, d))


def bow_checkpoint(spark, d):
    return Q.bow_checkpoints(A.log_events(spark, d)).select(
        "character", "trainer", "rank_min", "rank_max", "date", "path", "line_no")


@cache
def checkpoints(spark, d):
    return Q.checkpoints(A.log_events(spark, d))


def checkpoint_all(spark, d):
    return RK.checkpoint_history(checkpoints(spark, d)).select("character", "trainer", "rank_min", "rank_max", "date")


def checkpoint_latest(spark, d):
    return RK.latest_checkpoints(checkpoints(spark, d))


def top_checkpoints(spark, d):
    return RK.top_checkpoints(checkpoints(spark, d))


def reflect_lists(spark, d):
    return Q.reflect_lists(A.log_events(spark, d))


def study_gate(spark, d):
    return Q.gate_studies(A.log_events(spark, d)).select("path", "line_no", "character", "creature", "kind")


def departs(spark, d):
    return Q.departs(A.log_events(spark, d), seq())


def best_loot(spark, d):
    return Q.best_loot(A.log_events(spark, d), seq())


def kills_rollup(spark, d):
    ev = A.log_events(spark, d)
    return R.with_best_loot(R.kills(ev, A.bestiary(spark, d).select("name", "value")), Q.best_loot(ev, seq()))


def kill_hourly(spark, d):
    return R.kill_hourly(A.log_events(spark, d))


def character_counters(spark, d):
    return R.character_counters(A.log_events(spark, d))


def fishing_catches(spark, d):
    return R.fishing_catches(A.log_events(spark, d)).select("character", S.verb_text(F.col("fishing_catches")).alias("catches"))


def trainer_ranks(spark, d):
    return R.trainer_ranks(gated(spark, d), A.trainer_meta(spark))


def announced_profession(spark, d):
    return R.announced_profession(A.log_events(spark, d))


def log_lastys(spark, d):
    ev = A.log_events(spark, d)
    return R.lastys(ev, Q.reflect_lists(ev))


def scan_report(spark, d):
    ev = A.log_events(spark, d)
    parsed = A.parsed_log(spark, d)
    lost = AT.undetermined_files(parsed).withColumn("_lost", F.lit(True))
    marked = parsed.join(lost, "path", "left").withColumn("undetermined", F.coalesce("_lost", F.lit(False)))
    return R.scan_report(marked, ev, gated(spark, d), Q.bow_checkpoints(ev), Q.gate_studies(ev))


def process_log(spark, d):
    parsed = A.parsed_log(spark, d)
    msgs = R.scan_messages(parsed, A.log_events(spark, d), Q.rank_skips(gated(spark, d)), AT.undetermined_files(parsed))
    return msgs.join(R.process_log_counts(msgs).withColumnRenamed("n", "of_level"), "level")


# --- updates: the log arrives in three deliveries, and every rollup must equal that of one scan -------------------

@cache  # written once per session: the tables that the updates below publish
def updated(spark: SparkSession, d: str):
    """A scan of the first half of most files, an update by the files that came later (between the others in scan order), and one by
    the tails."""
    ev, root = A.log_events(spark, d), scratch_path(spark)
    half = ev.agg(F.floor(F.max("line_no") / 2)).first()[0] or 0
    late, tail = F.pmod(F.crc32("path"), F.lit(5)) == 0, F.col("line_no") >= half
    settings = {"overrides": A.overrides(spark, d), "values": A.bestiary(spark, d).select("name", "value"), "meta": A.trainer_meta(spark)}
    U.rescan(spark, root, ev.filter(~late & ~tail), **settings)
    U.update(spark, root, ev.filter(late), **settings)
    return U.update(spark, root, ev.filter(~late & tail), **settings)


def updated_kills(spark, d):
    return updated(spark, d).read(spark, "kill_table")


def updated_hours(spark, d):
    return updated(spark, d).read(spark, "kill_hours")


def updated_ranks(spark, d):
    return updated(spark, d).read(spark, "trainer_ranks")


def updated_counters(spark, d):
    return updated(spark, d).read(spark, "character_counters")


def updated_fishing(spark, d):
    return updated(spark, d).read(spark, "fishing_catches").select("character", S.verb_text(F.col("fishing_catches")).alias("catches"))


def updated_loot(spark, d):
    return updated(spark, d).read(spark, "best_loot")


def updated_departs(spark, d):
    return updated(spark, d).read(spark, "depart_counts")


def updated_checkpoints(spark, d):
    return RK.checkpoint_history(updated(spark, d).read(spark, "checkpoint_table")).select("character", "trainer", "rank_min", "rank_max", "date")


def updated_professions(spark, d):
    return updated(spark, d).read(spark, "announced")


def updated_studies(spark, d):
    return updated(spark, d).read(spark, "study_table")


def process_log_page(spark, d):
    """The newest 50 warnings, by the dates of their files."""
    parsed = A.parsed_log(spark, d)
    msgs = R.scan_messages(parsed, A.log_events(spark, d), Q.rank_skips(gated(spark, d)), AT.undetermined_files(parsed))
    dated = msgs.withColumn("logged_at", S.filename_date(F.element_at(F.split("file_path", "/"), -1)))
    return R.process_log(dated, level="warn", limit=50).select("logged_at", "message")


QUERIES = {f.__name__: f for f in (
    filename_date, line_timestamp, ts_fallback, classify_lines, active_character, folder_character, undetermined_files, logins,
    start_date, deaths, rank_gate, rank_skips, bow_checkpoint, checkpoint_all, checkpoint_latest, top_checkpoints, reflect_lists,
    study_gate, departs, best_loot, kills_rollup, kill_hourly, character_counters, fishing_catches, trainer_ranks,
    announced_profession, log_lastys, scan_report, process_log, process_log_page,
    updated_kills, updated_hours, updated_ranks, updated_counters, updated_fishing, updated_loot, updated_departs, updated_checkpoints, updated_professions,
    updated_studies)}
