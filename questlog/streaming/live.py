"""Live feeds: the same events from files as they arrive.

Lateness is one day. `stream_hourly` leaves later lines to the batch rebuild; `hourly_sink` keeps them aside and `fold_late` counts their hours anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from questlog.sources import generations as G

LATENESS = "1 day"
LINE = "path string, line_no bigint, kind string, creature string, lasty_type string, trainer string, subject string, flag boolean, rank_min bigint, rank_max bigint, date string"
STEPS = ("greeted", "bowed", "spoken")


def stream_hourly(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Kills per (character, creature, hour) of a stream of classified lines; a line seen twice counts once.

    `events(path, line_no, character, creature, kind, date)`; watermarks need TIMESTAMP, hence the cast. Lines without a time belong
    to no hour. In append mode an hour is given once it is `lateness` old, and its state goes.
    """
    kills = events.filter(F.col("kind").isin("SoloKill", "AssistedKill")).withColumn("at", F.try_to_timestamp("date")).filter("at is not null")
    once = kills.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["path", "line_no"])
    return once.groupBy("character", "creature", F.window("at", "1 hour")).agg(
        F.count_if(F.col("kind") == "SoloKill").alias("solo"), F.count_if(F.col("kind") == "AssistedKill").alias("assisted")).select(
        "character", "creature", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "solo", "assisted")


BUCKETS = 256  # of files or creatures: a call of Python, and a small Arrow batch, for each of those would be most of the work


def bucketed(df: DataFrame, *keys: str) -> GroupedData:
    """`df` dealt into buckets by keys; what is remembered of a key stands in a map of its bucket."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


def _names(batch: pd.DataFrame, active: dict[str, str | None]) -> tuple[pd.Series, dict[str, str]]:
    """The active character of each line of a batch that is in order of path and line, and the last one welcomed of each file. `active` are those from before the batch."""
    welcome = batch["welcome"].astype(object).where(batch["welcome"].notna(), None)
    names = welcome.groupby(batch["path"]).ffill()
    names = names.where(names.notna(), batch["path"].map(active))
    names = names.where(names.notna(), batch["folder_character"].astype(object))
    said = welcome.notna()
    return names.astype(object), dict(zip(batch.loc[said, "path"], welcome[said]))  # of one path the last line stays


class ActiveCharacter(StatefulProcessor):
    """Per bucket of files: the active character of each, carried from batch to batch. Lines of a batch are put in order first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._active = handle.getMapState("active", "path string", "name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch delivers bounded chunks of the files of a bucket
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["path", "line_no"], ignore_index=True)
        known = {p: self._active.getValue((p,)) for p in batch["path"].unique()}
        names, last = _names(batch, {p: v[0] if v else None for p, v in known.items()})
        for path, name in last.items():
            self._active.updateValue((path,), (str(name),))
        yield pd.DataFrame({"path": batch["path"].astype(object), "line_no": batch["line_no"], "character": names})

    def close(self) -> None:
        pass


def stream_attribute(lines: DataFrame) -> DataFrame:
    """(path, line_no, character) of a stream of parsed lines `(path, line_no, welcome, folder_character)`."""
    return bucketed(lines, "path").transformWithStateInPandas(
        statefulProcessor=ActiveCharacter(), outputStructType="path string, line_no bigint, character string",
        outputMode="Append", timeMode="None")


class LiveFile(StatefulProcessor):
    """Per bucket of files: of each file the active character, and of each of its trainers the last greeting, bow and phrase, carried from batch to batch. State is
    read and written once per file of a batch; only lines that can move a bow sequence are walked one by one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._files = handle.getMapState("files", "path string", "name string, bows string")

    def _read(self, path: str) -> tuple[str | None, dict[str, list[int]]]:
        found = self._files.getValue((path,))
        return (found[0], json.loads(found[1])) if found else (None, {})

    def _write(self, path: str, name: str | None, bows: dict[str, list[int]]) -> None:
        self._files.updateValue((path,), (name, json.dumps(bows)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """What a batch rebuild knows of files (`state_of`): `welcome`, or the steps of one trainer."""
        for path, rows in initialState.groupby("path"):
            name, bows = self._read(path)
            for row in rows.itertuples():
                if pd.notna(row.welcome):
                    name = row.welcome
                if pd.notna(row.trainer):
                    bows[row.trainer] = [int(getattr(row, s)) if pd.notna(getattr(row, s)) else -1 for s in STEPS]
            self._write(path, name, bows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["path", "line_no"], ignore_index=True)  # a micro-batch's lines of one bucket
        known = {p: self._read(p) for p in batch["path"].unique()}
        names, last = _names(batch, {p: name for p, (name, _) in known.items()})
        confirmed = [False] * len(batch)
        changed = set(last)
        moves = batch["kind"].isin(["TrainerGreetingSimple", "TrainerGreetingWithUnknownCheckpoint", "TrainerBow", "TrainerCheckpointUnhailed"])
        walked = batch[moves]
        for i, path, trainer, kind, line, subject, name in zip(walked.index, walked["path"], walked["trainer"], walked["kind"], walked["line_no"], walked["subject"], names[moves]):
            steps = known[path][1].setdefault(trainer, [-1, -1, -1])
            changed.add(path)
            greeted, bowed, spoken = steps
            if kind == "TrainerBow":
                steps[1] = int(line)
            elif kind == "TrainerCheckpointUnhailed":
                confirmed[i] = greeted > spoken and bowed > greeted
                steps[2] = int(line)
            elif str(subject).lower() == str(name).lower():
                steps[0] = int(line)
        for path in changed:
            self._write(path, last.get(path, known[path][0]), known[path][1])
        yield batch.assign(character=names, confirmed=confirmed)[[*(c.split()[0] for c in LINE.split(", ")), "character", "confirmed"]]

    def close(self) -> None:
        pass


class LiveStudies(StatefulProcessor):
    """Per bucket of (character, creature): is the study abandoned? Progress lines of an abandoned one go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._gone = handle.getMapState("gone", "character string, creature string", "gone boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self._gone.updateValue((row.character, row.creature), (bool(row.gone),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["path", "line_no"], ignore_index=True)
        study = batch.groupby(["character", "creature"], dropna=False).ngroup()
        named = batch[["character", "creature"]].assign(study=study).drop_duplicates("study")
        keys = {n: (c, d) for n, c, d in zip(named["study"], named["character"], named["creature"])}
        gone = {n: self._gone.getValue(k) for n, k in keys.items()}
        state = batch["kind"].map({"StudyAbandon": True, "LastyBeginStudy": False, "LastyFinished": False}).astype(object)
        state = state.where(state.notna(), None)
        before = state.groupby(study).shift(1).groupby(study).ffill()
        before = before.where(before.notna(), study.map({n: bool(g[0]) if g else False for n, g in gone.items()})).astype(bool)
        said = state.notna()
        for n, last in dict(zip(study[said], state[said])).items():
            if gone[n] is None or bool(gone[n][0]) != last:
                self._gone.updateValue(keys[n], (bool(last),))
        yield batch[~((batch["kind"] == "LastyProgress") & before)][["path", "line_no", "character", "creature", "kind"]]

    def close(self) -> None:
        pass


def state_of(attributed: DataFrame) -> DataFrame:
    """What a live feed must know of the files that a batch has read: (path, welcome) and (path, trainer, greeted, bowed, spoken). `attributed` are classified lines with
    their character."""
    from questlog.operators.sequences import bow_steps

    last = lambda step: F.max(F.when(F.col("step") == step, F.col("line_no"))).alias(step)
    names = attributed.groupBy("path").agg(F.max_by("welcome", F.when(F.col("welcome").isNotNull(), F.col("line_no"))).alias("welcome"))
    bows = bow_steps(attributed).groupBy("path", "trainer").agg(*[last(s) for s in STEPS])
    return names.unionByName(bows, allowMissingColumns=True)


def studies_state_of(events: DataFrame) -> DataFrame:
    """(character, creature, gone) after the lines that a batch has read."""
    from questlog.operators.scan import seq

    state = F.when(F.col("kind") == "StudyAbandon", F.lit(True)).when(F.col("kind").isin("LastyBeginStudy", "LastyFinished"), F.lit(False))
    return events.groupBy("character", "creature").agg(F.max_by(state, F.when(state.isNotNull(), seq())).alias("gone")).filter("gone is not null")


def stream_lines(lines: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Classified lines of a feed with their `character`, and `confirmed` for phrases that end a bow sequence.

    `lines` have the columns of LINE, `welcome` and `folder_character`; `initial` is what `state_of` gives for lines read before. Lines of a file must come in order over the
    batches, in any order inside one. Lines that nobody can be given to are dropped. State is a name and three line numbers per trainer for each file, in maps of BUCKETS groups; time-to-live would need processing-time
    batches, which never end under `availableNow`, so a feed is trimmed by starting it anew from `initial`.
    """
    rows = lines.select(*[c.split()[0] for c in LINE.split(", ")], "welcome", "folder_character")
    found = bucketed(rows, "path").transformWithStateInPandas(
        statefulProcessor=LiveFile(), outputStructType=f"{LINE}, character string, confirmed boolean", outputMode="Append", timeMode="None",
        initialState=bucketed(initial, "path") if initial is not None else None)
    return found.filter("character is not null")


def stream_studies(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The study lines of a feed (`path, line_no, character, creature, kind`) without progress on an abandoned creature; a creature's lines must come in scan order over the
    batches. `initial` is what `studies_state_of` gives for lines read before."""
    from questlog.operators.sequences import STUDY_KINDS

    studies = events.filter(F.col("kind").isin(STUDY_KINDS)).select("path", "line_no", "character", "creature", "kind")
    return bucketed(studies, "character", "creature").transformWithStateInPandas(
        statefulProcessor=LiveStudies(), outputStructType="path string, line_no bigint, character string, creature string, kind string", outputMode="Append", timeMode="None",
        initialState=bucketed(initial, "character", "creature") if initial is not None else None)


# ---- hourly kills with late lines: one published generation per batch

HOUR = "character string, creature string, hour string, solo bigint, assisted bigint"
KILL = "path string, line_no bigint, character string, creature string, kind string, at timestamp"
HOUR_KEYS = ["character", "creature", "hour"]


def _kills(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("kind").isin("SoloKill", "AssistedKill")).withColumn("at", F.try_to_timestamp("date")).filter("at is not null").select(
        *(c.split()[0] for c in KILL.split(", ")))


def hours_of(kills: DataFrame) -> DataFrame:
    return kills.groupBy("character", "creature", F.date_format("at", "yyyy-MM-dd HH").alias("hour")).agg(
        F.count_if(F.col("kind") == "SoloKill").alias("solo"), F.count_if(F.col("kind") == "AssistedKill").alias("assisted"))


def hourly_sink(root: str, lateness: str = LATENESS) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch` over classified lines `(path, line_no, character, creature, kind, date)`: tables in `root`, a generation per batch.

    `hours` are counts to be summed (`read_hours`), `late` the kills that came more than `lateness` after the newest of the batches before, `recent` the keys of those counted within
    that time: a line that is delivered twice counts once, and what must be remembered is bounded by the lateness. Data and the number of the
    batch are published by one rename; a batch that is replayed finds its number taken and changes nothing.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = G.current(spark, root)
        if old is not None and old.number >= epoch:
            return
        folder = G.new_folder(root, epoch)
        kills = _read(spark, G.write(_kills(batch).dropDuplicates(["path", "line_no"]), folder, "kills"), KILL)
        clock = old.read(spark, "clock").first()["newest"] if old is not None else None
        limit = F.lit(clock).cast("timestamp") - F.expr(f"interval {lateness}")
        in_time = F.lit(True) if clock is None else F.col("at") >= limit
        counted = kills.filter(in_time)
        if old is not None:
            counted = counted.join(old.read(spark, "recent").select("path", "line_no"), ["path", "line_no"], "left_anti")
        newest = max((t for t in (clock, kills.agg(F.max("at")).first()[0]) if t is not None), default=None)
        kept = counted.select("path", "line_no", "at").unionByName(old.read(spark, "recent")) if old is not None else counted.select("path", "line_no", "at")
        tables = {
            "hours": G.write(hours_of(counted), folder, "hours"), "late": G.write(kills.filter(~in_time), folder, "late"),
            "recent": G.write(kept.filter(F.col("at") >= F.lit(newest).cast("timestamp") - F.expr(f"interval {lateness}")), folder, "recent"),
            "clock": G.write(spark.createDataFrame([(newest,)], "newest timestamp"), folder, "clock")}
        before = {n: old.tables[n] if old is not None and n in ("hours", "late") else [] for n in tables}
        schemas = {n: _read(spark, path, None).schema.json() for n, path in tables.items()}
        G.publish(spark, root, G.Generation(epoch, {n: [*before[n], path] for n, path in tables.items()}, schemas))

    return apply


def _read(spark, path: str, schema: str | None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_hours(spark, root: str) -> DataFrame:
    """The counts of `root` as published last."""
    return G.current(spark, root).read(spark, "hours").groupBy(*HOUR_KEYS).agg(F.sum("solo").alias("solo"), F.sum("assisted").alias("assisted"))


def fold_late(hours: DataFrame, late: DataFrame, lines: DataFrame) -> DataFrame:
    """`hours` with those that late kills touch counted anew from all `lines`, so that a late copy of a counted line counts once; to be run by the rebuild, which has all lines."""
    touched = late.select("character", "creature", F.date_format("at", "yyyy-MM-dd HH").alias("hour")).distinct()
    anew = hours_of(_kills(lines).dropDuplicates(["path", "line_no"])).join(touched, HOUR_KEYS, "left_semi")
    return hours.join(touched, HOUR_KEYS, "left_anti").unionByName(anew)
