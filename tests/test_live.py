"""Live feeds: state handed over from a batch, late and repeated lines, replayed batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_ordered import events

from questlog.operators import incremental as IN
from questlog.operators import reports as RP
from questlog.operators import sequences as Q
from questlog.sources import generations as G
from questlog.streaming import live

KINDS = ["TrainerGreetingSimple", "TrainerGreetingSimple", "TrainerBow", "TrainerCheckpointUnhailed", "StudyAbandon", "LastyBeginStudy", "LastyProgress", "LastyProgress", "LastyFinished", "Ignored"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def _run(frame, path):
    frame.writeStream.outputMode("append").option("checkpointLocation", path + "/state").format("parquet").option("path", path + "/out").trigger(availableNow=True).start().awaitTermination()


def test_a_feed_goes_on_where_a_batch_ended(spark, tmp_path, rocks):
    """The first half of every file is read by a batch, the second by a stream that starts from its state."""
    rng = random.Random(8)
    rows = []
    for f in range(4):
        name = None
        for i in range(50):
            welcome = rng.choice(["Ann", "Bob"]) if rng.random() < 0.1 else None
            name = welcome or name
            rows.append({"path": f"/f/{f}", "line_no": i, "kind": rng.choice(KINDS), "trainer": rng.choice("xy"), "subject": rng.choice(["ANN", "bob"]), "creature": rng.choice(["Rat", "Cat"]), "rank_min": i, "rank_max": i,
                         "lasty_type": "Morph", "character": name or "Cid", "welcome": welcome})
    welcomes = spark.createDataFrame([(r["path"], r["line_no"], r["welcome"]) for r in rows], "path string, line_no bigint, welcome string")
    every = events(spark, [{k: v for k, v in r.items() if k != "welcome"} for r in rows]).join(welcomes, ["path", "line_no"])
    old, new = every.filter("line_no < 25"), every.filter("line_no >= 25")
    root = str(tmp_path)
    columns = [c.split()[0] for c in live.LINE.split(", ")]
    new.select(*columns, "welcome", F.lit("Cid").alias("folder_character")).write.parquet(root + "/in")
    _run(live.stream_lines(spark.readStream.schema(f"{live.LINE}, welcome string, folder_character string").parquet(root + "/in"), live.state_of(old)), root + "/lines")
    got = spark.read.parquet(root + "/lines/out")
    assert {(r["path"], r["line_no"], r["character"]) for r in got.collect()} == {(r["path"], r["line_no"], r["character"]) for r in rows if r["line_no"] >= 25}
    want = {(r["path"], r["line_no"]) for r in Q.bow_checkpoints(every).filter("line_no >= 25").collect()}
    assert {(r["path"], r["line_no"]) for r in got.filter("confirmed").collect()} == want and want

    # studies of a character go over files: here the batch has the first files, the stream the last
    first, last = every.filter("path < '/f/2'"), every.filter("path >= '/f/2'")
    last.select("path", "line_no", "character", "creature", "kind").write.parquet(root + "/in2")
    _run(live.stream_studies(spark.readStream.schema("path string, line_no bigint, character string, creature string, kind string").parquet(root + "/in2"), live.studies_state_of(first)), root + "/studies")
    want = {(r["path"], r["line_no"]) for r in Q.gate_studies(every).filter("path >= '/f/2'").collect()}
    assert {(r["path"], r["line_no"]) for r in spark.read.parquet(root + "/studies/out").collect()} == want


def test_late_repeated_and_replayed_lines(spark, tmp_path):
    start = datetime(2024, 1, 1)
    line = lambda i, hours, kind="SoloKill": ("/f/a", i, "Ann", "Rat", kind, (start + timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S") if hours is not None else "")
    batches = [[line(0, 0), line(1, 1, "AssistedKill"), line(1, 1, "AssistedKill"), line(9, None), line(8, 2, "Fallen")], [line(2, 40), line(1, 1, "AssistedKill"), line(3, 39)], [line(3, 39), line(4, 60), line(5, 2), line(6, 17), line(7, 16)], []]
    frame = lambda rows: spark.createDataFrame(rows, "path string, line_no bigint, character string, creature string, kind string, date string")
    root, sink = str(tmp_path), live.hourly_sink(str(tmp_path))
    for k, rows in enumerate(batches):
        sink(frame(rows), k)
        sink(frame(rows), k)  # replayed: changes nothing
        assert G.current(spark, root).number == k
    held = G.current(spark, root)
    hours = {(r["hour"], r["solo"], r["assisted"]) for r in live.read_hours(spark, root).collect()}
    assert hours == {("2024-01-01 00", 1, 0), ("2024-01-01 01", 0, 1), ("2024-01-02 16", 1, 0), ("2024-01-02 15", 1, 0), ("2024-01-03 12", 1, 0), ("2024-01-01 17", 1, 0), ("2024-01-01 16", 1, 0)}
    assert {r["line_no"] for r in held.read(spark, "late").collect()} == {5}  # line 7 is exactly a day behind line 2
    assert {r["line_no"] for r in held.read(spark, "recent").collect()} == {2, 3, 4}
    whole = frame([r for b in batches for r in b])
    folded = {(r["hour"], r["solo"], r["assisted"]) for r in live.fold_late(live.read_hours(spark, root), held.read(spark, "late"), whole).collect()}
    assert folded == hours | {("2024-01-01 02", 1, 0)}


def test_labels_through_aliases(spark):
    bestiary = spark.createDataFrame([("Rat", "Vermin", "Common", True), ("Unseen Fox", "Canine", "Rare", False)], "name string, family string, rarity string, is_seasonal boolean")
    aliases = spark.createDataFrame([("Fox", "Unseen Fox", None), ("Imp", None, (7, "Fiend", "Rare")), ("Gone", "Nobody", None)], "log_name string, resolves_to string, inline struct<value:bigint,family:string,rarity:string>")
    kills = spark.createDataFrame([(c,) for c in ("Rat", "Fox", "the Fox", "Imp", "the Imp", "the Rat", "Gone", "Elk")], "creature string")
    got = {r["creature"]: (r["family_canonical"], r["rarity_canonical"], r["is_seasonal"]) for r in RP.with_labels(kills, bestiary, aliases).collect()}
    rat, fox, imp, none = ("Vermin", "Common", True), ("Canine", "Rare", False), ("Fiend", "Rare", False), (None, None, None)
    assert got == {"Rat": rat, "the Rat": rat, "Fox": fox, "the Fox": fox, "Imp": imp, "the Imp": imp, "Gone": none, "Elk": none}
    assert {r[0] for r in RP.filter_kills(kills, bestiary, family="CANINE", aliases=aliases).collect()} == {"Fox", "the Fox"}
    assert {r[0] for r in RP.filter_kills(kills, bestiary, rarity="unknown", aliases=aliases).collect()} == {"Gone", "Elk"}


def test_unreadable_files(spark):
    files = spark.createDataFrame([("/a/new", 3, None), ("/a/kept", 5, None), ("/a/grown", 9, None), ("/a/twin", 3, b"abc"), ("/a/two", 3, b"abc")], "path string, length long, content binary")
    manifest = spark.createDataFrame([("/a/kept", "x", 5), ("/a/grown", "y", 4)], "path string, content_hash string, byte_len long")
    plan = IN.plan_scan(files, manifest)
    assert {r["path"]: r["action"] for r in plan.collect()} == {"/a/new": "error", "/a/kept": "skip", "/a/grown": "error", "/a/twin": "scan", "/a/two": "duplicate"}
    assert sorted((r["level"], r["message"]) for r in IN.plan_messages(plan).collect()) == [
        ("error", "Could not read file: /a/grown"), ("error", "Could not read file: /a/new"), ("info", "Skipped duplicate file (same content already scanned): two")]
    assert tuple(IN.plan_report(plan).first()) == (1, 2, 2, 3)


def test_a_hot_character_gets_several_files(spark, tmp_path):
    """Half of all rows are one character's; repeated rows and a null character are kept."""
    from questlog.sources.sinks import read_table, write_tables

    rows = [("Hot", i) for i in range(4000)] + [(f"c{i % 300}", i) for i in range(3990)] + [("Hot", 1)] * 5 + [(None, 3)] * 5
    df = spark.createDataFrame(rows, "character string, hour bigint")
    write_tables({"kill_hourly": df}, str(tmp_path), buckets=4, rows_per_file=500)
    files = spark.read.parquet(f"{tmp_path}/kill_hourly").groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in files) < 2600 and sum(r["count"] for r in files) == len(rows)
    hot = spark.read.parquet(f"{tmp_path}/kill_hourly").filter("character = 'Hot'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) >= 3 and max(r["count"] for r in hot) < 2400
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, read_table(spark, str(tmp_path), "kill_hourly").collect()), key=key) == sorted(rows, key=key)
    assert read_table(spark, str(tmp_path), "kill_hourly", "Hot", buckets=4).count() == 4005


class _Maps:
    """A state handle whose maps are dictionaries."""

    def getMapState(self, name, *_):
        held = {}
        return type("Held", (), {"getValue": lambda s, k: held.get(k), "updateValue": lambda s, k, v: held.__setitem__(k, v)})()


def test_one_call_serves_many_files():
    """Lines of several files and creatures, mixed, in one call of Python; what one file or creature left must not reach another."""
    import pandas as pd
    columns = [c.split()[0] for c in live.LINE.split(", ")] + ["welcome", "folder_character"]
    line = lambda path, no, kind="Ignored", **more: {**dict.fromkeys(columns), "path": path, "line_no": no, "kind": kind, "folder_character": "Cid", **more}
    files = live.LiveFile()
    files.init(_Maps())
    first = [line("b", 1), line("a", 2, "TrainerGreetingSimple", trainer="x", subject="ANN"), line("a", 1, welcome="Ann"), line("b", 2, "TrainerBow", trainer="x")]
    second = [line("b", 3, "TrainerCheckpointUnhailed", trainer="x"), line("a", 4, "TrainerCheckpointUnhailed", trainer="x"), line("a", 3, "TrainerBow", trainer="x")]
    run = lambda p, rows: {(r.path, r.line_no): r for f in p.handleInputRows(0, iter([pd.DataFrame(rows)]), None) for r in f.itertuples()}
    assert {k: r.character for k, r in run(files, first).items()} == {("a", 1): "Ann", ("a", 2): "Ann", ("b", 1): "Cid", ("b", 2): "Cid"}
    assert {k: (r.character, r.confirmed) for k, r in run(files, second).items()} == {("a", 3): ("Ann", False), ("a", 4): ("Ann", True), ("b", 3): ("Cid", False)}
    studies = live.LiveStudies()
    studies.init(_Maps())
    study = lambda no, who, kind: {"path": "a", "line_no": no, "character": who, "creature": "Rat", "kind": kind}
    assert set(run(studies, [study(2, "Bob", "LastyProgress"), study(1, "Ann", "StudyAbandon"), study(3, "Ann", "LastyProgress")])) == {("a", 1), ("a", 2)}
    assert set(run(studies, [study(5, "Bob", "LastyProgress"), study(4, "Ann", "LastyProgress"), study(6, "Ann", "LastyBeginStudy"), study(7, "Ann", "LastyProgress")])) == {("a", 5), ("a", 6), ("a", 7)}


def test_rendering_is_spread_over_tasks(spark, tmp_path):
    """One file of one row group is one task of a scan."""
    from questlog.plans import adapters as A
    spark.range(50_000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"),
                               F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey"), F.lit("Rat").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    assert A.render_log(spark, str(tmp_path)).rdd.getNumPartitions() == 3
