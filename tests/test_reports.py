"""Edge cases of reports on small literal tables."""

import random

from pyspark.sql import functions as F

from questlog.operators import incremental as IN
from questlog.operators import search as SE
from questlog.operators.fighter import fighter_stats
from questlog.operators.frequency import kill_frequency
from questlog.operators.merge import merge_map
from questlog.operators.rollups import COUNTERS
from questlog.session import materialise


def hourly(spark, rows):
    """(character, creature, hour, killed, assisted)."""
    df = spark.createDataFrame(rows, "character string, creature string, hour string, killed_count bigint, assisted_kill_count bigint")
    return df.select("character", "creature", "hour", *[F.col(c) if c in df.columns else F.lit(0).cast("bigint").alias(c) for c in COUNTERS])


def test_two_hour_window(spark):
    rows = [("A", "Rat", "2024-01-01 01", 3, 0), ("A", "Rat", "2024-01-01 03", 4, 0), ("A", "Rat", "2024-01-01 04", 2, 1),
            ("A", "Ant", "2024-01-01 23", 1, 0), ("A", "Ant", "2024-01-02 00", 1, 0), ("A", "Bee", "2024-01-01 05", 0, 2)]
    r = {x["creature"]: x for x in kill_frequency(hourly(spark, rows)).collect()}
    assert (r["Rat"]["best_2h_count"], r["Rat"]["best_2h_start"], r["Rat"]["best_day_count"]) == (7, "2024-01-01 03:00", 10)
    assert (r["Ant"]["best_2h_count"], r["Ant"]["best_2h_start"], r["Ant"]["best_day_date"]) == (2, "2024-01-01 23:00", "2024-01-01")
    solo = {x["creature"]: x for x in kill_frequency(hourly(spark, rows), include_assisted=False).collect()}
    assert set(solo) == {"Rat", "Ant"} and solo["Rat"]["best_2h_verbs"] == {"killed": 6}


def test_merged_frequency(spark):
    people = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B")], "character string, merged_into string")
    assert {tuple(r) for r in merge_map(people).collect()} == {("A", "A"), ("B", "A")}
    rows = [("A", "Rat", "2024-01-01 01", 1, 0), ("B", "Rat", "2024-01-01 01", 2, 0), ("C", "Rat", "2024-01-01 01", 9, 0)]
    got = kill_frequency(hourly(spark, rows), merge_map(people)).collect()
    assert [(r["character"], r["best_day_count"]) for r in got] == [("A", 3)]


def test_fighter_stats(spark):
    cols = "character string, trainer string, ranks bigint, modified_ranks bigint, date_of_last_rank string"
    t = spark.createDataFrame([("A", "Heen", 50, 0, None), ("A", "Bangus Anmash", 10, 5, None), ("A", "Stranger", 3, 0, None), ("B", "Knox", 100, 0, None)], cols)
    meta = spark.createDataFrame([("Knox", 1.5)], "trainer string, multiplier double")
    r = {x["character"]: x for x in fighter_stats(t, meta).collect()}
    assert r["A"]["shieldstone_drain"] == 628 and r["A"]["accuracy"] == 330 and r["A"]["slaughter_points"] == 5466 + 1000 + 345 + 60
    assert r["B"]["accuracy"] == -100 and r["B"]["effective_ranks"] == 150.0 and r["B"]["damage_max"] == 3 * 1300 + 100
    assert r["B"]["offense"] == -100 + (3 * 1300 + 1200) // 4 and r["B"]["shieldstone_drain"] == 1066


def test_search(spark):
    lines = [("p", 0, "You see CAFÉ noir here", "A"), ("p", 1, "the cafe noirs", "A"), ("p", 2, "* cafe noir", "B"), ("p", 3, 'Bob says, "cafe noir"', "B"),
             ("q", 0, "   ", "A"), ("q", 1, "word " * 100 + "cafe, noir end", "A")]
    df = spark.createDataFrame(lines, "path string, line_no bigint, content string, character string")
    hits = SE.search(df, None, "Cafe Noir").collect()
    assert [(r["path"], r["line_no"]) for r in hits] == [("q", 1), ("p", 0)]
    assert hits[1]["snippet"] == "You see <mark>CAFÉ noir</mark> here" and hits[0]["snippet"].startswith("...") and hits[0]["snippet"].endswith("noir</mark> end")
    assert SE.search(df, None, "  ").count() == 0
    assert SE.search(df, None, "cafe noir", include_speech=True, limit=2).count() == 2
    ctx = {(r["path"], r["line_no"]): (r["context_before"], r["context_after"]) for r in SE.search(df, None, "cafe noir", before=2, after=1).collect()}
    assert ctx[("p", 0)] == ([], ["the cafe noirs"])
    every = {(r["path"], r["line_no"]): (r["context_before"], r["context_after"]) for r in SE.context_windows(df, 2, 1).collect()}
    assert every[("p", 2)] == (["You see CAFÉ noir here", "the cafe noirs"], ['Bob says, "cafe noir"']) and len(every) == 5
    tokens = SE.index_lines(df, with_tokens=True)
    assert SE.search(tokens, None, "cafe noir", include_speech=True).count() == 4


def test_scan_plan_cases(spark):
    body = b"0123456789"
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in {
        "new": body, "copy": body, "known": b"old content", "same": body, "grown": body + b"x", "changed": b"X123456789x", "shrunk": b"01", "legacy": body}.items()],
        "path string, length bigint, content binary")
    import hashlib
    h = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("same", h(b"whatever"), 10), ("grown", h(body), 10), ("changed", h(body), 10), ("shrunk", h(body), 10), ("legacy", h(body), 0),
                                      ("elsewhere", h(b"old content"), 11)], "path string, content_hash string, byte_len bigint")
    got = {r["path"]: (r["action"], r["offset"]) for r in IN.plan_scan(files, manifest).collect()}
    assert got == {"new": ("duplicate", 0), "copy": ("duplicate", 0), "known": ("duplicate", 0), "same": ("skip", 0), "grown": ("tail", 10),
                   "changed": ("changed", 0), "shrunk": ("changed", 0), "legacy": ("skip", 0)}
    fresh = IN.plan_scan(files, manifest.limit(0))
    assert {r["path"]: r["action"] for r in fresh.filter("path in ('new', 'copy')").collect()} == {"copy": "scan", "new": "duplicate"}
    assert {r["action"] for r in IN.plan_scan(files, manifest, force=True).collect()} == {"scan"}


def test_updates_equal_a_rescan(spark):
    """Any cut of the lines into an old and a new part folds to the rollup of all lines."""
    from questlog.operators.rollups import kill_hourly, kills
    from test_ordered import events
    rng = random.Random(7)
    rows = [{"path": f"/f/{i // 40}", "line_no": i % 40, "kind": rng.choice(["SoloKill", "AssistedKill", "Fallen"]), "verb": rng.choice(["killed", "vanquished"]),
             "creature": rng.choice("ab"), "subject": "ann", "date": f"2024-01-{rng.randrange(1, 28):02} 0{rng.randrange(9)}:00:00"} for i in range(120)]
    whole = events(spark, rows)
    for cut in (0, 17, 60, 120):
        old, new = whole.filter(F.expr(f"cast(substring(path, 4) as int) * 40 + line_no < {cut}")), whole.filter(F.expr(f"cast(substring(path, 4) as int) * 40 + line_no >= {cut}"))
        a, b = IN.fold_kills(kills(old), kills(new)), kills(whole)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
        a, b = IN.fold_hourly(kill_hourly(old), kill_hourly(new)), kill_hourly(whole)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_undated_hours_stand_in_1970(spark):
    from questlog.operators.frequency import kill_frequency
    from questlog.operators.rollups import COUNTERS
    rows = [("A", "Rat", " 00", *([1] + [0] * (len(COUNTERS) - 1))), ("A", "Rat", "2024-01-01 05", *([2] + [0] * (len(COUNTERS) - 1)))]
    df = spark.createDataFrame(rows, "character string, creature string, hour string, " + ", ".join(f"{c} bigint" for c in COUNTERS))
    r = kill_frequency(df).first()
    assert (r["best_2h_count"], r["best_2h_start"]) == (2, "2024-01-01 05:00")


def test_merged_levels_are_not_added(spark):
    from questlog.operators.merge import merged_characters
    people = spark.createDataFrame([("A", None, 100, 3, {"Trout": 1}), ("B", "A", 300, 4, {"Trout": 2, "Eel": 5})],
                                   "character string, merged_into string, coin_level bigint, logins bigint, fishing_catches map<string,bigint>")
    mapping = spark.createDataFrame([("A", "A"), ("B", "A")], "name string, target string")
    levels = spark.createDataFrame([("A", 250)], "character string, coin_level bigint")
    assert merged_characters(people, mapping, levels).first().asDict() == {"character": "A", "logins": 7, "members": 2, "fishing_catches": {"Trout": 3, "Eel": 5}, "coin_level": 250}


def test_search_folds_letters_with_several_marks(spark):
    from questlog.operators.search import search
    lines = spark.createDataFrame([("f", 1, "nói tiếng Việt", "A"), ("f", 2, "noi tieng khac", "A"), ("f", 3, "한국어 が", "A")], "path string, line_no bigint, content string, character string")
    assert {r["line_no"] for r in search(lines, None, "tiếng").collect()} == {1, 2}
    assert [r["snippet"] for r in search(lines, None, "tieng viet").collect()] == ["nói <mark>tiếng Việt</mark>"]
    assert [r["line_no"] for r in search(lines, None, "한국어 が").collect()] == [3]


def test_copy_of_an_earlier_state_equals_the_sql(spark, tmp_path):
    """A new document whose text is the first half of one that has grown since; another is the text of an unchanged one."""
    import duckdb
    from questlog.plans import fact_queries as FQ
    from questlog.plans.oracle_facts import ORACLES
    docs = {0: "Reouti anatha.", 2: "Reouti anatha.\nReouti anatha.", 5: "whole", 6: "whole", 8: "ab", 9: "cd", 10: "Reouti anatha."}
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("scan_plan", "scan_plan_messages", "scan_plan_report", "pending_files", "manifest_update"):
        df, cur = getattr(FQ, name)(spark, str(tmp_path)), con.execute(ORACLES[name])
        columns = sorted(df.columns)
        want = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
        assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[c]) for c in columns) for r in want), name


def test_plan_of_empty_files_equals_the_sql(spark, tmp_path):
    """Empty files that were a prefix before, or a changed one, have the size of unchanged files; what they held is not known."""
    import duckdb
    from questlog.plans import fact_queries as FQ
    from questlog.plans.oracle_facts import ORACLES
    for k, docs in enumerate(({0: "", 2: "", 5: "", 10: "x"}, {5: "x", 8: "", 10: "x"}, {0: "", 1: "", 7: ""}, {15: "x", 4: "", 6: "z"})):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        for name in ("scan_plan", "scan_plan_messages", "scan_plan_report", "pending_files", "manifest_update"):
            df, cur = getattr(FQ, name)(spark, folder), con.execute(ORACLES[name])
            columns = sorted(df.columns)
            want = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
            assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[c]) for c in columns) for r in want), (k, name)


def test_morph_grid_is_not_shuffled(spark):
    """50 characters x 2,000 targets: every pair but finished ones comes out, and few rows are moved for it."""
    from questlog.operators import studies as ST
    b = spark.range(2000).select(F.format_string("c%d", "id").alias("name"), F.format_string("f%d", F.col("id") % 20).alias("family"), F.lit("Common").alias("rarity"), F.lit(5).cast("bigint").alias("value"),
                                 *[F.lit(1).cast("bigint").alias(c) for c in ST.FACTS])
    lastys = spark.range(50).select(F.format_string("Hero%d", "id").alias("character"), F.lit("c7").alias("creature"), F.lit("Morph").alias("lasty_type"), F.lit(1).cast("bigint").alias("message_count"),
                                    (F.col("id") % 2 == 0).alias("finished"), *[F.lit(None).cast("string").alias(c) for c in ("first_seen", "last_seen", "completed", "abandoned")])
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        start = moved()
        got = ST.morph_candidates(lastys, b, b.select("name", "value"))
        got.write.format("noop").mode("overwrite").save()
        assert moved() - start < 10 * 50 * 2000
        assert got.count() == 50 * 2000 - 25 and got.distinct().count() == 50 * 2000 - 25
        own = {(r["character"], r["family"]): r["points_left"] for r in got.filter("creature <> 'c7'").collect()}
        assert own[("Hero0", "f7")] == 19 and own[("Hero1", "f7")] == 20 and own[("Hero0", "f1")] == 20
    finally:
        spark.conf.set(key, before)


def test_morph_grid_is_made_in_bounded_tasks(spark, monkeypatch):
    """200 characters x 1,500 targets, most of one family: no task makes a large part of the grid, and a creature's rows come together, so that files stay small."""
    from questlog.operators import studies as ST
    monkeypatch.setattr(ST, "GRID_SIDES", (50, 100), raising=False)
    monkeypatch.setattr(ST, "GRID_ROWS", 10_000, raising=False)
    b = materialise(spark.range(1500).select(F.format_string("c%d", "id").alias("name"), F.when(F.col("id") >= 300, F.lit("big")).when(F.col("id") > 0, F.lit("small")).alias("family"), F.lit("Medium").alias("rarity"),
                                             (F.col("id") % 7 + 1).alias("value"), *[F.lit(1).cast("bigint").alias(c) for c in ST.FACTS]))
    lastys = materialise(spark.range(200).select(F.format_string("Hero%d", "id").alias("character"), F.format_string("c%d", F.col("id") * 5).alias("creature"), F.lit("Morph").alias("lasty_type"),
                                                 F.lit(1).cast("bigint").alias("message_count"), (F.col("id") % 2 == 0).alias("finished"), *[F.lit(None).cast("string").alias(c) for c in ("first_seen", "last_seen", "completed", "abandoned")]))
    got = [(r["task"], r["character"], r["creature"], r["points_left"]) for r in ST.morph_candidates(lastys, b, b.select("name", "value")).select("*", F.spark_partition_id().alias("task")).collect()]
    family = lambda c: "big" if c >= 300 else "small" if c else ""
    want = {(f"Hero{h}", f"c{c}"): 19 if h % 2 == 0 and h and family(c) == family(5 * h) else 20 for h in range(200) for c in range(1500) if h % 2 or c != 5 * h}
    assert len(got) == len(want) and {x[1:3]: x[3] for x in got} == want
    tasks = {}
    for task, character, creature, _ in got:
        tasks.setdefault(task, []).append(creature)
    assert max(map(len, tasks.values())) < 60_000, max(map(len, tasks.values()))
    runs = sum(1 for rows in tasks.values() for x, y in zip(rows, rows[1:]) if x != y)
    assert runs < 4 * 1500 * 200 / 50, runs


def test_kill_rollup_moves_narrow_lines(spark):
    """80,000 kills and 40,000 shares of 30,000 creatures of characters, met by every task: as many partial sums as lines would be moved, and kills twice. Loot before the first kill does not count."""
    from questlog.operators import rollups as R
    from questlog.operators import sequences as Q
    from questlog.operators.scan import SEQ, seq
    from questlog.plans.adapters import as_events
    n = F.xxhash64("id") % 30_000
    rows = spark.range(0, 120_000, 1, 8).withColumn("n", F.abs(n)).select(
        F.format_string("Hero%d", F.col("n") % 1000).alias("character"), F.format_string("Hero%d", F.col("n") % 1000).alias("subject"), F.format_string("beast %d", F.col("n")).alias("creature"),
        F.format_string("beast %d", F.col("n")).alias("item"), F.when(F.col("id") % 3 == 0, F.lit("LootShare")).when(F.col("id") % 3 == 1, F.lit("SoloKill")).otherwise(F.lit("AssistedKill")).alias("kind"),
        F.when(F.col("id") % 3 > 0, F.lit("killed")).alias("verb"), (F.col("id") % 50).alias("amount"), F.lit("fur").alias("loot_type"),
        F.timestamp_seconds(1_700_000_000 + F.abs(F.xxhash64("id", F.lit(1))) % 10_000_000).cast("string").alias("date"), F.abs(F.xxhash64("id", F.lit(2)) % 10_000_000).alias("line_no"))
    events = as_events(rows)
    assert set(SEQ) <= set(events.columns)
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    start = moved()
    got = R.kills_with_loot(events).localCheckpoint()
    narrow = moved() - start
    want = R.with_best_loot(R.kills(events), Q.best_loot(events, seq()))
    assert narrow < 50 * 120_000, narrow  # with partial sums and a second scan 60 bytes a line
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def _shuffles(spark, df):
    """Shuffles by key of a plan, each counted once where it is used again."""
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_frequency_deals_hours_once(spark, monkeypatch):
    """Hours, days, spans and the best of them need no shuffle but the one by creature, in partitions of a bounded number of hours."""
    monkeypatch.setattr("questlog.operators.frequency.HOURS_PER_TASK", 1, raising=False)
    keys = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k) for k in keys]
    rows = materialise(hourly(spark, [("A", "Rat", "2024-01-01 10", 3, 0), ("A", "Cat", "2024-01-02 10", 1, 1)]))
    try:
        for k, v in zip(keys, ("false", "-1")):
            spark.conf.set(k, v)
        assert _shuffles(spark, kill_frequency(rows)) == 1
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_near_families_read_studies_once(spark):
    """Progress per family is not joined with itself."""
    from questlog.operators import studies as ST
    b = materialise(spark.createDataFrame([("Rat", "Rodents"), ("Fox", "Canines")], "name string, family string"))
    states = materialise(spark.createDataFrame([("Ann", "Rat", "completed"), ("Bob", "Fox", "none")], "character string, creature string, movements_status string").withColumns(
        {"befriend_status": F.lit("none"), "morph_status": F.lit("none")}))
    near = ST.family_progress(states, b, near_only=True)
    assert [(r["character"], r["family"], r["bonus_pct"]) for r in near.collect()] == [("Ann", "Rodents", 10)]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 2
