"""Ordered operators against plain Python on random input, with blocks so small that every carry path is used."""

import random

import pytest
from pyspark.sql import functions as F

from questlog.functions.grammar import EVENT_FIELDS
from questlog.operators import item_help as IH
from questlog.operators import rollups as R
from questlog.operators import scan
from questlog.operators import sequences as Q


def events(spark, rows):
    """rows: dicts with at least kind, line_no; the rest gets defaults. Blocks of 4 lines."""
    base = {"root_no": 0, "loose": False, "folder": "f", "path": "/f/a", "character": "Ann", "date": "2024-01-01 00:00:00", "message": "", **{c: None for c in EVENT_FIELDS}}
    types = {"root_no": "int", "loose": "boolean", "folder": "string", "path": "string", "character": "string", "date": "string", "message": "string",
             "kind": "string", "line_no": "bigint", **EVENT_FIELDS}
    full = [{**base, **r} for r in rows]
    df = spark.createDataFrame([tuple(r[c] for c in types) for r in full], ", ".join(f"{c} {t}" for c, t in types.items()))
    return df.withColumn("path_head", F.substring("path", 1, 3)).withColumn("line_block", F.floor(F.col("line_no") / 4))


@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_scan(spark, inclusive):
    rng = random.Random(1)
    rows = [(k, b, b * 5 + i, rng.choice([None, rng.randrange(100)])) for k in "ab" for b in range(7) for i in range(rng.randrange(5))]
    df = spark.createDataFrame(rows, "k string, b int, n int, v int").withColumn("top", F.floor(F.col("b") / 3))
    got = scan.prefix_scan(df, ["k"], ["n"], {"l": ("last", F.col("v")), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, [["top"], ["b"]], inclusive)
    want = []
    for k, b, n, v in rows:
        seen = [x for kk, _, nn, x in rows if kk == k and (nn < n or (inclusive and nn == n)) and x is not None]
        want.append((k, n, seen[-1] if seen else None, sum(seen), max(seen) if seen else None))
    assert sorted(map(tuple, got.select("k", "n", "l", "s", "m").collect()), key=str) == sorted(want, key=str)


def test_bow_sequences(spark):
    rng = random.Random(2)
    kinds = ["TrainerGreetingSimple", "TrainerGreetingWithUnknownCheckpoint", "TrainerBow", "TrainerCheckpointUnhailed", "TrainerCheckpoint"]
    rows = [{"path": f"/f/{p}", "line_no": i, "kind": rng.choice(kinds), "trainer": rng.choice("xy"), "subject": rng.choice(["ANN", "ann", "Bob"]), "rank_min": i}
            for p in range(12) for i in range(40)]
    want = set()
    for p in {r["path"] for r in rows}:
        state = {}
        for r in (r for r in rows if r["path"] == p):
            mine = r["subject"].lower() == "ann"
            if r["kind"].startswith("TrainerGreeting") and mine:
                state[r["trainer"]] = "greeted"
            elif r["kind"] == "TrainerBow" and r["trainer"] in state:
                state[r["trainer"]] = "bowed"
            elif r["kind"] == "TrainerCheckpointUnhailed" and state.pop(r["trainer"], "") == "bowed":
                want.add((p, r["line_no"]))
    got = {(r["path"], r["line_no"]) for r in Q.bow_checkpoints(events(spark, rows)).collect()}
    assert got == want and want


def test_reflect_lists(spark):
    rng = random.Random(3)
    shapes = [("ReflectListHeader", "¥header"), ("Ignored", "Rat, Cat,"), ("Ignored", "Dog."), ("Ignored", "stray"), ("Ignored", "¥system."), ("StudyProgress", "x"), ("Ignored", "Fox, Dog.")]
    rows = []
    for p in range(15):
        for i in range(30):
            kind, text = rng.choice(shapes)
            rows.append({"path": f"/f/{p:02}", "line_no": i, "kind": kind, "message": text, "lasty_type": rng.choice(["Movements", "Morph"]),
                         "creature": rng.choice(["Dog", "Rat"]) if kind == "StudyProgress" else None, "date": f"2024-01-{rng.randrange(1, 9):02} 00:00:00"})
    best = {}
    for p in sorted({r["path"] for r in rows}):
        open_list, names, busy = None, [], set()
        for r in (r for r in rows if r["path"] == p):
            text = r["message"]
            if open_list:
                if r["kind"] == "Ignored" and not text.startswith("¥") and text[-1] in ",.":
                    names += text.rstrip(",.").split(", ")
                    if text.endswith("."):
                        kept = [n for n in names if open_list[0] == "Morph" or n not in busy]
                        if open_list[1] > best.get(open_list[0], ("", []))[0]:
                            best[open_list[0]] = (open_list[1], kept)
                        open_list = None
                    continue
                open_list = None
            if r["kind"] == "ReflectListHeader":
                open_list, names = (r["lasty_type"], r["date"]), []
            elif r["kind"] == "StudyProgress":
                busy.add(r["creature"])
    want = sorted((t, d, n) for t, (d, ns) in best.items() for n in ns)
    got = sorted((r["lasty_type"], r["date"], r["creature"]) for r in Q.reflect_lists(events(spark, rows)).collect())
    assert got == want and want


def test_studies(spark):
    """Gate, abandon marks and 'training completed' against a table that is updated line by line."""
    rng = random.Random(4)
    kinds = ["LastyBeginStudy", "LastyProgress", "LastyFinished", "StudyAbandon", "StudyProgress", "LastyCompleted"]
    rows = []
    for i in range(400):
        kind = rng.choice(kinds)
        rows.append({"path": f"/f/{i // 50}", "line_no": i % 50, "kind": kind, "character": rng.choice(["Ann", "Bob"]),
                     "creature": None if kind == "LastyCompleted" else rng.choice("abcdefgh"),
                     "lasty_type": rng.choice(["Movements", "Morph"]) if kind.startswith("Lasty") else None, "date": f"d{i:03}"})
    table, gone = {}, set()
    for r in rows:
        who, c, d = r["character"], r["creature"], r["date"]
        key = (who, c, r["lasty_type"] or "Movements")
        mine = [k for k in table if k[:2] == (who, c)]
        if r["kind"] == "StudyAbandon":
            gone.add((who, c))
            for k in mine:
                table[k]["abandoned"] = d
            continue
        if r["kind"] == "LastyCompleted":
            left = [k for k in table if k[0] == who and not table[k]["finished"]]
            if left:
                table[left[-1]]["finished"] = True
            continue
        if r["kind"] == "LastyProgress" and (who, c) in gone:
            continue
        if r["kind"] == "LastyBeginStudy":
            for k in mine:
                table[k]["abandoned"] = None
        if r["kind"] in ("LastyBeginStudy", "LastyFinished"):
            gone.discard((who, c))
        t = table.setdefault(key, {"n": 0, "first": d, "finished": False, "completed": None, "abandoned": None})
        t["n"] += 1
        t["last"] = d
        if r["kind"] == "LastyFinished":
            t["finished"], t["completed"] = True, d
    want = sorted((*k, t["n"], t["first"], t["last"], t["finished"], str(t["completed"]), str(t["abandoned"])) for k, t in table.items())
    got = sorted((r["character"], r["creature"], r["lasty_type"], r["message_count"], r["first_seen"], r["last_seen"], r["finished"], str(r["completed"]),
                  str(r["abandoned"])) for r in R.lastys(events(spark, rows)).collect())
    assert got == want


@pytest.mark.parametrize("crowd", [None, 0, 250])
def test_studies_whole_and_by_blocks(spark, monkeypatch, crowd):
    """Characters held whole, by blocks or some of each have the same studies, and narrow lines are shuffled few times."""
    monkeypatch.setattr(scan, "WINDOW_ROWS", 5_000, raising=False)
    if crowd is not None:
        monkeypatch.setattr(scan, "CROWD", crowd, raising=False)
    kinds = ["LastyBeginStudy", "LastyProgress", "LastyProgress", "LastyFinished", "StudyAbandon", "StudyProgress", "LastyCompleted"]
    n = F.col("line_no")
    pick = lambda salt, of: F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(of)).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), pick(1, len(kinds)) + 1)
    who = F.when(n % 10 == 0, F.lit("Hero")).otherwise(F.concat(F.lit("Hero"), pick(2, 90).cast("string")))
    ev = spark.range(20_000).select(
        F.col("id").alias("line_no"), F.lit(0).alias("root_no"), F.lit(False).alias("loose"), F.lit("").alias("folder"), F.lit("/facts/all").alias("path"), F.lit("/facts/all").alias("path_head"),
        F.floor(F.col("id") / 64).alias("line_block")).withColumns({"character": who, "kind": kind, "date": F.format_string("d%07d", "line_no")}).withColumns({
            "creature": F.when(F.col("kind") != "LastyCompleted", F.concat(F.lit("Beast "), pick(3, 40).cast("string"))),
            "lasty_type": F.when(F.col("kind").isin("LastyBeginStudy", "LastyProgress", "LastyFinished"), F.element_at(F.array(F.lit("Morph"), F.lit("Befriend")), pick(4, 2) + 1))})
    ev = ev.localCheckpoint()
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    start = moved()
    got = {tuple(r) for r in R.lastys(ev).collect()}
    if crowd is None:
        assert moved() - start < 130 * 20_000, (moved() - start) / 20_000

    table, gone = {}, set()
    for r in ev.orderBy("line_no").collect():
        who, c, d, kind = r["character"], r["creature"], r["date"], r["kind"]
        mine = table.setdefault(who, {})
        if kind == "LastyCompleted":
            left = [t for t in mine.values() if not t["finished"]]
            if left:
                left[-1]["finished"] = True
            continue
        if kind == "StudyAbandon":
            gone.add((who, c))
        if kind in ("StudyAbandon", "LastyBeginStudy"):
            for key, t in mine.items():
                if key[0] == c:
                    t["abandoned"] = d if kind == "StudyAbandon" else None
        if kind == "StudyAbandon" or (kind == "LastyProgress" and (who, c) in gone):
            continue
        if kind in ("LastyBeginStudy", "LastyFinished"):
            gone.discard((who, c))
        t = mine.setdefault((c, r["lasty_type"] or "Movements"), {"n": 0, "first": d, "last": d, "finished": False, "completed": None, "abandoned": None})
        t["n"], t["last"] = t["n"] + 1, d
        if kind == "LastyFinished":
            t["finished"], t["completed"] = True, d
    want = {(who, *key, *t.values()) for who, mine in table.items() for key, t in mine.items()}
    assert got == want


@pytest.mark.parametrize("crowd", [None, 0])
def test_completions_finish_the_newest_open_study(spark, monkeypatch, crowd):
    """Completions in a row, with nothing open, after a finish, beside lines without creature or type, and over two files."""
    if crowd is not None:
        monkeypatch.setattr(scan, "CROWD", crowd)
    line = lambda path, n, kind, creature=None, ty=None, who="Ann": {"path": path, "line_no": n, "kind": kind, "creature": creature, "lasty_type": ty, "character": who, "date": f"d{path[-1]}{n}"}
    rows = [
        line("/f/2", 0, "LastyCompleted"), line("/f/2", 1, "LastyCompleted"), line("/f/2", 2, "LastyBeginStudy", "e", "Morph"),
        line("/f/1", 0, "LastyCompleted"), line("/f/1", 1, "LastyBeginStudy", "a", "Morph"), line("/f/1", 2, "LastyBeginStudy", "b", "Morph"), line("/f/1", 3, "LastyProgress", "c"),
        line("/f/1", 4, "LastyProgress", None, "Morph"), line("/f/1", 5, "LastyFinished", "d", "Morph"), line("/f/1", 6, "LastyFinished", "b", "Morph"), line("/f/1", 7, "LastyCompleted"),
        line("/f/1", 8, "LastyProgress", "b", "Morph"), line("/f/1", 9, "StudyAbandon", "z"),
        line("/f/1", 3, "LastyCompleted", who="Bob"), line("/f/1", 4, "LastyProgress", "a", "Morph", who="Bob"), line("/f/1", 1, "LastyProgress", "a", "Morph", who=None), line("/f/1", 2, "LastyCompleted", who=None),
    ]
    got = {(r["character"], r["creature"], r["lasty_type"]): (r["message_count"], r["finished"], r["completed"]) for r in R.lastys(events(spark, rows)).collect()}
    assert got == {
        ("Ann", "a", "Morph"): (1, True, None), ("Ann", "b", "Morph"): (3, True, "d16"), ("Ann", "c", None): (1, True, None), ("Ann", None, "Morph"): (1, True, None), ("Ann", "d", "Morph"): (1, True, "d15"),
        ("Ann", "e", "Morph"): (1, False, None), ("Bob", "a", "Morph"): (1, False, None), (None, "a", "Morph"): (1, True, None)}


def test_whole_characters_are_shuffled_once_and_not_joined(spark):
    """Numbering, gating, counting and completions of characters held whole keep to the tasks of one shuffle, and no rows are written or joined in between."""
    kinds = ["LastyBeginStudy", "LastyFinished", "LastyCompleted"]
    rows = [{"path": "/f/1", "line_no": i, "kind": kinds[i % 3], "character": "AB"[i % 2], "creature": None if i % 3 == 2 else "abc"[i % 5 % 3], "lasty_type": None if i % 3 == 2 else "Morph"} for i in range(60)]
    plan = R.lastys(events(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_study_lines_are_not_shuffled_for_their_creatures(spark):
    """The creatures are 50 rows of a table that may be large: the lines are not dealt by them, however large that table is taken to be."""
    from questlog.plans.adapters import study_events
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = study_events(spark, "/root/testdata/sf0.001").select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def help_blocks(lines):
    """The block rules read one line at a time."""
    out = set()
    for path in sorted({p for p, _, _ in lines}):
        worn, block = None, None

        def close():
            nonlocal block, worn
            if block and block["item"]:
                texts = block["lines"]
                marks = [i for i, (_, h) in enumerate(texts) if h]
                out.update((block["item"], path, t) for t, _ in texts[marks[0]: marks[-1] + 1])
            used, block = bool(block and block["item"]), None
            return used

        for _, _, content in sorted(x for x in lines if x[0] == path):
            date, clock, text = content.split(" ", 2)
            ts, secs = f"{date} {clock}", sum(int(x) * f for x, f in zip(clock.split(":"), (3600, 60, 1)))
            name = text[6:text.index(" allows ")] if text.startswith("* The ") and " allows " in text else None
            trigger = name is not None or text.startswith("Type \"/")
            follows = trigger or text.startswith("* Hot tip:")
            near = worn[0] if worn and (secs - worn[1]) % 86400 <= 15 else None
            if text.startswith("You equip your "):
                close()
                worn = (text[15:-1], secs)
                continue
            if block and ts == block["ts"]:
                block["item"] = name or block["item"]
            elif trigger:
                if close():
                    worn = near = None
                block = {"item": name or near, "ts": ts, "lines": []}
            elif block and follows:
                block["item"] = block["item"] or near
                block["ts"] = ts
            else:
                if close():
                    worn = None
                continue
            block["lines"].append((text, follows))
        close()
    return out


def test_item_help(spark):
    rng = random.Random(5)
    texts = ["* The red boots allows you to hop.", "* The green belt allows you to fly.", "Type \"/use\" to use it", "* Hot tip: rest", "prose goes on", "You equip your lamp.", "You equip your ring."]
    lines = []
    for p in range(40):
        t = 86380 if p % 5 == 0 else 1000
        for i in range(30):
            t += rng.choice([0, 0, 1, 9, 20])
            s = t % 86400
            lines.append((f"p{p}", i, f"1/{1 + t // 86400}/24 {s // 3600}:{s // 60 % 60}:{s % 60:02} " + rng.choice(texts)))
    got = {tuple(r) for r in IH.item_help(spark.createDataFrame(lines, "path string, line_no bigint, content string")).select("item", "path", "line").collect()}
    assert got == help_blocks(lines)


def test_similar_sets_with_copies_and_a_common_line(spark):
    rng = random.Random(6)
    sets = {f"i{k}": frozenset(rng.sample("abcdefgh", rng.randrange(1, 6))) | {"everywhere"} for k in range(25)}
    sets |= {f"copy{k}": sets["i0"] for k in range(10)}
    files = {n: rng.randrange(1, 5) for n in sets}
    df = spark.createDataFrame([(n, line, files[n]) for n, s in sets.items() for line in s], "item string, line string, files bigint")
    kept = []
    for n in sorted(sets, key=lambda n: (-files[n], n)):
        if not any(2 * len(sets[n] & sets[m]) >= len(sets[n] | sets[m]) for m in kept):
            kept.append(n)
    assert sorted(r["item"] for r in IH.dedup_sets(df).collect()) == sorted(kept)


def plain_dedup(sets, files):
    kept = []
    for n in sorted(sets, key=lambda n: (-files[n], n)):
        if not any(2 * len(sets[n] & sets[m]) >= len(sets[n] | sets[m]) for m in kept):
            kept.append(n)
    return sorted(kept)


def sets_frame(spark, sets, files):
    return spark.createDataFrame([(n, line, files[n]) for n, s in sets.items() for line in sorted(s)], "item string, line string, files bigint")


def test_a_line_in_all_sets_makes_no_candidates(spark):
    sets = {f"i{k:04}": {"hot", f"own{k}", f"pair{k // 2}"} for k in range(2000)} | {"alone": {"hot"}, "two": {"hot", "own0"}}
    lines = spark.createDataFrame([(n, len(s), line) for n, s in sets.items() for line in sorted(s)], "item string, n bigint, line string")
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in IH.similar_candidates(lines).select("a", "b").collect()}
    names, want = sorted(sets), set()
    for k in range(1000):
        want.add((f"i{2 * k:04}", f"i{2 * k + 1:04}"))
    want |= {("alone", "two"), ("i0000", "two")}
    assert want <= pairs and len(pairs) <= len(want) + 4
    got = {tuple(sorted((r["a"], r["b"]))) for r in IH.similar_pairs(sets_frame(spark, sets, dict.fromkeys(names, 1))).collect()}
    assert got == want


def test_similar_pairs_of_many_sizes(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    sets = {}
    for k in range(120):
        s = set(rng.sample(base, rng.randrange(1, 40)))
        sets[f"i{k}"] = s
        sets[f"j{k}"] = set(rng.sample(sorted(s), max(1, rng.randrange(len(s) // 3, len(s) + 1)))) | {f"w{rng.randrange(90)}" for _ in range(rng.randrange(3))}
    files = {n: rng.randrange(1, 4) for n in sets}
    unique = {}
    for n in sorted(sets, key=lambda n: (-files[n], n)):
        unique.setdefault(frozenset(sets[n]), n)
    reps = sorted(unique.values())
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1:] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    df = sets_frame(spark, sets, files)
    assert {tuple(sorted((r["a"], r["b"]))) for r in IH.similar_pairs(df).collect()} == want
    for at_once in (1, 7, 500_000):
        assert sorted(r["item"] for r in IH.dedup_sets(df, at_once).collect()) == plain_dedup(sets, files)


def test_a_long_chain_of_similar_sets(spark):
    sets = {f"c{k:05}": {f"l{k}", f"l{k + 1}", f"l{k + 2}"} for k in range(10_000)}
    df = sets_frame(spark, sets, dict.fromkeys(sets, 1))
    want = [f"c{k:05}" for k in range(0, 10_000, 2)]
    assert sorted(r["item"] for r in IH.dedup_sets(df).collect()) == want
    assert sorted(r["item"] for r in IH.dedup_sets(df, at_once=3_000).collect()) == want


def test_no_sets(spark):
    assert IH.dedup_sets(sets_frame(spark, {"x": {"l"}}, {"x": 1}).limit(0)).collect() == []
