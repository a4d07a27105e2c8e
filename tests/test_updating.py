"""Updates against a rescan on random logs, whatever the deliveries; and what a killed or beaten writer leaves."""

import random

import pytest
from test_ordered import events

from questlog.operators import rollups as R
from questlog.operators import sequences as Q
from questlog.operators import updating as U
from questlog.operators.scan import seq
from questlog.sources import generations as G

KINDS = ["SoloKill", "AssistedKill", "Fallen", "LootShare", "Depart", "FirstDepart", "TrainerRank", "ApplyLearningRank", "TrainerGreetingSimple", "TrainerBow", "TrainerCheckpointUnhailed", "TrainerCheckpoint",
         "FishCaught", "CoinsPickedUp", "StudyProgress", "StudyAbandon", "LastyBeginStudy", "LastyProgress", "LastyFinished", "LastyCompleted", "ProfessionAnnouncement", "EsteemGain"]
SETTINGS = ["kill_table", "kill_hours", "trainer_ranks", "character_counters", "fishing_catches", "best_loot", "depart_counts", "checkpoint_table", "announced", "study_table"]


def _log(rng, files=9, lines=70):
    rows = []
    for f in range(files):
        folder = rng.choice("fgh")
        for i in range(lines):
            kind = rng.choice(KINDS + KINDS[14:20])
            rows.append({"loose": False, "folder": folder, "path": f"/{folder}/{f}", "line_no": i, "kind": kind, "character": rng.choice(["Ann", "Bob"]), "subject": rng.choice(["ANN", "bob", "Eve"]),
                         "date": rng.choice(["", f"2024-01-{rng.randrange(1, 28):02d} {rng.randrange(24):02d}:00:00"]), "verb": rng.choice(["killed", "slaughtered", "vanquished", "dispatched"]),
                         "creature": rng.choice(["Rat", "Cat", "Fox"]), "item": rng.choice(["Rat", "Cat", "Eel"]), "amount": rng.randrange(0, 9), "worth": 3, "loot_type": rng.choice(["fur", "blood", "mandible"]),
                         "trainer": rng.choice("xy"), "flag": rng.random() < 0.5, "rank_min": i, "rank_max": i + 1, "lasty_type": rng.choice(["Movements", "Befriend", "Morph"]), "text": rng.choice(["Ranger", "Healer"])})
    return rows


def _overrides(spark):
    return spark.createDataFrame([("Ann", "x", "override", None), ("Bob", "y", "override_until_date", "1/10/24")], "character string, trainer string, rank_mode string, override_date string")


def _tables(spark, generation):
    show = lambda r: str({k: sorted(v.items()) if isinstance(v, dict) else v for k, v in r.asDict(recursive=True).items()})
    return {n: sorted(show(r) for r in generation.read(spark, n).collect()) for n in SETTINGS}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    rows = _log(random.Random(21))
    return rows, _tables(spark, U.rescan(spark, str(tmp_path_factory.mktemp("whole")), events(spark, rows), _overrides(spark)))


def test_a_rescan_gives_what_the_rollups_give(spark, scanned):
    rows, whole = scanned
    ev = events(spark, rows).withColumn("path_head", U.path_head())
    text = lambda df: sorted(str({k: v for k, v in r.asDict(recursive=True).items()}) for r in df.collect())
    assert whole["study_table"] == text(R.lastys(ev)) and whole["best_loot"] == text(Q.best_loot(ev, seq())) and whole["depart_counts"] == text(Q.departs(ev, seq()))
    assert whole["kill_table"] == text(R.with_best_loot(R.kills(ev), Q.best_loot(ev, seq())))
    assert whole["checkpoint_table"] == text(Q.checkpoints(ev).select("character", "trainer", "rank_min", "rank_max", "date", *U.SEQ))
    assert whole["trainer_ranks"] == text(R.trainer_ranks(Q.gate_ranks(ev, _overrides(spark))))


@pytest.mark.parametrize("seed,compact", [(1, 16), (2, 2)])
def test_updates_equal_a_rescan(spark, scanned, tmp_path, monkeypatch, seed, compact):
    """Files arrive in any order, a file's lines in order over several deliveries; a character may be new to the last one."""
    monkeypatch.setattr(U, "COMPACT", compact)
    rows, whole = scanned
    rng = random.Random(seed)
    cuts = {p: sorted(rng.choices(range(71), k=2)) if rng.random() < 0.7 else rng.choice([[0, 70], [0, 0], [70, 70]]) for p in {r["path"] for r in rows}}
    delivery = lambda r: sum(r["line_no"] >= c for c in cuts[r["path"]])
    root = str(tmp_path)
    for k in range(3):
        done = U.update(spark, root, events(spark, [r for r in rows if delivery(r) == k]), _overrides(spark))
    assert done.number == 2 and _tables(spark, done) == whole
    assert len(done.tables["part_kills"]) == (3 if compact == 16 else 1)
    again = U.rescan(spark, root, events(spark, rows), _overrides(spark))
    assert again.number == 3 and _tables(spark, again) == whole
    G.expire(spark, root, keep=1)
    assert _tables(spark, G.current(spark, root)) == whole and {p.name.split("-")[0] for p in tmp_path.iterdir() if p.name != "_generations"} == {"0000000003"}


def test_a_killed_or_beaten_update_changes_nothing(spark, tmp_path, monkeypatch):
    rows, root, none = _log(random.Random(5), 2, 30), str(tmp_path), _overrides(spark).limit(0)
    manifest = spark.createDataFrame([("/f/0", 10)], "path string, byte_len long")
    assert U.update(spark, root, None, none) is None
    first = U.update(spark, root, events(spark, rows[:30]), none, manifest=manifest)
    before = _tables(spark, first)

    def die(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(G, "publish", die)  # all is written, nothing published
        with pytest.raises(KeyboardInterrupt):
            U.update(spark, root, events(spark, rows[30:]), none, manifest=manifest.limit(0))
    held = G.current(spark, root)
    assert held == first and _tables(spark, held) == before and held.read(spark, "manifest").count() == 1
    assert U.rescan(spark, root, None, none) == first
    second = U.update(spark, root, events(spark, rows[30:]), none)  # reads the same files again; the manifest stays
    assert second.number == 1 and second.read(spark, "manifest").count() == 1
    assert _tables(spark, second) == _tables(spark, U.rescan(spark, str(tmp_path / "other"), events(spark, rows), none))
    with pytest.raises(G.Conflict):
        G.publish(spark, root, G.Generation(1, {}, {}))
    assert G.current(spark, root) == second and not [p for p in (tmp_path / "_generations").iterdir() if p.name.startswith("_")]
