"""Mixing and sharding: native operators on small tables."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from questlog.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, weight int, tokens string, shard string, bucket int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, "a b c", "en", "s0", 5, 1, 1, "x", "y", 0), (1, "a b c", "en", "s0", 5, 1, 1, "x", "y", 0), (2, None, None, None, None, None, None, None, None, None),
            (None, "word " * 5000, "en", "s0", 1, 1, 1, "x", "y", 0), (3, "", "de", "s1", 0, 1, 1, "x", "y", 0), (4, "a b c", "de", "s1", 5, 1, 1, "x", "y", 0),
            (5, " \t\n", "de", None, 3, 1, 1, "x", "y", 0), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def _items(spark, n=3000):
    """Cells that depend on one another, so that raking needs several rounds."""
    rows = [(i, f"s{min(i % 7, 4)}", ("en", "de", "fr")[i % 3 if i % 5 else 0], f"t{i % 4 if i % 11 else 0}", 1 + i % 13) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")


def test_raking_meets_all_marginals(spark):
    cells = mixing.materialise(mixing.cells_of(_items(spark)))
    targets = mixing.tempered_targets(cells)
    want = {(r["dimension"], r["value"]): r["target"] for r in targets.collect()}
    fitted = mixing.rake(cells, targets, tolerance=1e-7).collect()
    for d in mixing.DIMENSIONS:
        got = Counter()
        for r in fitted:
            got[r[d]] += r["weight"]
        for value, w in got.items():
            assert math.isclose(w, want[d, value], rel_tol=1e-6)
        assert math.isclose(sum(want[d, v] for v in got), 1.0, rel_tol=1e-9)


def test_raking_with_given_targets(spark):
    cells = mixing.materialise(mixing.cells_of(_items(spark)))
    targets = mixing.tempered_targets(cells).filter("dimension <> 'lang'").unionByName(
        spark.createDataFrame([("lang", "en", 0.5), ("lang", "de", 0.3), ("lang", "xx", 0.2)], "dimension string, value string, target double"))
    got = {r["lang"]: r["w"] for r in mixing.rake(cells, targets, tolerance=1e-7).groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    assert math.isclose(got["en"], 0.625, rel_tol=1e-6) and math.isclose(got["de"], 0.375, rel_tol=1e-6) and got["fr"] == 0


def test_contradicting_cells_are_told(spark):
    """Cells (a, x), (a, y), (b, y) with halves as targets: b can have its half only if (a, y) goes, which takes ever more rounds."""
    cells = spark.createDataFrame([("a", "x", "t", 5.0), ("a", "y", "t", 3.0), ("b", "y", "t", 2.0)], "source string, lang string, topic string, tokens double")
    targets = spark.createDataFrame([("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.5), ("lang", "y", 0.5), ("topic", "t", 1.0)], "dimension string, value string, target double")
    with pytest.warns(UserWarning, match="raking stopped after 3 rounds"):
        mixing.rake(cells, targets, max_rounds=3)


@pytest.mark.parametrize("cap", [1.0, 2.5])
def test_rates_give_the_share_of_tokens(spark, cap):
    items = _items(spark)
    mixed = mixing.mix(items, share=0.6, max_copies=cap, tolerance=1e-3).collect()
    total = sum(r["tokens"] for r in mixed)
    assert math.isclose(sum(r["tokens"] * r["rate"] for r in mixed), 0.6 * total, rel_tol=1e-9)
    assert max(r["rate"] for r in mixed) <= cap and abs(sum(r["tokens"] * r["copies"] for r in mixed) / total - 0.6) < 0.05
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in mixed)


@pytest.mark.parametrize("cap", [1.0, math.inf])
def test_marginals_report_what_is_drawn(spark, cap):
    """With no limit to the copies the drawn shares are the targets; at one copy rates are clipped and the report shows the gap."""
    items = _items(spark)
    mixed = mixing.materialise(mixing.mix(items, share=0.8, max_copies=cap, tolerance=1e-7))
    rows = mixing.marginals(mixed, mixing.tempered_targets(mixing.cells_of(items))).collect()
    copies, total = Counter(), sum(r["tokens"] * r["copies"] for r in mixed.collect())
    for r in mixed.collect():
        for d in mixing.DIMENSIONS:
            copies[d, r[d]] += r["tokens"] * r["copies"] / total
    assert {(r["dimension"], r["value"]) for r in rows} == set(copies) and all(math.isclose(r["drawn"], copies[r["dimension"], r["value"]]) for r in rows)
    gap = max(abs(r["expected"] - r["target"]) for r in rows)
    assert gap < 1e-5 if cap > 1 else gap > 0.005


def test_mixing_odd_rows(odd_docs):
    items = odd_docs.withColumns({"topic": mixing.topic_of(F.col("text")), "tokens": mixing.token_count(F.col("text"))})
    rows = mixing.mix(items).collect()
    assert len(rows) == 8 and all(r["weight"] == 0 and r["rate"] == 1 and r["copies"] == 1 for r in rows if r["tokens"] == 0)
    assert {r["source"] for r in rows} == {"", "s0", "s1"}
    assert len({(r["rate"], r["copies"]) for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.mix(items.limit(0)).collect() == []


def test_sharding_odd_rows(odd_docs):
    rows = sharding.assign_shards(odd_docs, 24).collect()
    assert len(rows) == 8 and sharding.assign_shards(odd_docs.limit(0), 24).collect() == []
    for r in rows:
        if r["doc_id"] in (2, 3):
            assert (r["size"], r["text_crc32"]) == (8, 0)
        if r["doc_id"] in (1, 4):
            assert (r["size"], r["text_crc32"]) == (13, zlib.crc32(b"a b c"))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign_shards(docs, 24, buckets=5).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) < 1.2 * 20_000 / 24
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert moved and all(r["grown_shard"] == 24 for r in moved) and abs(len(moved) - 20_000 / 25) < 150
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_a_changed_weight_moves_rows_only_out_of_or_into_its_subtree(spark):
    tree = sharding.Tree.even(8, racks=4, regions=2)
    heavier = dict(tree.children)
    heavier["root"] = (("g0", 4.0), ("g1", 6.0))
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), sharding.Tree(heavier)).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(a < 4 <= b for a, b in moved)


def test_shards_are_written(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("extra"))
    sharding.write_shards(docs, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.columns == ["doc_id", "text", "extra", "shard"] and back.select("shard").distinct().count() == 4


def test_op2_full_cells_leave_their_share_to_the_others(spark, tmp_path):
    """A rare source cannot be raised to its target within the copies allowed; the query then still draws the share of all tokens that it shall, as its SQL does."""
    import duckdb
    from questlog.llm import queries as LQ
    rows = [(i, "big", "en", "many plain words in every one of these texts") for i in range(400)] + [(400, "rare", "en", "few words"), (401, "rare", "de", "wenige")]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = LQ.op2_mixing(spark, str(tmp_path))
    mixed = [r.asDict() for r in got.collect()]
    assert max(r["rate"] for r in mixed) == LQ.MAX_COPIES
    total = sum(r["tokens"] for r in mixed)
    assert math.isclose(sum(r["tokens"] * r["rate"] for r in mixed), 0.8 * total, rel_tol=1e-5)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(LQ.ORACLES["op2_mixing"])
    want = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
    same = lambda found: sorted(tuple(round(float(r[c]), 5) if isinstance(r[c], float) else str(r[c]) for c in sorted(r)) for r in found)
    assert same(mixed) == same(want)


def test_op2_draws_are_whole(spark, tmp_path):
    """A rare source is drawn as often as its target takes, beyond any limit of copies; without repeats the search for the scale still gives 0.8 of all tokens. Both are in the SQL."""
    import duckdb
    from questlog.llm import queries as LQ
    rows = [(i, "big", "en", "many plain words in every one of these texts") for i in range(400)] + [(400 + i, "rare", "en", "few words") for i in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = LQ.op2_mixing(spark, str(tmp_path))
    mixed = [r.asDict() for r in got.collect()]
    total, rare = sum(r["tokens"] for r in mixed), 16 ** 0.5 / (16 ** 0.5 + 3600 ** 0.5)
    for name, most in (("target_", 0.8 * rare * total / 16), ("once_", 1)):
        assert math.isclose(sum(r["tokens"] * r[f"{name}rate"] for r in mixed), 0.8 * total, rel_tol=1e-5)
        assert math.isclose(max(r[f"{name}rate"] for r in mixed), most, rel_tol=1e-5)
        assert all(0 <= r[f"{name}copies"] - r[f"{name}rate"] < 1 or 0 <= r[f"{name}rate"] - r[f"{name}copies"] < 1 for r in mixed)
    assert 0.8 * rare * total / 16 > 2 * LQ.MAX_COPIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(LQ.ORACLES["op2_mixing"])
    columns = [c[0] for c in cur.description]
    assert columns == got.columns
    key = lambda r: (r["doc_id"], *(round(float(r[c]), 5) for c in columns[4:]))
    assert sorted(map(key, mixed)) == sorted(key(dict(zip(columns, r))) for r in cur.fetchall())
