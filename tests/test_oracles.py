"""Every registered query against its DuckDB oracle on the smallest tables, and a look at its plan."""

import pytest
from compare import DATA, compare, duck

import __spark_entry__ as entry
from questlog.plans import registry

SF = f"{DATA}/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
ROWS_ONLY = {"item_help"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


@pytest.mark.parametrize("name", ["kills_rollup", "kill_table", "freq_best_2h", "weighted_ranks", "zero_trainers", "jaccard_pairs", "scan_plan",
                                  "log_search_context", "morph_candidates", "bow_checkpoint", "scan_report"])
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_kill_rollup_aggregates_by_hash_with_map_side_combining(spark):
    from questlog.operators.rollups import kills_per_file
    from questlog.plans.adapters import kill_events
    plan = kills_per_file(kill_events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_lines_are_shuffled_once(spark):
    """Attribution and classification move each line once, by file block; lookups go to the block summaries."""
    from questlog.functions.grammar import classify
    from questlog.operators.attribution import attribute
    from questlog.plans.adapters import parsed_log, trainer_messages
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ev = classify(attribute(parsed_log(spark, SF)), "message", trainer_messages(spark))
        plan = ev._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    main = plan[plan.index("Window"):]
    assert moved and "hashpartitioning(root_no" in main.split("Exchange", 1)[1][:60]
    assert "BroadcastHashJoin [_key" in plan and sum("_key" in line for line in moved) <= 2  # the catalogue's own aggregates


def test_kill_scan_reads_only_the_columns_it_needs(spark):
    from questlog.plans.adapters import kill_events
    plan = kill_events(spark, SF).select("character")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
