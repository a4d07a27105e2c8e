"""Help texts of items, collected from logs, and the clean-up of what was collected."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from questlog.functions import scalars as S
from questlog.operators.scan import FILE_BLOCKS, line_block, prefix_scan
from questlog.session import materialise

# Fixed patterns: what a help text looks like.
_LOG_TS = r"^([0-9]+/[0-9]+/[0-9]+ [0-9]+:[0-9]+:[0-9]+[ap]?) "
_EQUIP = r"(?s)^You equip your (.*)\.\z"
_COMMAND = "|".join([r"^Type [\"'“‘]*/", r'^/useitem "', r"^/useitem [\p{L}\p{N}]", r"^\* /"])
_NAMES = [r'(?s)^/useitem "([^"]*)"', r'^/useitem ([^"\s]\S*)', r"(?s)^\* The (.*?) allows ", r"(?s)^The (.*?) allows ",
          r"(?s)^Your (.*?) allows you to"]
_THIS = [r"(?s)^This (.*?) helps", r"(?s)^This (.*?) allows"]
MAX_EQUIP_SECONDS = 15


def _describes(m: Column) -> Column:
    return (m.rlike(_COMMAND) | (m.startswith("* The ") & m.contains(" allows ")) | (m.startswith("The ") & m.contains(" allows "))
            | (m.startswith("Your ") & m.contains(" allows you to"))
            | (m.startswith("This ") & (m.contains(" helps") | m.contains(" allows"))))


def is_trigger(m: Column) -> Column:
    """A line that opens a help block."""
    return _describes(m)


def is_continuation(m: Column) -> Column:
    """A line that may follow in a help block at a later time."""
    return (_describes(m) | m.startswith("* Hot tip:") | m.startswith("* You can currently hold")
            | (m.startswith("* Your ") & m.contains(" can hold")) | (m.rlike(r"^/\p{L}") & (m.contains(" :") | m.contains(" <"))))


def item_name(m: Column) -> Column:
    """Item named by a help line; a single word after 'This' is too generic to be one."""
    out = None
    for p in _NAMES:
        hit = m.rlike(p)
        out = F.when(hit, F.regexp_extract(m, p, 1)) if out is None else out.when(hit, F.regexp_extract(m, p, 1))
    this = F.when(m.rlike(_THIS[0]), F.regexp_extract(m, _THIS[0], 1)).when(m.rlike(_THIS[1]), F.regexp_extract(m, _THIS[1], 1))
    return out.when(this.contains(" "), this)


def item_help(lines: DataFrame) -> DataFrame:
    """(item, path, line): help lines per item and file. Input `(path, line_no, content)`.

    The block automaton in set form. A burst is a run of lines with one timestamp, and inside a block it is
    kept whole; so a line is decided by the burst it belongs to, and a block by a few running values:

    * a line is *open* if it is a trigger, or a continuation while its block is open, or belongs to the
      burst of the last open line; anything else closes the block;
    * blocks are numbered by a running count of the lines that start one;
    * the item of a block is the last name given in it, else what was equipped at most 15 s before.
    """
    m = F.col("message")
    stamp = F.nullif(F.regexp_extract("content", _LOG_TS, 1), F.lit(""))
    rows = lines.select("path", "line_no", "content", stamp.alias("ts"),
                        F.when(F.col("content").rlike(_LOG_TS), F.regexp_replace("content", _LOG_TS, "")).otherwise(F.col("content")).alias("message"))
    equip = F.when(m.rlike(_EQUIP), F.regexp_extract(m, _EQUIP, 1))
    rows = rows.withColumns({"equip": equip, "trigger": equip.isNull() & is_trigger(m), "cont": equip.isNull() & is_continuation(m),
                             "line_block": line_block()})
    # 1. bursts: a new one begins where the timestamp changes, at an equip line, and at every unstamped line
    prev = prefix_scan(rows, ["path"], ["line_no"], {"_prev": ("last", F.coalesce("ts", F.concat(F.lit("#"), F.col("line_no").cast("string")))),
                                                     "_prev_equip": ("max", F.when(F.col("equip").isNotNull(), F.col("line_no"))),
                                                     "_prev_line": ("max", F.col("line_no"))}, FILE_BLOCKS, inclusive=False)
    starts = F.col("ts").isNull() | F.col("_prev").isNull() | (F.col("ts") != F.col("_prev")) | F.col("equip").isNotNull() | (
        F.coalesce(F.col("_prev_equip") == F.col("_prev_line"), F.lit(False)))
    rows = materialise(prefix_scan(prev.withColumn("_starts", starts.cast("int")).drop("_prev", "_prev_equip", "_prev_line"),
                                   ["path"], ["line_no"], {"burst": ("sum", F.col("_starts"))}, FILE_BLOCKS))
    # 2. in each burst: where the first trigger and the first line are, and whether the first line continues a block
    first = F.min_by(F.struct("trigger", "cont", "equip"), "line_no")
    bursts = rows.groupBy("path", "burst").agg(
        F.min("line_no").alias("line_no"), F.min(F.when(F.col("trigger"), F.col("line_no"))).alias("_trigger"),
        first.alias("_first"), F.max("ts").alias("ts")).withColumn("line_block", line_block())
    # 3. a burst starts a block at its first trigger; one whose first line is only a continuation joins an open block;
    #    any other first line closes the block before it
    begins = F.col("_trigger").isNotNull()
    joins = F.col("_first.cont") & ~F.col("_first.trigger")
    state = F.when(begins, True).when(joins, F.lit(None).cast("boolean")).otherwise(False)
    opened = prefix_scan(bursts.withColumn("_state", state), ["path"], ["line_no"], {"_open": ("last", F.col("_state"))}, FILE_BLOCKS, inclusive=False)
    was_open = F.coalesce("_open", F.lit(False))
    whole = joins & was_open                      # joins the block with all its lines
    new_block = begins & ~whole
    opened = opened.withColumns({"_from": F.when(whole, F.col("line_no")).when(begins, F.col("_trigger")), "_new": new_block.cast("int")})
    numbered = prefix_scan(opened, ["path"], ["line_no"], {"block": ("sum", F.col("_new"))}, FILE_BLOCKS)
    kept = rows.join(numbered.filter("_from is not null").select("path", "burst", "_from", "block"), ["path", "burst"]).filter("line_no >= _from")
    # 4. the item: the last name in the block, else the item equipped shortly before one of its burst starts
    equipped = prefix_scan(rows.withColumn("_e", F.when(F.col("equip").isNotNull(), F.struct("equip", "ts", "line_no"))),
                           ["path"], ["line_no"], {"_equipped": ("last", F.col("_e"))}, FILE_BLOCKS).select("path", "line_no", "_equipped")
    named = kept.withColumn("_name", item_name(m)).join(equipped, ["path", "line_no"], "left")
    near = S.within_seconds(S.seconds_of_day("ts"), S.seconds_of_day("_equipped.ts"), MAX_EQUIP_SECONDS)
    fallback = F.when((F.col("line_no") == F.col("_from")) & near, F.struct(F.col("_equipped.equip").alias("item"), F.col("_equipped.line_no").alias("at")))
    help_like = F.col("trigger") | F.col("cont")
    blocks = named.groupBy("path", "block").agg(
        F.min("line_no").alias("line_no"),
        F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("line_no"))).alias("_named"),
        F.min_by(fallback, F.when(fallback.isNotNull(), F.col("line_no"))).alias("_fallback"),
        F.min(F.when(help_like, F.col("line_no"))).alias("_lo"), F.max(F.when(help_like, F.col("line_no"))).alias("_hi"))
    # an equipped item serves one block: the first one after it that got any item
    has_item = F.col("_named").isNotNull() | F.col("_fallback").isNotNull()
    blocks = prefix_scan(blocks.withColumn("line_block", line_block()), ["path"], ["line_no"],
                         {"_used": ("max", F.when(has_item, F.col("line_no")))}, FILE_BLOCKS, inclusive=False)
    free = F.col("_used").isNull() | (F.col("_used") < F.col("_fallback.at"))
    blocks = blocks.select("path", "block", "_lo", "_hi", F.coalesce("_named", F.when(free, F.col("_fallback.item"))).alias("item"))
    out = kept.join(blocks, ["path", "block"]).filter("line_no between _lo and _hi and item is not null")
    return out.select("item", "path", S.normalise_quotes("message").alias("line")).distinct()


def majority_vote(found: DataFrame) -> DataFrame:
    """Lines kept for an item: those in at least half (rounded up) of the item's files. (item, line, files)

    Duplicates go first, in partial aggregates, so a hot item or line is counted from small pieces.
    """
    pairs = found.select("item", "path", "line").distinct()
    files = found.select("item", "path").distinct().groupBy("item").agg(F.count("*").alias("files"))
    lines = pairs.groupBy("item", "line").agg(F.count("*").alias("n"))
    return lines.join(files, "item").filter(F.col("n") >= F.ceil(F.col("files") / 2)).select("item", "line", "files")


def _signatures(sets: DataFrame) -> DataFrame:
    """(item, files, n, sig): equal sets have equal signatures. An order-free digest of 192 bits and the size, so a set
    of any size stays a partial aggregate and is never gathered in one place."""
    h1, h2 = F.xxhash64("line"), F.xxhash64(F.lit(1), "line")
    return sets.groupBy("item").agg(
        F.max("files").alias("files"), F.count("*").alias("n"),
        F.struct(F.count("*").alias("n"), F.sum(h1.cast("decimal(20,0)")).alias("a"), F.sum(h2.cast("decimal(20,0)")).alias("b"),
                 F.bit_xor(h1).alias("x")).alias("sig"))


def _representatives(sets: DataFrame) -> DataFrame:
    """One item per distinct set: the one in most files, smallest name on ties. (item, files, n)"""
    chosen = _signatures(sets).groupBy("sig").agg(F.min(F.struct((-F.col("files")).alias("m"), "item", "n")).alias("r"))
    return chosen.select("r.item", (-F.col("r.m")).alias("files"), "r.n")


BAND = 1.25


def _band(size: Column) -> Column:
    """Number of a set's size band: each size of its own up to 4, then bands a quarter wide."""
    return F.floor(F.log(size.cast("double")) / math.log(BAND) + 1e-9).cast("int")


def _bands(lines: DataFrame) -> DataFrame:
    """Lines by which a set can meet another: (item, n, line, rest, small, large).

    With lines ordered from rare to common, the first line that two sets share leaves at most `rest` more in each, so Jaccard >= 1/2
    needs n + m <= 3 * (rest + 1) of both. A line therefore stands only under the pairs of size bands for which that holds: of one that all
    sets contain, and which comes last in them, little more than sets of one line are left. `rest` is found from a histogram per item (lines equally rare count as
    the first of them), so no set is sorted or gathered.
    """
    freq = lines.groupBy("line").agg(F.count("*").alias("df"))
    ranked = materialise(lines.join(freq, "line"))
    histogram = ranked.groupBy("item", "df").agg(F.count("*").alias("c"))
    rarer = F.sum("c").over(Window.partitionBy("item").orderBy("df").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranked.filter("df > 1").join(histogram.select("item", "df", F.coalesce(rarer, F.lit(0)).alias("_rarer")), ["item", "df"])
    placed = placed.withColumn("rest", F.col("n") - F.col("_rarer") - 1)
    n = F.col("n")
    low, high = F.ceil(n / 2), F.least(2 * n, 3 * (F.col("rest") + 1) - n)
    reach = placed.filter(high >= low).select("item", "n", "line", "rest", _band(n).alias("_own"), F.explode(F.sequence(_band(low), _band(high))).alias("_other"))
    return reach.select("item", "n", "line", "rest", F.least("_own", "_other").alias("small"), F.greatest("_own", "_other").alias("large"))


def similar_candidates(lines: DataFrame) -> DataFrame:
    """Pairs of different sets `lines(item, n, line)` that may have Jaccard >= 0.5: (a, na, b, nb), a < b, each once."""
    banded = materialise(_bands(lines))
    side = lambda s: banded.select(F.col("item").alias(s), F.col("n").alias(f"n{s}"), F.col("rest").alias(f"_r{s}"), "line", "small", "large")
    met = side("a").join(side("b"), ["line", "small", "large"]).filter("a < b and na <= 2 * nb and nb <= 2 * na and na + nb <= 3 * (least(_ra, _rb) + 1)")
    return met.select("a", "na", "b", "nb").distinct()


def similar_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of items whose line sets have Jaccard >= 0.5: (a, b, common, combined), a before b by file count, then name.

    `sets(item, line, files)` has distinct rows. Items with one and the same set are joined once, through a representative. Of the others,
    candidates come from `similar_candidates`, an exact prefix filter by size and position, and are checked by counting shared lines.
    """
    sets = materialise(sets.select("item", "line", "files"))
    reps = materialise(_representatives(sets))
    lines = sets.select("item", "line").join(reps.select("item", "n"), "item")
    cand = materialise(similar_candidates(lines))
    la = lines.select(F.col("item").alias("a"), "line")
    lb = lines.select(F.col("item").alias("b"), "line")
    shared = cand.join(la, "a").join(lb, ["b", "line"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    close = shared.withColumn("combined", F.col("na") + F.col("nb") - F.col("common")).filter("common * 2 >= combined")
    fa, fb = reps.select(F.col("item").alias("a"), F.col("files").alias("_fa")), reps.select(F.col("item").alias("b"), F.col("files").alias("_fb"))
    close = close.join(fa, "a").join(fb, "b")
    swap = F.struct(-F.col("_fa"), F.col("a")) > F.struct(-F.col("_fb"), F.col("b"))
    return close.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "common", "combined")


AT_ONCE = 500_000


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """The items of `pairs(m, a, b)`, all pairs up to some place of the order (m, b), decided one after the other."""
    dropped = set()
    for b, before in pairs.sort_values(["m", "b"]).groupby(["m", "b"], sort=False)["a"]:
        if not dropped.issuperset(before):
            dropped.add(b[1])
    items = pd.unique(pd.concat([pairs["a"], pairs["b"]]))
    return pd.DataFrame({"item": items, "kept": [x not in dropped for x in items]})


def _in_order(pairs: DataFrame, at_once: int) -> DataFrame:
    """(item, kept) of the earliest items, as many as have fewer than `at_once` pairs with earlier ones; no rows if the first has more."""
    nth = pairs.select("m", "b").orderBy("m", "b").limit(at_once + 1).agg(F.count("*").alias("k"), F.max(F.struct("m", "b")).alias("last"))
    up_to = nth.select(F.when(F.col("k") > at_once, F.col("last")).alias("last"))
    stretch = pairs.filter(F.coalesce(F.struct("m", "b") < up_to.scalar(), F.lit(True)))
    return stretch.groupBy().applyInPandas(_greedy, StructType([StructField("item", pairs.schema["a"].dataType), StructField("kept", BooleanType())]))


def dedup_sets(sets: DataFrame, at_once: int = AT_ONCE, slow: float = 0.5) -> DataFrame:
    """Items kept when, from most files to fewest, an item is dropped if a kept earlier one is similar.

    Copies of one set are dropped up front (the first stays or falls for all). The similar pairs are then decided in rounds. A parallel
    round keeps all items without an undecided earlier neighbour and drops their neighbours. Where that leaves more than the share `slow`
    of the pairs, as long chains do, a stretch of the order follows: the earliest items, with at most `at_once` pairs, are decided one after the
    other in one task. That is exact, as no decision depends on later items; a chain takes a round per `at_once` pairs instead of one per item.
    """
    sets = materialise(sets.select("item", "line", "files"))
    reps = materialise(_representatives(sets).select("item", "files"))
    pairs = materialise(similar_pairs(sets).join(reps.withColumnRenamed("item", "b"), "b").select("a", "b", (-F.col("files")).alias("m")))
    fallen, left, in_order = [], pairs.count(), False
    while left:
        in_order = left <= at_once or in_order
        if in_order:
            decided = materialise(_in_order(pairs, at_once))
        else:
            free = pairs.select(F.col("a").alias("item")).distinct().join(pairs.select(F.col("b").alias("item")), "item", "left_anti")
            decided = materialise(free.withColumn("kept", F.lit(True)))
        hit = pairs.join(decided.filter("kept").select(F.col("item").alias("a")), "a", "left_semi").select(F.col("b").alias("item"))
        out = materialise(decided.filter("not kept").select("item").unionByName(hit).distinct())
        fallen.append(out)
        gone = decided.select("item").unionByName(out).distinct()
        pairs = materialise(pairs.join(gone.withColumnRenamed("item", "a"), "a", "left_anti").join(gone.withColumnRenamed("item", "b"), "b", "left_anti"))
        before, left = left, pairs.count()
        in_order = not in_order and left > slow * before
    items = reps.select("item")
    for out in fallen:
        items = items.join(out, "item", "left_anti")
    return items
