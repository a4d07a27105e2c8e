"""Ordered running values that survive hot groups.

A window over (key ORDER BY seq) puts a whole key into one task. Logs have characters and files that
hold a large share of all lines, so running values are computed as a prefix scan instead: inside small
blocks by a window, over the blocks by the same scan one level up, and the two are combined. `blocks`
names, from coarse to fine, columns that follow the scan order inside a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BLOCK = 65_536

# scan order of a line, and the blocks that follow it
SEQ = ["root_no", "loose", "folder", "path", "line_no"]
SEQ_BLOCKS = [["root_no", "loose", "folder"], ["path_head"], ["path", "line_block"]]
FILE_BLOCKS = [["line_block"]]


def seq() -> Column:
    return F.struct(*SEQ)


def line_block(line_no: str = "line_no") -> Column:
    return F.floor(F.col(line_no) / LINE_BLOCK)


def path_head(path: str = "path") -> Column:
    """Folder plus year and month of the file name: follows the order of the paths of a folder."""
    return F.regexp_extract(F.col(path), r"(?s)^(.*/[^/]{0,15})", 1)


_REDUCE = {
    "last": lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
    "sum": lambda v, order: F.sum(v),
    "max": lambda v, order: F.max(v),
}
_OVER = {"last": lambda v: F.last(v, ignorenulls=True), "sum": F.sum, "max": F.max}
_MERGE = {
    "last": lambda here, before: F.coalesce(here, before),
    "sum": lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
    "max": lambda here, before: F.greatest(here, before),
}


def prefix_scan(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]],
                blocks: list[list[str]] = (), inclusive: bool = True, attach: DataFrame | None = None) -> DataFrame:
    """Add, per row, the running 'last' (non-null), 'sum' or 'max' of earlier rows of the same key.

    `values` maps a new column to (how, expression). With inclusive=False the row itself does not count.
    `attach` is a table keyed by some of `keys`: its columns travel with the block summaries, so the rows
    themselves are not shuffled once more for it.
    """
    group = [*keys, *[c for level in blocks for c in level]]
    frame = (Window.partitionBy(*group).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    staged = df.withColumns({f"_in_{n}": v for n, (_, v) in values.items()})
    here = staged.withColumns({n: _OVER[how](F.col(f"_in_{n}")).over(frame) for n, (how, _) in values.items()})
    if not blocks:
        return here.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n, (how, _) in values.items() if how == "sum"}).drop(
            *[f"_in_{n}" for n in values])
    at = F.struct(*order)
    blocks_df = staged.groupBy(*group).agg(*[_REDUCE[how](F.col(f"_in_{n}"), at).alias(f"_b_{n}") for n, (how, _) in values.items()])
    before = prefix_scan(blocks_df, keys, blocks[-1], {f"_c_{n}": (how, F.col(f"_b_{n}")) for n, (how, _) in values.items()},
                         blocks[:-1], inclusive=False)
    before = before.select(*group, *[f"_c_{n}" for n in values])
    extra = []
    if attach is not None:
        on = [c for c in attach.columns if c in keys]
        extra = [c for c in attach.columns if c not in keys]
        before = before.join(attach, on, "left")
    out = here.join(before, group, "left")
    merged = {n: _MERGE[how](F.col(n), F.col(f"_c_{n}")) for n, (how, _) in values.items()}
    return out.select(*[c for c in df.columns if c not in values], *extra, *[merged[n].alias(n) for n in values])


CROWD = 1_000_000  # rows of a key that one window may hold
WINDOW_ROWS = 100_000  # rows of a task that holds whole keys


def by_crowd(df: DataFrame, key: str, dealt: list[str], run: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """`run(rows, whole)` over `df`: keys of at most CROWD rows come whole, dealt by the columns `dealt` (which begin with the key) to tasks of a bounded size, so that windows
    and aggregates over these columns need no further shuffle. Keys with more rows, if there are any, are run once more with `whole` false, for which `run` is to use
    blocks: there are few of them, but one may hold most rows, while blocks of all the other keys would be nearly as many as their rows.
    """
    n = df.count()
    deal = lambda rows: rows.repartition(max(1, -(-n // WINDOW_ROWS)), *dealt)
    crowd = df.groupBy(key).count().filter(F.col("count") > CROWD).select(key)
    if n <= CROWD or crowd.isEmpty():
        return run(deal(df), True)
    crowd = F.broadcast(crowd)  # at most one row in CROWD
    return run(deal(df.join(crowd, key, "left_anti")), True).unionByName(run(df.join(crowd, key, "left_semi"), False))
