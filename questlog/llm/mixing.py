"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source x language x topic). The cells' weights are raked: scaled to each dimension's
target marginal in turn, again and again, until all marginals hold. A document is then drawn with its cell's rate, the
tokens that the cell should give over those that it has. Everything is a DataFrame operation; only cells, never documents, take part in the fitting.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.session import discard, materialise

DIMENSIONS = ("source", "lang", "topic")
#: How far a target is moved from the natural share towards equal shares: share ** power, normalised.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form, where a table has no topic column: tables, shouting, code-like marks, prose."""
    body = F.coalesce(text, F.lit(""))
    return (F.when(F.trim(body) == "", "empty").when(body.contains(" | "), "table").when(body.contains("!!"), "shout")
            .when(body.rlike(r"[#$%&*]{3}"), "marks").when(body.rlike(r"[0-9]{4}"), "figures").otherwise("prose"))


def unit_draw(key: Column) -> Column:
    """A number in [0, 1) fixed by the key: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cells_of(items: DataFrame) -> DataFrame:
    """Tokens per cell; items: the dimensions and tokens. Cells without tokens carry no weight and are left out."""
    return items.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")


def tempered_targets(cells: DataFrame, powers: dict[str, float] | None = None) -> DataFrame:
    """(dimension, value, target): natural token shares raised to a power and normalised, for each dimension."""
    parts = None
    for d in DIMENSIONS:
        part = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens")).select(
            F.lit(d).alias("dimension"), "value", F.pow("tokens", F.lit((powers or POWERS)[d])).alias("target"))
        parts = part if parts is None else parts.unionByName(part)
    return _normalised(parts)


def _normalised(targets: DataFrame) -> DataFrame:
    norms = targets.groupBy("dimension").agg(F.sum("target").alias("norm"))
    return targets.join(norms, "dimension").select("dimension", "value", (F.col("target") / F.col("norm")).alias("target"))


def rake(cells: DataFrame, targets: DataFrame, max_rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """`cells` with column weight (sums to 1), whose marginals equal the targets within `tolerance`.

    A value without target gets weight 0; a target without cells is given to the others of its dimension in proportion. A round is, for
    each dimension, one partial aggregate, one join with its few sums and one written table, so that plans stay small. Where `max_rounds` do not
    reach the tolerance (no weights can, if the cells that exist contradict the targets), a warning tells the largest correction still made.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if total is None:
        return cells.withColumn("weight", F.lit(0.0))
    now = materialise(cells.withColumn("weight", F.col("tokens") / F.lit(total)).withColumn("off", F.lit(0.0)))
    present = None
    for d in DIMENSIONS:
        part = now.select(F.lit(d).alias("dimension"), F.col(d).alias("value")).distinct()
        present = part if present is None else present.unionByName(part)
    shares = materialise(_normalised(targets.join(present, ["dimension", "value"])))
    for _ in range(max_rounds):
        for i, d in enumerate(DIMENSIONS):
            goal = shares.filter(F.col("dimension") == d).select(F.col("value").alias(d), "target")
            factors = now.groupBy(d).agg(F.sum("weight").alias("has")).filter("has > 0").join(goal, d).select(
                d, (F.col("target") / F.col("has")).alias("factor"))
            factor = F.coalesce("factor", F.lit(0.0))
            moved = F.when(F.col("weight") > 0, F.abs(factor - 1)).otherwise(0.0)
            new = materialise(now.join(factors, d, "left").select(
                *DIMENSIONS, "tokens", (F.col("weight") * factor).alias("weight"), (F.greatest("off", moved) if i else moved).alias("off")))
            discard(now)
            now = new
        residual = now.agg(F.max("off")).first()[0]
        if residual <= tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {max_rounds} rounds with corrections of up to {residual:.3g}; the tolerance is {tolerance:g}", stacklevel=2)
    discard(shares)
    return now.drop("off")


def rates(cells: DataFrame, share: float, max_copies: float = 1.0) -> DataFrame:
    """`cells` with column rate, copies of a document to draw: ``min(max_copies, scale * weight / tokens)``.

    `scale` is set so that the expected tokens are `share` of all tokens, as far as `max_copies` lets them: what full cells cannot give,
    the others give in proportion to their weights. The expected tokens are a concave chain of straight lines in `scale`, so Newton
    steps from below reach the exact scale; each step is one aggregate over the cells.
    """
    if share <= 0:
        raise ValueError("share must be positive")
    cap = F.lit(float(max_copies)) * F.col("tokens")
    total = cells.agg(F.sum("tokens")).first()[0]
    scale = 0.0
    while total is not None:
        full = cap <= F.lit(scale) * F.col("weight")
        given, slope = cells.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        better = scale if slope <= 0 else (share * total - given) / slope
        if better <= scale:
            break
        scale = better
    return cells.withColumn("rate", F.least(F.lit(float(max_copies)), F.lit(scale) * F.col("weight") / F.col("tokens")))


def mix(items: DataFrame, targets: DataFrame | None = None, share: float = 0.8, max_copies: float = 1.0,
        max_rounds: int = 40, tolerance: float = 1e-9, carry: str | None = None, also: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, rate, copies for every row of `items` (doc_id, the dimensions, tokens).

    ``weight`` is the raked share of the document's cell in the mixture, ``rate`` its calibrated number of copies, ``copies`` that
    number rounded down or up by a draw fixed by doc_id. Null dimension values count as the empty string. A document without tokens
    takes no part in the weights: weight 0, and it is kept once (rate 1), as it changes no marginal. Repeated rows are drawn
    alike. Other columns of `items` are left, but for one named in `carry`. An empty table gives an empty result. For each name in `also` columns
    <name>_rate and <name>_copies follow: the same draw with that many copies at most (`math.inf`: any number, which meets the targets).
    """
    kept = [carry] if carry else []
    filled = items.select("doc_id", *(F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in DIMENSIONS),
                          F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), *kept)
    cells = materialise(cells_of(filled))
    fitted = rake(cells, targets if targets is not None else tempered_targets(cells), max_rounds, tolerance)
    rated, names = rates(fitted, share, max_copies), {"rate": "copies"}
    for name, cap in (also or {}).items():
        other = rates(fitted, share, cap).select(*DIMENSIONS, F.col("rate").alias(f"{name}_rate"))
        rated, names[f"{name}_rate"] = rated.join(other, list(DIMENSIONS)), f"{name}_copies"
    rated = materialise(rated.select(*DIMENSIONS, "weight", *names))
    discard(cells, fitted)
    out = filled.join(rated, list(DIMENSIONS), "left").withColumns(
        {"weight": F.coalesce("weight", F.lit(0.0)), **{r: F.coalesce(r, F.when(F.col("tokens") > 0, 0.0).otherwise(1.0)) for r in names}})

    def copies(rate: str) -> Column:
        whole = F.floor(rate)
        return (whole + F.when(unit_draw(F.col("doc_id")) < F.col(rate) - whole, 1).otherwise(0)).cast("int")

    drawn = [c for rate, name in names.items() for c in (F.col(rate), copies(rate).alias(name))]
    return out.select("doc_id", *DIMENSIONS, "tokens", "weight", *drawn, *kept)


def marginals(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """dimension, value, target, expected, drawn for the values in the result of `mix`: shares of tokens by the targets, by the rates and by the copies drawn.

    Where `max_copies` clips rates, `expected` misses `target`; without clipping (`max_copies` infinite) it meets it.
    """
    parts = None
    for d in DIMENSIONS:
        part = mixed.filter("tokens > 0").groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(
            F.sum(F.col("tokens") * F.col("rate")).alias("expected"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
        parts = part if parts is None else parts.unionByName(part)
    norms = parts.groupBy("dimension").agg(F.sum("expected").alias("e"), F.sum("drawn").alias("d"))
    return parts.join(norms, "dimension").join(targets, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("expected") / F.col("e")).alias("expected"), (F.col("drawn") / F.col("d")).alias("drawn"))
