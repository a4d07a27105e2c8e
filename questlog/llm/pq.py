"""Embedding near-duplicates by product quantisation.

Vectors are assigned to coarse inverted lists; what is left of a vector after its list's centroid is coded by one codeword per subspace, and the
length of the coding error is kept. A query goes to every list whose cell can hold a neighbour, compares its asymmetric table-lookup
distances with all codes there, and keeps those that could be near given their coding errors; these are reranked by exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.llm.components import components
from questlog.session import discard, materialise

SUBSPACES = 8
CODEWORDS = 256
PAIR_CHUNK = 1 << 17


@dataclass
class Index:
    """Coarse centroids and, per subspace, codewords of the residuals; all bounded by the fitting sample."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    splits: list[np.ndarray]
    radius: float
    reach: float

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between the centroids."""
        square = (self.centroids**2).sum(1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * self.centroids @ self.centroids.T, 1e-30))

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own list of each vector, squared distances to all centroids)."""
        far = (unit**2).sum(1)[:, None] - 2 * unit @ self.centroids.T + (self.centroids**2).sum(1)
        return far.argmin(axis=1), far

    def probes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: lists whose bounding plane with the vector's own list is at most `reach` away from the vector."""
        own, far = self.lists(unit)
        plane = (far - far[np.arange(len(unit)), own][:, None]) / (2 * self.apart[own])
        plane[np.arange(len(unit)), own] = 0.0
        return np.nonzero(plane <= self.reach)

    def code(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths of the coding errors)."""
        rest, codes, error = unit - self.centroids[own], [], np.zeros(len(unit))
        for split, book in zip(self.splits, self.codebooks, strict=True):
            part = rest[:, split]
            far = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            best = far.argmin(axis=1)
            codes.append(best.astype(np.uint8))
            error += ((part - book[best]) ** 2).sum(1)
        return np.stack(codes, axis=1), np.sqrt(error)

    def tables(self, unit: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances of each query's residual to each codeword, per subspace."""
        rest = unit - self.centroids[at]
        return [((rest[:, s] ** 2).sum(1)[:, None] - 2 * rest[:, s] @ b.T + (b**2).sum(1)).astype(np.float32) for s, b in zip(self.splits, self.codebooks, strict=True)]


def _kmeans(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * points @ centers.T).argmin(axis=1)
        sums = np.stack([np.bincount(near, weights=points[:, d], minlength=len(centers)) for d in range(points.shape[1])], axis=1)
        counts = np.bincount(near, minlength=len(centers))
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centers


def fit(sample: np.ndarray, lists: int, threshold: float, sigmas: float | None, rounds: int = 8) -> Index:
    """An index from unit vectors. `sigmas`: how many standard deviations of a random direction's share of the radius a plane may be away;
    None: the whole radius, beyond which no neighbour can be."""
    rng, dims = np.random.default_rng(7), sample.shape[1]
    centroids = _kmeans(sample, min(lists, len(sample)), rounds, rng)
    own = ((centroids**2).sum(1) - 2 * sample @ centroids.T).argmin(axis=1)
    rest = sample - centroids[own]
    splits = np.array_split(np.arange(dims), min(SUBSPACES, dims))
    books = [_kmeans(rest[:, s], min(CODEWORDS, len(rest)), rounds, rng) for s in splits]
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    part = 1.0 if sigmas is None else min(1.0, sigmas / math.sqrt(dims))
    return Index(centroids, books, splits, radius, radius * part + 1e-6)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _units(column, dims: int) -> np.ndarray:
    raw = _matrix(column, dims)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return raw / np.sqrt((raw**2).sum(1))[:, None]


def valid(vector) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _spanning(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The least number in each one's component."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_counts(classes: DataFrame, index: Index, threshold: float, block_rows: int = 4096) -> DataFrame:
    """(node, links, root) rows for `classes` (node, weight, vector): parts of the weight that a node is linked with, and links of a spanning forest.

    A group is a block of queries against a block of one list; lists and their queries are cut into blocks of about `block_rows`, so a list that
    holds most vectors is many groups. A group gives a row per node that has links there, never its pairs.
    """
    dims = index.centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                unit = _units(part.column("vector"), dims)
                own, _ = index.lists(unit)
                codes, error = index.code(unit, own)
                row, probe = index.probes(unit)
                where = pa.array(np.concatenate([np.arange(len(part)), row]))
                stored = len(part)
                yield pa.RecordBatch.from_arrays([
                    part.column("node").take(where), part.column("weight").take(where), part.column("vector").take(where),
                    pa.array(np.concatenate([own, probe]).astype(np.int32)), pa.array([True] * stored + [False] * len(row)),
                    pa.array([c.tobytes() for c in codes] + [None] * len(row), pa.binary()), pa.array(np.concatenate([error, np.zeros(len(row))])),
                ], names=["node", "weight", "vector", "list", "stored", "codes", "error"])

    vector_type = classes.schema["vector"].dataType.simpleString()
    placed = materialise(classes.select("node", "weight", "vector").mapInArrow(
        assign, f"node long, weight long, vector {vector_type}, list int, stored boolean, codes binary, error double"))
    sizes = placed.groupBy("list").agg(F.count(F.when(F.col("stored"), 1)).alias("s"), F.count(F.when(~F.col("stored"), 1)).alias("q")).filter("s > 0").select(
        "list", blocks_of("s", block_rows).alias("s_blocks"), blocks_of("q", block_rows).alias("q_blocks"))
    placed_blocks = placed.join(F.broadcast(sizes), "list")  # a row per list: bounded by the number of centroids
    stored = placed_blocks.filter("stored").withColumn("s_block", F.pmod(F.xxhash64("node"), "s_blocks").cast("int")).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select("list", "s_block", "q_block", "node", "weight", "vector", "codes", "error")
    queries = placed_blocks.filter(~F.col("stored")).withColumn("q_block", F.pmod(F.xxhash64("node"), "q_blocks").cast("int")).withColumn(
        "s_block", F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1))).select(
        *(F.col(c).alias(f"q_{c}") for c in ("list", "s_block", "q_block", "node", "vector")))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            q, x = _units(left.column("q_vector"), dims), _units(right.column("vector"), dims)
            q_node, x_node = left.column("q_node").to_numpy(), right.column("node").to_numpy()
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            near = (index.radius + right.column("error").to_numpy() + 1e-5) ** 2
            weight = right.column("weight").to_numpy()
            tables = index.tables(q, left.column("q_list")[0].as_py())
            links, firsts, seconds = np.zeros(len(q), np.int64), [], []
            step = max(1, PAIR_CHUNK // len(x))
            for at in range(0, len(q), step):
                far = sum(t[at:at + step][:, codes[:, m]] for m, t in enumerate(tables))
                i, j = np.nonzero(far <= near[None, :])
                i += at
                other = q_node[i] != x_node[j]
                i, j = i[other], j[other]
                hit = np.einsum("ij,ij->i", q[i], x[j]) >= threshold
                i, j = i[hit], j[hit]
                links += np.bincount(i, weights=weight[j], minlength=len(q)).astype(np.int64)
                firsts.append(i)
                seconds.append(j)
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            if len(a):
                code, names = pd.factorize(np.concatenate([q_node[a], x_node[b]]))
                root = names[_spanning(code[:len(a)], code[len(a):], len(names))]
                out.append((names, np.zeros(len(names), np.int64), root))
                hits = np.flatnonzero(links)
                out.append((q_node[hits], links[hits], q_node[hits]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("node", "links", "root"), parts, strict=True)})

    keys = ["list", "s_block", "q_block"]
    found = materialise(queries.groupBy(*(f"q_{k}" for k in keys)).cogroup(stored.groupBy(*keys)).applyInArrow(compare, "node long, links long, root long"))
    discard(placed)
    return found


def blocks_of(count: str, rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(rows))).cast("int")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample_rows: int = 16_384, max_lists: int = 1_024, sigmas: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding; other columns are left).

    n_links counts the other rows with cosine >= `threshold`; component_id is the smallest vec_id reachable. Equal vectors are one class with a
    weight, so copies cost nothing. Vectors that are null, zero, or hold null or non-finite components, and those whose length is not
    the table's most frequent one, link with nothing: 0 links, their own vec_id. Null ids never name a component unless it holds nothing else;
    repeated rows link with one another. An empty table gives an empty result.

    The index is fitted on about `sample_rows` vectors chosen by a hash; it has about a quarter of the square root of the number of vectors as lists,
    at most `max_lists` and a sixteenth of the sample. A query goes to every list whose plane is within the link radius, and neither that bound nor the
    table-lookup filter loses a link, whatever the directions of the neighbours. Vectors without clusters are thus compared with most lists: few lists
    keep the copies of a vector few. `sigmas` narrows the reach to what suffices for a neighbour in a random direction of all dimensions; it loses links of low rank.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector")).withColumn("good", valid(F.col("vector")))
    width = rows.filter("good").groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if width is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.withColumn("good", F.col("good") & (F.size("vector") == width["d"])).withColumn("node", F.when(F.col("good"), F.xxhash64("vector")))
    classes = materialise(rows.filter("good").groupBy("node", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id")))
    count = classes.count()
    share = min(1.0, sample_rows / count)
    draw = F.shiftrightunsigned(F.xxhash64("node"), 11).cast("double") * F.lit(2.0**-53)
    drawn = classes.filter(draw < share) if share < 1 else classes
    sample = _units(drawn.select("vector").toArrow().column("vector"), width["d"])
    index = fit(sample, max(1, min(max_lists, len(sample) // 16, round(math.sqrt(count) / 4))), threshold, sigmas)
    found = link_counts(classes, index, threshold)
    joined = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.join(links, "node", "left").join(joined, "node", "left").select(
        "node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("node", "n_links", "component_id"))
    discard(found, rooted)
    out = rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
