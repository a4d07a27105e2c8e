"""Document fingerprints by MinHash.

A text's word shingles are hashed to 64 bits and run through many universal hash permutations ``(a * x + b) >> 32`` in numpy; the minimum of each is one
component of the signature. Two signatures agree in a component with the probability of their shingle sets' Jaccard likeness.
Near-duplicate texts are found by joining bands of components in Spark and verifying the candidates' Jaccard likeness on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from questlog.llm import ragged
from questlog.llm.components import components
from questlog.session import discard, materialise

WIDTH = 5
PERMUTATIONS = 128
SLICE_BYTES = 1 << 18
ROWS = 1024


def shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingle hashes, first shingle of each row and the end), slice by slice. Fewer words than `width`: the whole sequence is the shingle;
    no words: one shingle of its own."""
    data, offsets = ragged.utf8(texts)
    for a, b in ragged.slices(offsets, SLICE_BYTES):
        word, first = ragged.words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        counts = np.diff(first)
        pad = np.maximum(width - counts, 0)  # rows are filled up with zero words to one shingle
        if pad.any():
            wide = np.zeros(len(word) + int(pad.sum()), np.uint64)
            wide[np.arange(len(word)) + np.repeat(np.cumsum(pad) - pad, counts)] = word
            word, counts = wide, counts + pad
            first = np.concatenate([[0], np.cumsum(counts)])
        mixed = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[k:len(word) - width + 1 + k]
        owner = np.repeat(np.arange(b - a), counts)
        inside = owner[:len(mixed)] == owner[width - 1:]
        yield ragged.mixed(mixed[inside]), np.concatenate([[0], np.cumsum(counts - width + 1)])


@cache
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(count)
    a, b = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signatures(texts: pa.Array, count: int = PERMUTATIONS, width: int = WIDTH) -> np.ndarray:
    """MinHash signatures, a row of `count` 16-bit components (the low half of each 32-bit minimum) per text."""
    a, b = permutations(count)
    parts = []
    for hashes, first in shingles(texts, width):
        out = np.empty((count, len(first) - 1), np.uint32)
        for k in range(count):
            out[k] = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(32), first[:-1])
        parts.append((out & 0xFFFF).astype(np.uint16).T)
    return np.concatenate(parts) if parts else np.zeros((0, count), np.uint16)


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of a text (whole code points, rounded down) replaced by the first as many of the text that follows it, or by all of it."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def in_order(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) dealt into ranges of doc_id and sorted inside each, with column `ahead`: at the end of each range stands a copy of
    the next range's first row, at the end of the last one that of the first row of all, so that every row is followed by its successor.

    The ranges' bounds are percentiles of doc_id alone; the text moves once. Null ids come first; rows of equal id are in the order of their texts.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, least = docs.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)] or [0.5], F.lit(10 * blocks)).alias("c"), F.min("doc_id").alias("m")).first()
    cuts = np.array(sorted(c for c in set(cuts or []) if c > least), np.int64)
    last = len(cuts)

    @F.arrow_udf(IntegerType())
    def block_of(ids: pa.Array) -> pa.Array:
        held = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(cuts, held, "right").astype(np.int32))

    rows = docs.select("doc_id", "text", F.lit(False).alias("ahead"), block_of(F.col("doc_id")).alias("block"))
    heads = docs.filter(F.col("doc_id").isin([int(c) for c in cuts])) if last else docs.filter(F.lit(False))
    heads = heads.select("doc_id", "text", F.lit(True).alias("ahead"), (block_of(F.col("doc_id")) - 1).alias("block"))
    first = docs.select("doc_id", "text").orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).limit(1).select(
        "doc_id", "text", F.lit(True).alias("ahead"), F.lit(last).alias("block"))
    return rows.unionByName(heads).unionByName(first).repartition("block").sortWithinPartitions(
        "block", "ahead", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to fingerprints; the last row of a batch waits for the next batch."""
    held = None
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            batch = whole.slice(at, ROWS)
            ids, ahead = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks = signatures(batch.column(1))
            if held is not None:
                ids, texts, ahead, marks = [held[0], *ids], [held[1], *texts], [False, *ahead], np.concatenate([held[2][None], marks])
            rows = [i for i in range(len(ids) - 1) if not ahead[i]]
            changed = [edited(texts[i], texts[i + 1]) for i in rows]
            other = signatures(pa.array(changed, pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([fingerprint(marks[i]) for i in rows], pa.string()), pa.array([fingerprint(m) for m in other], pa.string()),
                pa.array([float((marks[i] == m).mean()) for i, m in zip(rows, other, strict=True)], pa.float64()),
                pa.array([float((marks[i] == marks[i + 1]).mean()) for i in rows], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = None if ahead[-1] else (ids[-1], texts[-1], marks[-1])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs` (doc_id, text).

    ``near_edited`` and ``near_next`` are the shares of equal components: likeness to the edited text and to the next document by doc_id, after
    the last the first. A null text is empty; texts without words share one fingerprint. A single row follows itself. Repeated rows each
    give a row. Other columns are left. An empty table gives an empty result.
    """
    kind = StructType([StructField("doc_id", LongType()), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                       StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])
    return in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text", "ahead").mapInArrow(_compare, kind)


BANDS = 32
GROUP_LIMIT = 32
BLOCK = 128


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for hashes, first in shingles(texts):
        for k in range(len(first) - 1):
            yield np.unique(hashes[first[k]:first[k + 1]])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _decoded(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def links(texts: DataFrame, threshold: float = 0.8, bands: int = BANDS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Verified links (a, b) between the nodes of `texts` (node, text; one row per different text) that connect all candidate pairs with Jaccard >= threshold.

    Candidates agree in one of `bands` bands of the signature. Bands shared by up to `group_limit` texts give their pairs, each verified once. Members of
    larger groups would give pairs with the square of their number; they are dealt into blocks instead, and a task, which sees two blocks of a group, verifies
    only pairs that its earlier links do not connect yet, so a crowd of near copies costs about one comparison per member and block.
    """
    rows = PERMUTATIONS // bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                marks = signatures(batch.column(1)).astype(np.uint64)
                keys = np.zeros((len(batch), bands), np.uint64)
                for k in range(rows):
                    keys = ragged.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + marks[:, k:bands * rows:rows])
                keys = ragged.mixed(keys + np.arange(bands, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(keys.ravel().view(np.int64))], names=["node", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch.column(1))], pa.binary())], names=["node", "shingles"])

    @F.arrow_udf(BooleanType())
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(x, y) >= threshold for x, y in zip(_decoded(a), _decoded(b), strict=True)], pa.bool_())

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = [*left.column("node").to_pylist(), *right.column("r_node").to_pylist()]
        sets = [*_decoded(left.column("shingles")), *_decoded(right.column("r_shingles"))]
        root = list(range(len(nodes)))
        same = {}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, n in enumerate(nodes):
            root[i] = same.setdefault(n, i)
        found = []
        for i in range(len(left)):
            for j in range(len(left), len(nodes)):
                a, b = find(i), find(j)
                if a != b and jaccard(sets[i], sets[j]) >= threshold:
                    root[max(a, b)] = min(a, b)
                    found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    keyed = materialise(texts.select("node", "text").mapInArrow(sign, "node long, key long"))
    shared = materialise(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "key"))
    candidates = texts.select("node", "text").join(shared.select("node").distinct(), "node", "left_semi")
    sets = materialise(candidates.mapInArrow(gather, "node long, shingles binary"))
    small = shared.filter(F.col("members") <= group_limit)
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    verified = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
                .filter(alike(F.col("sa"), F.col("sb"))).select("a", "b"))
    crowd = shared.filter(F.col("members") > group_limit).withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(sets, "node")
    crowd = materialise(crowd.select("key", "node", "own", "blocks", "shingles"))
    left = crowd.withColumn("other", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1))).select("key", "own", "other", "node", "shingles")
    right = crowd.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("own")))).select(
        F.col("key").alias("r_key"), F.col("first").alias("r_own"), F.col("own").alias("r_other"), F.col("node").alias("r_node"), F.col("shingles").alias("r_shingles"))
    crowded = left.groupBy("key", "own", "other").cogroup(right.groupBy("r_key", "r_own", "r_other")).applyInArrow(compare, "a long, b long")
    found = materialise(verified.unionByName(crowded).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(keyed, shared, sets, crowd)
    return found


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, node, component_id for every row of `docs` (doc_id, text; other columns are left): documents whose sets of five-word shingles have Jaccard likeness of at
    least `threshold` are linked, component_id is the smallest doc_id reachable.

    Equal texts are one node (a 64-bit hash of the text). Null is an empty text; texts without words have one common shingle and so are alike. Null ids never
    name a component. Repeated rows each give a row. An empty table gives an empty result. A pair at the threshold shares no band with a probability below 1e-7.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least_id")))
    texts = rows.select("node", "text").dropDuplicates(["node"])
    joined = components(links(texts, threshold, bands, group_limit))
    rooted = materialise(nodes.join(joined, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")))
    named = materialise(rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("node", "component_id"))
    discard(nodes, rooted)
    return rows.select("doc_id", "node").join(named, "node")
