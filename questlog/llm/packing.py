"""Packing token sequences by minimum bin slack.

A document's ids (and a closing id) are cut into full windows and one remainder. Remainders are packed by their lengths alone: for the
longest one left, a bitset subset-sum over the lengths that remain finds the multiset that fills the window closest to capacity, and the
pattern is repeated as often as the counts allow. That plan is made from a histogram of at most `capacity` lengths, so its size does not depend
on the data; rows then find their place in it by their rank among the remainders of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from questlog.llm import bpe
from questlog.session import materialise

CAPACITY = 2048
CLOSING_ID = 1
PIECE_BATCH = 4096


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, if wanted): every document's ids and closing id, cut every `capacity` ids."""
    kind = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if with_ids:
        kind = kind.add("ids", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(path)
        closing = np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            row, start, length, crc, tokens, held = [], [], [], [], [], []

            def out():
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens))]
                if with_ids:
                    columns.append(pa.array(held, pa.binary()))
                return pa.RecordBatch.from_arrays(columns, names=[f.name for f in kind])

            for k, ids in enumerate(bpe.row_ids(vocab, batch.column(1))):
                raw, size = memoryview(ids.astype("<u4").tobytes()), len(ids) + 1
                for at in range(0, size, capacity):
                    part = raw[4 * at:4 * (at + capacity)]
                    last = at + capacity >= size
                    value = zlib.crc32(part)
                    row.append(k)
                    start.append(at)
                    length.append(min(capacity, size - at))
                    crc.append(zlib.crc32(closing, value) if last else value)
                    tokens.append(size)
                    if with_ids:
                        held.append(bytes(part) + closing if last else bytes(part))
                if len(row) >= PIECE_BATCH:
                    yield out()
                    for c in (row, start, length, crc, tokens, held):
                        c.clear()
            yield out()

    return docs.select("doc_id", "text").mapInArrow(cut, kind)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(how many of each length, how many sequences of that kind), covering `counts` exactly."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        longest = next(iter(left))
        pattern = _fill(left, longest, capacity - longest)
        times = min(left[n] // m for n, m in pattern.items())
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def _fill(left: dict[int, int], longest: int, room: int) -> dict[int, int]:
    """`longest` and the multiset of other lengths whose sum comes closest to `room`: bit s of `reach` says that sum s can be had."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n, count in left.items():
        if n > room:
            continue
        spare = min(count - (n == longest), room // n)
        take = 1
        while spare > 0:
            take = min(take, spare)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            spare -= take
            take *= 2
        if reach >> room:
            break
    at, pattern = reach.bit_length() - 1, {longest: 1}
    for n, take, before in reversed(steps):
        if not (before >> at) & 1:
            at -= n * take
            pattern[n] = pattern.get(n, 0) + take
    return pattern


def _lookup(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern the first rank, first sequence, copies in a sequence and offset; sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for n, m in sorted(pattern.items(), reverse=True):
            rows.append((n, rank.get(n, 0), base, m, offset))
            rank[n] = rank.get(n, 0) + m * times
            offset += n * m
        base += times
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return {k: np.array(v, np.int64) for k, v in zip(names, zip(*rows, strict=True), strict=True)} if rows else {k: np.zeros(0, np.int64) for k in names}


def pack(cut: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """`cut` (written pieces: doc_id, start, length, further columns) with sequence_id and offset.

    Every piece gets one place; places in a sequence are gapless from 0 and at most `capacity` long together. Pieces of equal length are ranked
    by doc_id and start in two steps (inside hash buckets, then by the buckets' counts), so that a length which very many share is many tasks.
    """
    buckets = buckets or int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = _lookup(plan(counts, capacity))
    width = np.int64(1 << 44)
    starts = table["length"] * width + table["rank"]
    kind = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    @F.arrow_udf(kind)
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(starts, n * width + r, "right") - 1
        r = r - table["rank"][at]
        copies = table["copies"][at]
        return pa.StructArray.from_arrays([pa.array(table["sequence"][at] + r // copies), pa.array(table["offset"][at] + (r % copies) * n)],
                                          names=["sequence_id", "offset"])

    dealt = cut.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("length", "bucket_").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank_", F.row_number().over(inside)).join(firsts, ["length", "bucket_"]).withColumn(
        "place_", place(F.col("length"), F.col("before_") + F.col("rank_") - 1))
    return ranked.select(*cut.columns, "place_.sequence_id", "place_.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece of every row of `docs` (doc_id, text).

    A null or empty text is its closing id alone. Documents longer than a window are cut into full windows, each a sequence of its own, and a
    remainder. Repeated rows and null ids are packed like others; other columns are left. An empty table gives an empty result.
    """
    return pack(materialise(pieces(docs, path, capacity, closing_id, with_ids)), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array of `capacity` ints, padded with 0), tokens: the packed sequences themselves. `packed` has ids; a group is at most
    `capacity` pieces."""
    kind = StructType([StructField("sequence_id", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("tokens", IntegerType())])

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int32)
        full = np.zeros(capacity, np.int32)
        full[:len(ids)] = ids
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([full], pa.list_(pa.int32())),
                         "tokens": pa.array([len(ids)], pa.int32())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, kind)
