"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each a word of the perfect (23,12) Golay code with errors. Every 23-bit word lies
within 3 bits of exactly one codeword; the codewords of a word and of its 23 neighbours are one or six, and any two words at
most 2 bits apart share one of them. Of two fingerprints at most 2 bits apart one segment of three is equal (pigeonhole)
and the next one is at most 2 bits apart, so they share one of at most 18 keys (segment, its value, codeword of
the next). Fingerprints that share a key are joined and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from questlog.llm.components import components
from questlog.session import discard, materialise

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, fixed value of the code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, width)
SEED = 42
BUCKET_LIMIT = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, each counted as often as it occurs."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def fingerprint_udf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array((fingerprint(t.as_py()) for t in batch), type=pa.int64(), size=len(batch))


@cache
def error_table() -> np.ndarray:
    """For each 11-bit syndrome the error pattern of at most 3 bits that causes it."""
    table = np.zeros(2048, dtype=np.int64)
    for bits in range(1, 4):
        for error in _patterns(23, bits):
            table[int(syndrome(np.array([error]))[0])] = error
    return table


def _patterns(width: int, bits: int) -> Iterator[int]:
    from itertools import combinations

    for places in combinations(range(width), bits):
        yield sum(1 << p for p in places)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator polynomial over GF(2)."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs without repetition: the 12-bit indices of the codewords nearest to each word and to its 23 neighbours."""
    table = error_table()
    near = words.astype(np.int64)[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    flat = near.ravel()
    index = ((flat ^ table[syndrome(flat)]) >> 11).reshape(near.shape)
    index.sort(axis=1)
    fresh = np.ones(index.shape, dtype=bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    return np.nonzero(fresh)[0], index[fresh]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each 64-bit fingerprint; two at most 2 bits apart share one."""
    words = prints.astype(np.int64).view(np.uint64)
    part = [((words >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, index = codewords(part[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (part[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _explode_keys(batches):
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        row, key = fuzzy_keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(prints[row]), pa.array(key)], names=["fp", "key"])


def _explode_hubs(batches):
    """A fingerprint under itself and its 64 neighbours: two share a hub exactly if they are at most 2 bits apart."""
    flips = np.concatenate([[0], (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)])
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        hubs = prints[:, None] ^ flips[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(prints, 65)), pa.array(hubs.ravel())], names=["fp", "hub"])


def links(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all those at most 2 bits apart.

    Keys that only one fingerprint has are left after one aggregate. Keys of up to `bucket_limit` fingerprints are joined and
    verified: every pair at most 2 bits apart is a row. In larger buckets pairs would grow with the square, so their
    fingerprints meet exactly and in linear size instead: each is sent to itself and its 64 neighbours as hubs, and linked to the
    least one of each hub. Members of a hub are at most 2 bits apart, and any two at most 2 bits apart share a hub.
    """
    keyed = materialise(prints.select("fp").mapInArrow(_explode_keys, "fp long, key long"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    bucketed = materialise(keyed.join(shared, "key"))
    discard(keyed)
    small = bucketed.filter(F.col("members") <= bucket_limit).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = bucketed.filter(F.col("members") > bucket_limit).select("fp").distinct()
    hubs = materialise(crowded.mapInArrow(_explode_hubs, "fp long, hub long"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = hubs.join(least, "hub").filter("fp <> a").select("a", F.col("fp").alias("b"))
    found = materialise(pairs.unionByName(stars).distinct())
    discard(bucketed, hubs)
    return found


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fp (64 bits as a signed long), text_hash, root, component_id for every row of `docs` (doc_id, text; other columns are left).

    component_id is the smallest doc_id reachable over links of at most 2 differing bits; root is that component's smallest fingerprint. Null and blank texts have fingerprint 0 and are
    linked like any others; null ids never name a component (component_id is null where it holds nothing else); repeated rows each give a row. Equal
    fingerprints are one node, so copies cost no links. An empty table gives an empty result.
    """
    signed = materialise(docs.select("doc_id", fingerprint_udf("text").alias("fp"), F.xxhash64("text").alias("text_hash")))
    prints = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    found = links(prints, bucket_limit)
    joined = components(found)
    rooted = materialise(prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "root", "component_id"))
    discard(found, prints, rooted)
    return signed.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")
