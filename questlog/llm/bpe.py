"""Token counts and ids of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts of a batch become one byte array, pre-tokens are found by comparing neighbouring character classes, and equal pre-tokens are
treated once. The new ones are ragged arrays of symbols: in each round every sequence finds its pair of lowest rank and all of its
occurrences are merged at once, for all sequences together; a sequence without a pair is done. What survives are its tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from questlog.llm import ragged

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
NO_RANK = np.int64(1) << 40
CACHED_WORDS = 1 << 20


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def _char_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        a = b[lead]
        two = ((a & 0x1F) << 6) | (b[lead + 1] & 0x3F)
        three = ((a & 0x0F) << 12) | ((b[lead + 1] & 0x3F) << 6) | (b[lead + 2] & 0x3F)
        four = ((a & 0x07) << 18) | ((b[lead + 1] & 0x3F) << 12) | ((b[lead + 2] & 0x3F) << 6) | (b[lead + 3] & 0x3F)
        width = 2 + (a >= 0xE0) + (a >= 0xF0)
        found = table[np.where(width == 2, two, np.where(width == 3, three, four))]
        for k in range(4):
            own = width > k
            out[lead[own] + k] = found[own]
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(start of each pre-token, which of them are the special string). Rows' bounds are bounds of pre-tokens.

    The rule is that of byte-level BPE: contractions, then letters, numbers, or others with at most one blank before them, then white
    space, of which a run leaves its last character to what follows.
    """
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    kind = _char_classes(data)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    marks = []
    if special:
        raw, at = data.tobytes(), -1
        while (at := raw.find(special, at + 1)) >= 0:
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(special) - 1, "right"):
                marks.append(at)
                at += len(special) - 1
        for at in marks:
            edge[at] = edge[at + len(special)] = True
    lead = (data & 0xC0) != 0x80
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = data == 0x20
    start = change & ~space
    start[1:] &= edge[1:-1] | ~blank[:-1]
    start |= change & space
    follows = np.zeros(size, bool)
    follows[:-1] = space[:-1] & change[1:] & ~edge[1:-1]
    if follows.any():
        last = np.flatnonzero(follows)
        while not lead[last].all():
            last = np.where(lead[last], last, last - 1)
        start[last] = True
    quote = np.flatnonzero((data == 0x27) & change)
    if len(quote):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        inside = lambda k: ~np.concatenate([edge, np.ones(3, bool)])[quote + k]
        free = np.ones(len(quote), bool)
        before = quote > 0
        free[before] = edge[quote[before]] | ~blank[quote[before] - 1]
        one, two = pad[quote + 1], pad[quote + 2]
        short = free & inside(1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = free & inside(1) & inside(2) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        for which, width in ((short, 2), (long, 3)):
            at = quote[which]
            start[at + 1] = False
            after = at + width
            after = after[after < size]
            start[after[kind[after] == LETTER]] = True
    for at in marks:
        start[at:at + len(special)] = False
        start[at] = True
    starts = np.flatnonzero(start)
    return starts, np.isin(starts, marks) if marks else np.zeros(len(starts), bool)


class Vocabulary:
    """A byte-level BPE vocabulary file with its merges, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        added = spec.get("added_tokens") or [None]
        if len(added) > 1:
            raise ValueError("more than one added token is not supported")
        self.special, self.special_id = (added[0]["content"].encode(), added[0]["id"]) if added[0] else (b"", -1)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = iter(range(256, 512))
        names = {b: chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)}
        self.bytes = np.array([vocab[names[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.shift = np.uint64(64 - 18)
        self.keys, self.ranks = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NO_RANK, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & 0x3FFFF
            self.keys[slot], self.ranks[slot] = key, rank
        self._reset()

    def _reset(self):
        self.known: dict[int, int] = {}
        self.ends, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NO_RANK)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & 0x3FFFF
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each sequence) for byte sequences that follow one another."""
        symbol, owner = self.bytes[data], np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_owners = [], []
        while len(symbol):
            same = owner[1:] == owner[:-1]
            rank = np.full(len(symbol), NO_RANK, np.int64)
            rank[:-1][same] = self.rank((symbol[:-1][same] << 20) | symbol[1:][same])
            first = np.concatenate([[0], np.flatnonzero(~same) + 1])
            sizes = np.diff(np.concatenate([first, [len(symbol)]]))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            going = best < NO_RANK
            if not going.all():
                done_symbols.append(symbol[~going])
                done_owners.append(owner[~going])
                symbol, owner, rank, best = symbol[going], owner[going], rank[going], best[going]
            hit = rank == best
            if not len(hit):
                break
            run = np.flatnonzero(hit & np.concatenate([[False], hit[:-1]]))
            if len(run):  # the pair overlaps itself: take every other one from the left
                at = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
                hit &= (at - begin) % 2 == 0
            symbol[hit] = self.merged[rank[hit]]
            keep = np.concatenate([[True], ~hit[:-1]])
            symbol, owner = symbol[keep], owner[keep]
        owner = np.concatenate(done_owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_symbols)[order].astype(np.int32), np.bincount(owner, minlength=len(lengths))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number of each pre-token, first pre-token of each row and the end); a word's ids are ``pool[ends[w]:ends[w + 1]]``."""
        if len(self.known) > CACHED_WORDS:
            self._reset()
        starts, special = pre_tokens(data, offsets, self.special)
        lengths = np.diff(np.concatenate([starts, [len(data)]]))
        hashes = ragged.span_hashes(data, starts, lengths)
        hashes[special] = 0
        code, distinct = pd.factorize(hashes)
        sample = np.zeros(len(distinct), np.int64)
        sample[code] = np.arange(len(code))
        known = self.known
        number = np.array([known.get(h, -1) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = np.arange(len(fresh)) + len(self.ends) - 1
            self._learn(data, starts[sample[fresh]], lengths[sample[fresh]], special[sample[fresh]])
            known.update(zip(distinct[fresh].tolist(), number[fresh].tolist(), strict=True))
        return number[code], np.searchsorted(starts, offsets)

    def _learn(self, data, starts, lengths, special, block: int = 1 << 15):
        pools, counts = [self.pool], []
        for at in range(0, len(starts), block):
            s, n = starts[at:at + block], lengths[at:at + block]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids, count = self.merge(data[place + np.repeat(s, n)], n)
            mark = np.flatnonzero(special[at:at + block])
            if len(mark):
                drop = np.isin(np.repeat(np.arange(len(n)), count), mark)
                where = (np.cumsum(count) - count)[mark]
                ids[where] = self.special_id
                drop[where] = False
                ids, count[mark] = ids[~drop], 1
            pools.append(ids)
            counts.append(count)
        self.pool = np.concatenate(pools)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def row_counts(vocab: Vocabulary, texts: pa.Array) -> np.ndarray:
    """Tokens of each row."""
    data, offsets = ragged.utf8(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in ragged.slices(offsets):
        number, first = vocab.encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        total = np.concatenate([[0], np.cumsum(np.diff(vocab.ends)[number])])
        out[a:b] = np.diff(total[first])
    return out


def row_ids(vocab: Vocabulary, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each row, in order."""
    data, offsets = ragged.utf8(texts)
    for a, b in ragged.slices(offsets):
        number, first = vocab.encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        begin, sizes = vocab.ends[number], np.diff(vocab.ends)[number]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = vocab.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], sizes)]
        at = total[first]
        for k in range(b - a):
            yield ids[at[k]:at[k + 1]]


def count_tokens(text: Column, path: str) -> Column:
    """struct<n_bytes, n_tokens> of a text column; null counts as empty."""
    kind = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    @F.arrow_udf(kind)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for texts in batches:
            offsets = ragged.utf8(texts)[1]
            yield pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(row_counts(vocab, texts))], names=["n_bytes", "n_tokens"])

    return counts(text)


def token_table(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for every row of `docs` (doc_id, text; other columns are left).

    Counts are those of the tokenizers library for the vocabulary file at `path`, without added begin or end; the special string inside
    a text is one token, as by that library's default. A null text is empty: 0 bytes, 0 tokens. Ids may be null or repeated. An empty
    table gives an empty result. Texts are never cut; the longest text bounds the memory of a task.
    """
    counted = docs.select("doc_id", count_tokens(F.col("text"), path).alias("c"))
    return counted.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > F.lit(limit)).alias("over_limit"))
