"""Alignment of two tokenizers by external spill counting.

Texts are encoded by both tokenizers; byte offsets where tokens of both end cut them into groups, and inside a group every token of one side is linked
with every token of the other. Tasks hold such pairs with their documents in chunks. What a chunk knows of its pairs (in how many of its documents) is
radix-partitioned by the first side's id into compressed sorted runs; in each partition a k-way heap merge adds the runs up, in trees where they are
many. Pairs come out of it in the order of the first side's id, so an id's highest count is known when its pairs have passed, and the totals
stream back to the chunks in the order in which each asked. A frequent pair is one entry per chunk, and no task holds the pairs of the corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from questlog.llm import bpe, ragged
from questlog.llm.lm import expand, squeeze
from questlog.session import discard, materialise

SHARDS = 128
FAN = 1024  # runs of one merge
FRAME = 8192  # entries of a run that are unpacked at a time
CHUNK_RECORDS = 1 << 20
TEXT_ROWS = 512
LONG_WORD = 2048  # bytes; longer ones are left to the library
CACHED_WORDS = 400_000
WIDE_GROUP = 1024  # links of a group, beyond which equal ids are taken together
BLOCK = "▁".encode()


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Side:
    """Bytes and decimal spelling of every id of a tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        names = [str(k).encode() for k in range(len(tokens))]
        self.digits = np.array([len(n) for n in names], np.int64)
        self.names = np.zeros((len(names), int(self.digits.max()) + 1), np.uint8)  # a place more for what follows
        for k, n in enumerate(names):
            self.names[k, :len(n)] = np.frombuffer(n, np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        size = self.sizes[ids]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.pool[place + np.repeat(self.starts[ids], size)]


class ByteLevel(Side):
    """A byte-level BPE vocabulary file, special strings as plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        chars = byte_characters()
        tokens = [b""] * (1 + max(*vocab["model"]["vocab"].values(), *(t["id"] for t in vocab.get("added_tokens") or [{"id": 0}])))
        for name, k in vocab["model"]["vocab"].items():
            tokens[k] = bytes(chars[c] for c in name) if all(c in chars for c in name) else name.encode()
        super().__init__(tokens)
        self.path, self.vocab = path, bpe.Vocabulary(path)
        self.vocab.special = b""

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return self._library

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each row and the end)."""
        if len(self.vocab.known) > CACHED_WORDS:
            self.vocab._reset()
        number, first = self.vocab.encode(data, offsets)
        begin, size = self.vocab.ends[number], np.diff(self.vocab.ends)[number]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.vocab.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)].astype(np.int64), total[first]

    def encode_long(self, row: bytes) -> np.ndarray:
        return np.array(self.library.encode(row.decode(), add_special_tokens=False).ids, np.int64)


class Pieces(Side):
    """A sentence-piece model with byte fallback, which puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if sp.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)])
        self.blank = sp.piece_to_id("▁")
        # No piece goes on after a blank, and texts are not normalised: then words can be encoded one by one.
        self.by_word = not any("▁" in n.lstrip("▁") for n in names) and self.blank != sp.unk_id() and all(
            self.spelled(np.array(sp.encode(t), np.int64)).tobytes() == b" " + t.encode() for t in ("  a  b ", "ﬁ 　éⅧ ½", "\t\n x\x00"))
        self._reset()

    def _reset(self):
        self.known: dict[int, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each row and the end); each row begins with a blank that the model adds itself."""
        raw = data.tobytes()
        if not self.by_word:
            found = self.model.encode([raw[a + 1:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], num_threads=1)
            return np.array([k for f in found for k in f], np.int64), np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        if len(self.known) > CACHED_WORDS:
            self._reset()
        begins = data == 0x20
        begins[1:] &= data[:-1] != 0x20
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(np.concatenate([starts, [len(data)]]))
        code, distinct = pd.factorize(ragged.span_hashes(data, starts, lengths))
        sample = np.zeros(len(distinct), np.int64)
        sample[code] = np.arange(len(code))
        number = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            at = sample[fresh]
            words = [raw[a + 1:b].decode() for a, b in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)]
            found = [f if w else [self.blank] for f, w in zip(self.model.encode(words, num_threads=1), words, strict=True)]
            number[fresh] = np.arange(len(fresh)) + len(self.ends) - 1
            self.ids = np.concatenate([self.ids, np.array([k for f in found for k in f], np.int64)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in found])])
            self.known.update(zip(distinct[fresh].tolist(), number[fresh].tolist(), strict=True))
        number = number[code]
        size = np.diff(self.ends)[number]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(total[-1]) + np.repeat(self.ends[number] - total[:-1], size)], total[np.searchsorted(starts, offsets)]


@cache
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


# ---- tokens, groups and links of a slice of texts

def _long_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a run of LONG_WORD bytes without a blank, or of white space and controls."""
    out = np.zeros(len(offsets) - 1, bool)
    for rest in (data == 0x20, data > 0x20):
        at = np.flatnonzero(rest)
        gaps = np.diff(np.concatenate([[-1], at, [len(data)]]))
        for k in np.flatnonzero(gaps > LONG_WORD).tolist():
            begin, end = (at[k - 1] if k else 0), (at[k] if k < len(at) else len(data))
            out[np.searchsorted(offsets, begin, "right") - 1:np.searchsorted(offsets, end - 1, "right")] = True
    return out


def _cut(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of some rows, one after another."""
    size = np.diff(offsets)[rows]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return data[place + np.repeat(offsets[:-1][rows], size)], np.concatenate([[0], np.cumsum(size)])


def _tokens(a: ByteLevel, b: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows whose tokens spell them on both sides, and of each side these rows' (ids, first id of each row and the end). Rows begin with a blank."""
    rows = np.flatnonzero(np.diff(offsets) > 1)
    if len(rows):
        raw = data.tobytes()
        if BLOCK in raw:  # pieces would spell it as a blank
            rows = rows[[raw.find(BLOCK, offsets[r], offsets[r + 1]) < 0 for r in rows.tolist()]]
    if not len(rows):
        return rows, []
    data, offsets = _cut(data, offsets, rows)
    long = _long_rows(data, offsets)
    ids_a, first_a = (a.encode(*_cut(data, offsets, np.flatnonzero(~long)))) if not long.all() else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    if long.any():
        parts, size = np.split(ids_a, first_a[1:-1]) if len(first_a) > 1 else [], np.zeros(len(rows), np.int64)
        every, short = [], iter(parts)
        for k in range(len(rows)):
            every.append(a.encode_long(data[offsets[k]:offsets[k + 1]].tobytes()) if long[k] else next(short))
            size[k] = len(every[-1])
        ids_a, first_a = np.concatenate(every), np.concatenate([[0], np.cumsum(size)])
    ids_b, first_b = b.encode(data, offsets)
    good = np.ones(len(rows), bool)
    sides_of = [(a, ids_a, first_a), (b, ids_b, first_b)]
    for side, ids, first in sides_of:
        total = np.concatenate([[0], np.cumsum(side.sizes[ids])])
        good &= np.diff(total[first]) == np.diff(offsets)
    for side, ids, first in sides_of:
        kept = np.flatnonzero(good)
        own, _ = _cut(ids, first, kept)
        text, bounds = _cut(data, offsets, kept)
        wrong = np.flatnonzero(side.spelled(own) != text)
        good[kept[np.unique(np.searchsorted(bounds, wrong, "right") - 1)]] = False
    kept = np.flatnonzero(good)
    return rows[kept], [_cut(ids, first, kept) for _, ids, first in sides_of]


def _written(a: Side, b: Side, ids_a, ids_b, group_a, group_b, count_a, count_b, last_of_row: np.ndarray, bytes_of_row: np.ndarray) -> list[str]:
    """SHA-256 of each row's groups as text: ids of one side, a bar, ids of the other, a semicolon between groups."""
    before_a, before_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + (before_a + count_a)[group_b]
    size = len(ids_a) + len(ids_b)
    width = max(a.names.shape[1], b.names.shape[1])
    letters, used = np.zeros((size, width), np.uint8), np.zeros(size, np.int64)
    for side, ids, at, group, end, mark in ((a, ids_a, at_a, group_a, before_a + count_a, ord("|")), (b, ids_b, at_b, group_b, before_b + count_b, ord(";"))):
        letters[at, :side.names.shape[1]] = side.names[ids]
        digits = side.digits[ids]
        ends = np.arange(len(ids)) + 1 == end[group]
        letters[at, digits] = np.where(ends, mark, ord(","))
        used[at] = digits + 1
    row_last = (before_a + count_a + before_b + count_b)[last_of_row] - 1  # the last token of each row has nothing behind it
    used[row_last] -= 1
    flat = letters[np.arange(width) < used[:, None]].tobytes()
    cuts = np.concatenate([[0], np.cumsum(used)[row_last]]).tolist()
    return [hashlib.sha256(flat[p:q]).hexdigest() for p, q in zip(cuts[:-1], cuts[1:], strict=True)]


def aligned(a: ByteLevel, b: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, list], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of each row (rows begin with a blank), and its linked pairs: (row, pair, times), sorted and distinct."""
    rows, both = _tokens(a, b, data, offsets)
    count = len(offsets) - 1
    out = {c: np.zeros(count, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"sha": np.full(count, "", object)}
    if not len(rows):
        return out, (np.zeros(0, np.int64),) * 3
    (ids_a, first_a), (ids_b, first_b) = both
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    mark = np.zeros(int(ends_a[-1]) + 1, bool)
    mark[ends_a] = True
    cuts = np.unique(ends_b[mark[ends_b]])
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    count_a, count_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    last = np.searchsorted(cuts, ends_a[first_a[1:] - 1])
    row_of = np.searchsorted(last, np.arange(len(cuts)))
    out["n_a"][rows], out["n_b"][rows], out["n_groups"][rows] = np.diff(first_a), np.diff(first_b), np.diff(last, prepend=-1)
    links = count_a * count_b
    out["n_links"][rows] = np.add.reduceat(links, np.concatenate([[0], last[:-1] + 1]))
    out["sha"][rows] = _written(a, b, ids_a, ids_b, group_a, group_b, count_a, count_b, last, rows)
    return out, _pairs(len(b.sizes), ids_a, ids_b, group_a, count_a, count_b, links, rows[row_of])


def _pairs(size_b: int, ids_a, ids_b, group_a, count_a, count_b, links, row_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    wide = links > WIDE_GROUP
    left = np.flatnonzero(~wide[group_a])
    times_b = count_b[group_a[left]]
    begin = first_b[group_a[left]]
    other = np.arange(times_b.sum()) - np.repeat(np.cumsum(times_b) - times_b - begin, times_b)
    keys = [np.repeat(ids_a[left], times_b) * size_b + ids_b[other]]
    rows, times = [np.repeat(row_of[group_a[left]], times_b)], [np.ones(len(other), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        x, nx = np.unique(ids_a[first_a[g]:first_a[g] + count_a[g]], return_counts=True)
        y, ny = np.unique(ids_b[first_b[g]:first_b[g] + count_b[g]], return_counts=True)
        keys.append((x[:, None] * size_b + y).ravel())
        times.append(np.outer(nx, ny).ravel())
        rows.append(np.full(len(keys[-1]), row_of[g]))
    key, row, time = np.concatenate(keys), np.concatenate(rows), np.concatenate(times)
    order = np.lexsort((key, row))
    key, row, time = key[order], row[order], time[order]
    fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    return row[fresh], key[fresh], np.add.reduceat(time, fresh) if len(fresh) else time


# ---- chunks, runs and their merge

CHUNK = ["chunk", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "records", "keys", "counts", "codes", "times"]


def _chunk_kind(id_kind) -> StructType:
    kinds = [LongType(), ArrayType(id_kind), *[ArrayType(LongType())] * 4, ArrayType(StringType()), ArrayType(LongType()), *[BinaryType()] * 4]
    return StructType([StructField(c, k) for c, k in zip(CHUNK, kinds, strict=True)])


def _encode(path_a: str, path_b: str) -> Callable:
    """(doc_id, text) rows to chunks of about CHUNK_RECORDS pairs; documents stay whole."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        held, records, number = [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            ids, docs = pa.concat_arrays([h[0] for h in held]), {c: np.concatenate([h[1][c] for h in held]) for c in held[0][1]}
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            row = np.concatenate([h[2][0] + s for h, s in zip(held, shift, strict=False)])
            key, times = (np.concatenate([h[2][k] for h in held]) for k in (1, 2))
            keys, code, counts = np.unique(key, return_inverse=True, return_counts=True)  # documents that hold each pair
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            code = rank[code]
            order = np.lexsort((code, row))
            row, code, times = row[order], code[order], times[order]
            step = np.diff(code, prepend=0)
            fresh = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            step[fresh] = code[fresh]
            whole = [pa.array([base + number], pa.int64())]
            lists = [ids, *(pa.array(docs[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(docs["sha"], pa.string()), pa.array(np.bincount(row, minlength=len(ids)), pa.int64())]
            whole += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            whole += [pa.array([squeeze(x)], pa.binary()) for x in (np.diff(keys, prepend=0), counts, step, times)]
            return pa.RecordBatch.from_arrays(whole, names=CHUNK)

        for whole in batches:
            for at in range(0, len(whole), TEXT_ROWS):
                batch = whole.slice(at, TEXT_ROWS)
                data, offsets = ragged.utf8(batch.column(1))
                for p, q in ragged.slices(offsets):
                    own = offsets[p:q + 1] - offsets[p]
                    found = aligned(a, b, np.insert(data[offsets[p]:offsets[q]], own[:-1], 0x20), own + np.arange(len(own)))
                    held.append((batch.column(0).slice(p, q - p), *found))
                    records += len(found[1][0])
                    if records >= CHUNK_RECORDS:
                        yield chunk()
                        held, records, number = [], 0, number + 1
        if held:
            yield chunk()

    return encode


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        for k in range(len(batch)):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _packed(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A sorted run as frames that can be unpacked one by one."""
    return [x for at in range(0, len(keys), FRAME) for x in (squeeze(np.diff(keys[at:at + FRAME], prepend=0)), squeeze(counts[at:at + FRAME]))]


def _entries(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    for k in range(0, len(frames), 2):
        yield from zip(np.cumsum(expand(frames[k])).tolist(), expand(frames[k + 1]).tolist(), strict=True)


def _whole(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.cumsum(expand(frames[k])), expand(frames[k + 1])) for k in range(0, len(frames), 2)]
    return tuple(np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in (0, 1))


def _shard_order(keys: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by shard, first of each shard and the end); a shard keeps the order of the first side's ids."""
    shard = keys // size_b % SHARDS
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=SHARDS))])


def _spill(size_b: int) -> Callable:
    """Chunks to runs (shard, node, frames)."""
    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, counts = np.cumsum(expand(row["keys"])).astype(np.int64), expand(row["counts"])
                order, first = _shard_order(keys, size_b)
                keys, counts = keys[order], counts[order]
                full = np.flatnonzero(np.diff(first)).tolist()
                frames = [_packed(keys[first[s]:first[s + 1]], counts[first[s]:first[s + 1]]) for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array(frames, pa.list_(pa.binary()))], names=["shard", "node", "frames"])

    return spill


def merge_runs(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(pair, count) in the order of pairs, by a heap over the heads of all runs."""
    last, total = -1, 0
    for key, count in heapq.merge(*map(_entries, runs)):
        if key == last:
            total += count
        else:
            if last >= 0:
                yield last, total
            last, total = key, count
    if last >= 0:
        yield last, total


def with_maxima(merged: Iterator[tuple[int, int]], size_b: int) -> Iterator[tuple[int, int]]:
    """(pair, 2 * count, plus 1 if the count is the highest of its first id): an id's pairs follow one another."""
    held: list[tuple[int, int]] = []
    for key, count in merged:
        if held and key // size_b != held[0][0] // size_b:
            top = max(c for _, c in held)
            yield from ((k, 2 * c + (c == top)) for k, c in held)
            held.clear()
        held.append((key, count))
    top = max((c for _, c in held), default=0)
    yield from ((k, 2 * c + (c == top)) for k, c in held)


def _merge(size_b: int, final: bool) -> Callable:
    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        merged = merge_runs([r["frames"] for r in _rows(group.select(["frames"]))])
        pairs = np.fromiter((x for p in (with_maxima(merged, size_b) if final else merged) for x in p), np.int64).reshape(-1, 2)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "frames": pa.array([_packed(pairs[:, 0], pairs[:, 1])], pa.list_(pa.binary()))})

    return merge


RUN_KIND = "shard int, node long, frames array<binary>"


def _answer(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """The totals of a shard, to each run of a block in its order."""
    keys, values = _whole(next(_rows(totals))["frames"]) if len(totals) else (np.zeros(0, np.int64),) * 2
    out = {"chunk": [], "shard": [], "totals": []}
    for r in _rows(runs):
        own, _ = _whole(r["frames"])
        out["chunk"].append(r["node"])
        out["shard"].append(r["shard"])
        out["totals"].append(squeeze(values[np.searchsorted(keys, own)]))
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "totals": pa.array(out["totals"], pa.binary())})


def _back(size_b: int, kind: pa.Schema) -> Callable:
    """Each document's sums, from its chunk and what the shards answered."""
    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in _rows(left):
            keys = np.cumsum(expand(row["keys"])).astype(np.int64)
            counts = expand(row["counts"]).astype(np.int64)
            order, _ = _shard_order(keys, size_b)
            total = np.zeros(len(keys), np.int64)
            answers = [expand(x) for x in right.sort_by("shard").column("totals").to_pylist()]
            if answers:
                total[order] = np.concatenate(answers).astype(np.int64)
            total = total[np.argsort(-counts, kind="stable")]
            size = np.array(row["records"], np.int64)
            step, times = expand(row["codes"]).astype(np.int64), expand(row["times"]).astype(np.int64)
            full = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[full]
            run = np.cumsum(step)
            code = run - np.repeat(run[first] - step[first], size[full])  # steps begin anew in each document
            sums = {c: np.zeros(len(size), np.int64) for c in ("n_best", "count_sum")}
            if len(first):
                sums["n_best"][full] = np.add.reduceat(times * (total[code] & 1), first)
                sums["count_sum"][full] = np.add.reduceat(times * (total[code] >> 1), first)
            columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], sums["n_best"], sums["count_sum"], row["sha"]]
            parts.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind))
        return pa.concat_tables(parts) if parts else kind.empty_table()

    return back


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs` (doc_id, text; other columns are left).

    A: byte-level BPE file at `path_a` on a blank and the text; B: sentence-piece model at `path_b`, which adds that blank. Special strings are plain text. A null
    or empty text, and one that the tokens of a side do not spell (as with U+2581, which pieces take for a blank), has no tokens: zeros and ''. A pair's count is
    the number of rows that hold it linked; repeated rows each count, ids may be null. Texts are never cut. An empty table gives an empty result.

    A task's memory is bounded by a chunk, the longest document, or the pairs of a shard, which the vocabularies bound; runs of more than FAN chunks are merged in a
    tree. Only a group of many different tokens on both sides has more pairs than tokens; in it equal ids are taken together.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), StructField("groups_sha256", StringType())])
    size_b = len(sides(path_a, path_b)[1].sizes)
    chunks = materialise(docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b), _chunk_kind(docs.schema["doc_id"].dataType)))
    runs = materialise(chunks.select("chunk", "keys", "counts").mapInArrow(_spill(size_b), RUN_KIND))
    blocks = max(1, -(-chunks.count() // FAN))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    nodes, tree = blocks, runs
    while True:
        tree = tree.withColumn("node", F.pmod(F.xxhash64("node"), F.lit(nodes))).groupBy("shard", "node").applyInArrow(_merge(size_b, nodes == 1), RUN_KIND)
        if nodes == 1:
            break
        nodes = max(1, -(-nodes // FAN))
    totals = materialise(tree)
    sent = totals.select("shard", "frames", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))  # a block of runs meets its shard's totals
    answers = materialise(runs.select("*", block).groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_answer, "chunk long, shard int, totals binary"))
    discard(runs, totals)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_back(size_b, to_arrow_schema(kind)), kind)
