"""Language-model scoring by deleted interpolation.

A bigram model: maximum-likelihood estimates of word given the word before it, of the word alone and of any word are mixed by
weights that depend on how often the context was seen, in buckets of a doubling each. The weights are learned by expectation-maximisation on
deleted counts: each block of a training document is predicted from counts without its own, so that what a long text repeats counts as seen.

N-grams travel as sorted hash arrays, not as rows. Documents are encoded once into chunks (word table and word numbers). Each chunk asks
the shards of the hash space for the counts of its distinct n-grams, sending its own training counts along; a shard adds up and
answers in the order asked. So what is shuffled is one entry per distinct n-gram of a chunk, a frequent n-gram is one entry per chunk, and no
task holds the table of the corpus. Unigram hashes have 64 bits, bigram hashes 56.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.llm import ragged
from questlog.session import materialise

CHUNK_TOKENS = 1 << 20
SHARD_ENTRIES = 1 << 20
TEXT_ROWS = 512
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BLOCK_TOKENS = 256
BUCKETS = 40
BINS = 96  # half octaves of a likelihood ratio
CODEC = "zstd"
CHUNK_KIND = "chunk long, tokens long, train_tokens long, train_docs long, doc_ids array<long>, train array<boolean>, sizes binary, words binary, codes binary"


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return struct.pack("<QB", len(values), width) + pa.Codec(CODEC).compress(planes, asbytes=True)


def expand(raw: bytes) -> np.ndarray:
    count, width = struct.unpack_from("<QB", raw)
    planes = np.frombuffer(pa.Codec(CODEC).decompress(raw[9:], decompressed_size=count * width, asbytes=True), np.uint8)
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = planes.reshape(width, count).T
    return out.view("<u8").ravel()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, train) rows to chunks of about CHUNK_TOKENS tokens; documents stay whole."""
    held, tokens, number = [], 0, 0
    base = TaskContext.get().partitionId() << 32

    def chunk() -> pa.RecordBatch:
        ids, train, sizes = [x for h in held for x in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        code, distinct = pd.factorize(np.concatenate([h[3] for h in held]))
        order = np.argsort(-np.bincount(code), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = {"chunk": base + number, "tokens": int(sizes.sum()), "train_tokens": int(sizes[train].sum()), "train_docs": int(train.sum()), "doc_ids": ids,
               "train": train.tolist(), "sizes": squeeze(sizes), "words": squeeze(distinct[order]), "codes": squeeze(rank[code])}
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.bool_())] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    for whole in batches:
        for at in range(0, len(whole), TEXT_ROWS):
            batch = whole.slice(at, TEXT_ROWS)
            data, offsets = ragged.utf8(batch.column(1))
            ids, train = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in ragged.slices(offsets):
                word, first = ragged.words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                out = np.full(len(word) + b - a, END, np.uint64)
                out[np.arange(len(word)) + np.repeat(np.arange(b - a), np.diff(first))] = word
                held.append((ids[a:b], train[a:b], np.diff(first) + 1, out))
                tokens += len(out)
                if tokens >= CHUNK_TOKENS:
                    yield chunk()
                    held, tokens, number = [], 0, number + 1
    if held:
        yield chunk()


class Chunk:
    """One encoded chunk: per token its word, the word before it and its bigram, as numbers in sorted hash tables."""

    def __init__(self, row: dict):
        self.ids, self.train = row["doc_ids"], np.array(row["train"], bool)
        self.sizes = expand(row["sizes"]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        words = expand(row["words"])
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.word = words[order], rank[expand(row["codes"]).astype(np.int64)]
        hashes = self.words[self.word]
        before = np.concatenate([[START], hashes[:-1]])
        before[self.first[:-1]] = START
        pair = ragged.mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashes) >> np.uint64(8)
        code, distinct = pd.factorize(pair)
        order = np.argsort(distinct)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair = distinct[order], rank[code]
        self.context = np.concatenate([[-1], self.word[:-1]])  # -1: start of a document
        self.context[self.first[:-1]] = -1

    def blocks(self) -> np.ndarray:
        """The block of each token: documents are cut every BLOCK_TOKENS tokens."""
        place = np.arange(len(self.word)) - np.repeat(self.first[:-1], self.sizes)
        return np.cumsum(place % BLOCK_TOKENS == 0) - 1

    def own_counts(self, code: np.ndarray, block: np.ndarray) -> np.ndarray:
        """How often each token's n-gram occurs in its own block."""
        number, _ = pd.factorize(block * (int(code.max()) + 2) + code)
        return np.bincount(number)[number]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(len(batch)):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _ask(shards: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                c = Chunk(row)
                train = np.repeat(c.train, c.sizes)
                out = {"shard": [], "chunk": [], "n": [], "hashes": [], "counts": []}
                for n, table, code, bits in ((1, c.words, c.word, 64), (2, c.pairs, c.pair, 56)):
                    counts = np.bincount(code[train], minlength=len(table))
                    bounds = np.array([(s << bits) // shards for s in range(shards)], np.uint64)
                    cut = np.append(np.searchsorted(table, bounds), len(table))
                    for s in np.flatnonzero(np.diff(cut)).tolist():
                        own = table[cut[s]:cut[s + 1]]
                        out["shard"].append(s)
                        out["chunk"].append(row["chunk"])
                        out["n"].append(n)
                        out["hashes"].append(squeeze(np.diff(own, prepend=np.uint64(0))))
                        out["counts"].append(squeeze(counts[cut[s]:cut[s + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array(out["n"], pa.int32()),
                                                  pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    return ask


def _answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The training counts of a shard's n-grams, to each chunk in the order it asked; `known`: distinct n-grams seen in training, told once."""
    out = {"chunk": [], "n": [], "shard": [], "total": [], "known": []}
    for n in (1, 2):
        rows = [r for b in group.filter(pa.compute.equal(group.column("n"), n)).to_batches() for r in _rows(b)]
        if not rows:
            continue
        asked = [np.cumsum(expand(r["hashes"])) for r in rows]
        code, distinct = pd.factorize(np.concatenate(asked))
        total = np.bincount(code, weights=np.concatenate([expand(r["counts"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
        at = 0
        for k, (r, own) in enumerate(zip(rows, asked, strict=True)):
            out["chunk"].append(r["chunk"])
            out["n"].append(n)
            out["shard"].append(key[0].as_py())
            out["total"].append(squeeze(total[code[at:at + len(own)]]))
            out["known"].append(int((total > 0).sum()) if k == 0 else 0)
            at += len(own)
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "shard": pa.array(out["shard"], pa.int32()),
                     "total": pa.array(out["total"], pa.binary()), "known": pa.array(out["known"], pa.int64())})


def _totals(answers: pa.Table, n: int) -> np.ndarray:
    rows = answers.filter(pa.compute.equal(answers.column("n"), n)).sort_by("shard")
    parts = [expand(x) for x in rows.column("total").to_pylist()]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the number of doublings of its frequency."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def _bins(ratio: np.ndarray) -> np.ndarray:
    """0 for ratio 0, else a half octave."""
    return np.where(ratio > 0, np.clip(np.round(2 * np.log2(np.maximum(ratio, 1e-30))).astype(np.int64) + BINS // 2, 1, BINS - 1), 0)


def _estimates(pair, context, word, size) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates given the word before and alone."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / np.maximum(size, 1)


def _deleted(stats: dict) -> Callable:
    """Counts of (context bucket, likelihood ratios to the uniform estimate) over training tokens, each block's own counts taken out."""
    def statistics(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS * BINS * BINS, np.int64)
        for row in (r for b in left.to_batches() for r in _rows(b)):
            c = Chunk(row)
            ones, twos = _totals(right, 1), _totals(right, 2)
            block = c.blocks()
            own = c.own_counts(c.word, block)
            word, pair = ones[c.word] - own, twos[c.pair] - c.own_counts(c.pair, block)
            begins = np.concatenate([[True], block[1:] != block[:-1]])  # its context is another block's token
            context = np.where(c.context >= 0, ones[c.context] - np.where(begins, 0, np.concatenate([[0], own[:-1]])), stats["train_docs"] - 1)
            keep = np.repeat(c.train, c.sizes)
            size = stats["train_tokens"] - np.bincount(block)[block]
            p2, p1 = _estimates(pair[keep], context[keep], word[keep], size[keep])
            uniform = 1.0 / (stats["known"] + 1)
            key = (bucket(context[keep]) * BINS + _bins(p2 / uniform)) * BINS + _bins(p1 / uniform)
            total += np.bincount(key, minlength=len(total))
        at = np.flatnonzero(total)
        return pa.table({"key": pa.array(at, pa.int64()), "count": pa.array(total[at], pa.int64())})

    return statistics


def mixture_weights(keys: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Expectation-maximisation: for each context bucket the weights of the bigram, unigram and uniform estimates.

    Buckets without held-out tokens take the weights of the nearest learned bucket below, else above. An unseen context has no bigram estimate.
    The uniform weight stays positive.
    """
    group, rest = keys // (BINS * BINS), keys % (BINS * BINS)
    ratio = lambda b: np.where(b > 0, 2.0 ** ((b - BINS // 2) / 2), 0.0)
    parts = np.stack([ratio(rest // BINS), ratio(rest % BINS), np.ones(len(keys))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[group] * parts
        share *= (counts / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(group, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + [0, 0, 1e-3]
        new = sums / sums.sum(axis=1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved < tolerance:
            break
    learned = np.unique(group)
    if len(learned):
        weights = weights[learned[np.maximum(np.searchsorted(learned, np.arange(BUCKETS), "right") - 1, 0)]]
    weights[0, 0] = 0.0
    weights[0] /= weights[0].sum()
    return weights


def _score(stats: dict, weights: np.ndarray) -> Callable:
    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in (r for b in left.to_batches() for r in _rows(b)):
            c = Chunk(row)
            ones, twos = _totals(right, 1), _totals(right, 2)
            n, v = stats["train_tokens"], stats["known"]
            base = np.log10((ones + 0.5) / (n + 0.5 * (v + 1)))[c.word]
            context = np.where(c.context >= 0, ones[c.context], stats["train_docs"])
            p2, p1 = _estimates(twos[c.pair], context, ones[c.word], n)
            w = weights[bucket(context)]
            mixed = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
            total = lambda x: np.add.reduceat(x, c.first[:-1])
            parts.append(pa.table({"doc_id": pa.array(c.ids, pa.int64()), "held_out": pa.array(~c.train), "n_tokens": pa.array(c.sizes), "n_known": pa.array(total((ones[c.word] > 0).astype(np.int64))),
                                   "train_tokens": pa.array([n] * len(c.ids), pa.int64()), "base_score": pa.array(total(base)), "score": pa.array(total(mixed))}))
        return pa.concat_tables(parts) if parts else SCORED.empty_table()

    return scores


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_KIND = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text); `train` says which rows are learned from.

    Tokens are the words (no ASCII white space, A-Z lower-cased) and one end. ``base_score`` is the smoothed unigram log10 probability, ``score`` that of the
    mixture; both count all tokens. A null or blank text is its end alone. Where no row is for training, the mixture is the uniform
    estimate over one unknown word. A null `train` means held out. Repeated rows each count and each give a row; ids may be null; other columns
    are left. An empty table gives an empty result. A task's memory is bounded by a chunk, a shard or the longest document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    chunks = materialise(rows.mapInArrow(_encode, CHUNK_KIND))
    sums = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_docs"))).first()
    shards = max(8, -(-sums["tokens"] // SHARD_ENTRIES))
    asked = chunks.mapInArrow(_ask(shards), "shard int, chunk long, n int, hashes binary, counts binary")
    answers = materialise(asked.groupBy("shard").applyInArrow(_answer, "chunk long, n int, shard int, total binary, known long"))
    known = answers.filter("n = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    stats = {"train_tokens": sums["train_tokens"], "train_docs": sums["train_docs"], "known": known}
    paired = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    counted = paired.applyInArrow(_deleted(stats), "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).toArrow()
    weights = mixture_weights(counted.column("key").to_numpy(), counted.column("count").to_numpy())
    if not stats["train_tokens"]:
        weights[:] = [0.0, 0.0, 1.0]
    return paired.applyInArrow(_score(stats, weights), SCORED_KIND)
