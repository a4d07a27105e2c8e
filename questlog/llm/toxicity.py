"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, over one vocabulary. Each model discounts its counts and backs off to the continuation counts of its
words (in how many contexts a word was seen), and from there to the continuation counts of both classes together. Expressions that are rare,
or of which the labels tell nothing beyond chance, are one symbol that both models judge by those shared counts. A text's evidence is the
mean over its words of the log-likelihood ratio, made a probability by a logistic curve that is fitted on labelled texts the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlog.llm import ragged
from questlog.llm.langid import fold
from questlog.session import discard, materialise

START, ANY = np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)
TEXT_ROWS = 512
TUNING_PARTS = 4
LEAST_TUNING = 10
LEAST_TEXTS = 5
SIGMAS = 5.0
BALANCE = 3


@dataclass
class Model:
    """words: sorted hashes, numbered by place; then come the rare word and the start of a text. Estimates have a column per class (ordinary, toxic):
    of words, of pairs (sorted keys ``before * (len(words) + 2) + word``), and back-off weights of contexts.
    A text's probability is logistic in slope * evidence + intercept."""

    words: np.ndarray
    word_estimates: np.ndarray
    backoffs: np.ndarray
    pairs: np.ndarray
    pair_estimates: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def ratios(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log p(word | before, toxic) - log p(word | before, ordinary) for hashes."""
        before, word = numbered(self.words, before), numbered(self.words, word)
        key = before * (len(self.words) + 2) + word
        p = self.backoffs[before] * self.word_estimates[word]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            p += np.where((self.pairs[at] == key)[:, None], self.pair_estimates[at], 0.0)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Mean ratio over the words of each text; 0 without a word."""
        data, offsets = ragged.utf8(texts)
        out = np.zeros(len(offsets) - 1)
        for a, b in ragged.slices(offsets):
            before, word, first = bigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            size = np.diff(first)
            full = np.flatnonzero(size)
            if len(full):  # summed text by text, so that equal texts get equal sums
                out[a + full] = np.add.reduceat(self.ratios(before, word), first[:-1][full]) / size[full]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return logistic(self.slope * self.evidence(texts) + self.intercept)


@dataclass
class Constant:
    """The model where labels do not tell two classes: one score for every text."""

    score: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), self.score)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ragged.mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word before, hash of the word, first word of each row and the end); a row's first word follows START."""
    word, first = ragged.words(data, offsets, ragged.PUNCTUATION)
    before = np.concatenate([[START], word[:-1]]) if len(word) else word
    begins = first[:-1]
    before[begins[begins < len(word)]] = START
    return before, word, first


def numbered(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among `words`; ``len(words)`` for a rare word, one more for START."""
    if not len(words):
        return np.where(hashes == START, 1, 0)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, np.where(hashes == START, len(words) + 1, len(words)))


def count_pairs(texts: pa.Array, toxic: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Distinct pairs of hashes with their counts in ordinary and toxic texts; after ANY, words with the ordinary and toxic texts that hold
    them. Added up per slice."""
    data, offsets = ragged.utf8(texts)
    for a, b in ragged.slices(offsets):
        before, word, first = bigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        text = np.repeat(np.arange(b - a), np.diff(first))
        _, once = np.unique(ragged.mixed(word) + text.astype(np.uint64), return_index=True)  # each word of a text
        before, word, own = np.concatenate([before, np.full(len(once), ANY)]), np.concatenate([word, word[once]]), toxic[a:b][np.concatenate([text, text[once]])]
        key, where, code = np.unique(pair_hash(before, word), return_index=True, return_inverse=True)
        yield {"before": before[where].view(np.int64), "word": word[where].view(np.int64), "ordinary": np.bincount(code[~own], minlength=len(key)), "toxic": np.bincount(code[own], minlength=len(key))}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) rows to what `count_pairs` finds."""
    for whole in batches:
        for at in range(0, len(whole), TEXT_ROWS):
            batch = whole.slice(at, TEXT_ROWS)
            for found in count_pairs(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], names=list(found))


def discount(counts: np.ndarray) -> float:
    """Absolute discount from how many counts are one and two."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def telling(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which words are in more, or fewer, toxic than ordinary texts beyond chance; `texts` and `sizes` (texts in all) have a column per class."""
    total, share = texts.sum(axis=1), sizes[1] / sizes.sum()
    return (total >= LEAST_TEXTS) & (np.abs(texts[:, 1] - share * total) >= SIGMAS * np.sqrt(share * (1 - share) * total))


def fit_counts(before: np.ndarray, word: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Model:
    """Kneser-Ney estimates from what `count_pairs` found; `counts`, and `sizes` (texts), have a column per class. Each class has a pair.

    A word that is rare, or as frequent in both classes as far as can be told, is no symbol of its own: it is judged by the shared counts alone.
    """
    alone = before == ANY
    words = np.sort(word[alone][telling(counts[alone], sizes)])
    before, word, counts = (x[~alone] for x in (before, word, counts))
    size = len(words) + 2
    pairs, code = np.unique(numbered(words, before) * size + numbered(words, word), return_inverse=True)
    counts = np.stack([np.bincount(code, weights=counts[:, k], minlength=len(pairs)) for k in range(2)], 1)
    context_of, word_of = pairs // size, pairs % size
    shared = np.bincount(word_of, minlength=size - 1)  # contexts in either class
    d = discount(shared)
    base = np.maximum(shared - d, 0) / shared.sum() + d * (shared > 0).sum() / shared.sum() / len(shared)
    lower, back, own = [], [], []
    for k in range(2):
        n = counts[:, k]
        continued = np.bincount(word_of[n > 0], minlength=size - 1)
        d = discount(continued)
        lower.append(np.maximum(continued - d, 0) / continued.sum() + d * (continued > 0).sum() / continued.sum() * base)
        total = np.bincount(context_of, weights=n, minlength=size)
        kept = np.maximum(n - discount(n), 0)
        back.append(np.where(total > 0, 1 - np.bincount(context_of, weights=kept, minlength=size) / np.maximum(total, 1), 1.0))
        own.append(kept / np.maximum(total, 1)[context_of])
    return Model(words, np.stack(lower, 1), np.stack(back, 1), pairs, np.stack(own, 1))


def tune(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the weighted logistic regression of the label on the evidence, by Newton's method with a small ridge; the
    evidence is scaled first. A slope against the evidence counts as none."""
    scale = max(float(evidence.std()), 1e-12)
    x = np.stack([evidence / scale, np.ones(len(evidence))], 1)
    weight = weight / weight.mean()
    share = np.clip((weight * toxic).mean(), 1e-6, 1 - 1e-6)
    flat = np.array([0.0, np.log(share / (1 - share))])
    w = flat.copy()
    for _ in range(rounds):
        p = logistic(x @ w)
        gradient = x.T @ (weight * (p - toxic)) + 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    w = w if w[0] > 0 and np.isfinite(w).all() else flat
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4_000) -> Model | Constant:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    Fitted on a bounded sample: of each class about `rows_per_class` labelled ids at most, and about BALANCE times as many as of the other, chosen by a hash
    of the id, with their whole texts. An id is toxic if one of its labels says so; null labels and null ids are left out. Three of four sampled ids, again by hash, give the counts, the fourth sets the
    logistic curve, weighted back to the classes' true shares. Where one class is absent every text scores the smoothed share of toxic labels; without labels 0.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic_"))
    known = docs.select("doc_id").distinct().join(known, "doc_id")
    sizes = {r["toxic_"]: r["n"] for r in known.groupBy("toxic_").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Constant((sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1) if sizes else 0.0)
    least = min(rows_per_class, *sizes.values())
    shares = {k: min(1.0, rows_per_class / n, BALANCE * least / n) for k, n in sizes.items()}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") * F.lit(2.0**-53)
    ids = known.filter(draw < F.when(F.col("toxic_") == 1, shares[1]).otherwise(shares[0]))  # about 2 * rows_per_class ids
    tuning = (F.pmod(F.xxhash64("doc_id", F.lit("tuning")), F.lit(TUNING_PARTS)) == 0).alias("tuning")
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic_", "text", tuning))
    parts = {(r["toxic_"], r["tuning"]): r["n"] for r in sample.groupBy("toxic_", "tuning").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = all(parts.get((k, t), 0) >= LEAST_TUNING for k in (0, 1) for t in (False, True))
    learned = sample.filter(~F.col("tuning")) if apart else sample
    counted = learned.select("toxic_", "text").mapInArrow(_count, "before long, word long, ordinary long, toxic long").groupBy("before", "word").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.stack([counted.column(c).to_numpy() for c in ("ordinary", "toxic")], 1) if len(counted) else np.zeros((0, 2))
    texts = np.array([sum(n for (toxic, tuned), n in parts.items() if toxic == k and not (apart and tuned)) for k in (0, 1)])
    if not (counts.sum(axis=0) > 0).all():  # a class without a word
        discard(sample)
        return Constant((sizes[1] + 0.5) / (sum(sizes.values()) + 1))
    model = fit_counts(*(counted.column(c).to_numpy().view(np.uint64) for c in ("before", "word")), counts, texts)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.evidence(batch.column(1)))], names=["toxic_", "evidence"])

    tuned = (sample.filter("tuning") if apart else sample).select("toxic_", "text").mapInArrow(measure, "toxic_ int, evidence double").toArrow()  # a number per sampled row
    discard(sample)
    toxic = tuned.column("toxic_").to_numpy()
    model.slope, model.intercept = tune(tuned.column("evidence").to_numpy(), toxic, 1 / np.where(toxic == 1, shares[1], shares[0]))
    return model


def scored(text: Column, model: Model | Constant, spark) -> Column:
    """Probability that a text is toxic. The model, bounded by `fit`, is broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(sent.value.scores(texts))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text) by what `labels` (doc_id, toxic) say; other columns are left.

    Learns from the labelled rows of all folds but `held_out`; a score reads nothing but the text. A null text, and one without an ASCII letter, a digit or
    a character beyond ASCII, has no evidence and scores by the intercept alone. Equal texts score alike. Repeated rows and null ids
    each give a row; a null id is in fold 0 and has no label. Without labels every score is 0. Texts are read whole. An empty table gives an empty result.
    """
    out = fold(F.col("doc_id"), folds) == held_out
    model = fit(docs.filter(~out), labels)
    rows = docs.select("doc_id", out.alias("held_out"), scored(F.col("text"), model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
