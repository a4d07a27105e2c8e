"""Language identification by words first, backing off to character n-grams.

A known word scores by its log frequency in each language. An unseen word falls back to its character 4-grams, if none of them is
known to its 3-grams, and so on to single letters. A text's languages are compared by the mean score of its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from questlog.session import discard, materialise

UNDETERMINED = "und"
LONGEST = 4
WORDS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 600_000
CACHED_CELLS = 16_000_000
#: Evidence counts as that of so many words at most, so that a score of 1 needs a clear lead and not only length.
FULL_EVIDENCE = 20


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a blank at both ends; single letters are taken without the blanks."""
    padded = word if n == 1 else f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """languages; tables[0]: words, tables[n]: n-grams, each to its row. A row's log frequencies are `base` of its kind, for languages that lack it,
    plus `gains` of the `langs` between two of `starts`. Rows are numbered kind by kind, as they stand in the tables."""

    languages: list[str]
    tables: list[dict[str, int]]
    base: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray

    def __post_init__(self):
        self._forget()

    def __getstate__(self):
        """Items hold letters and blanks only, so each table is sent as one text."""
        return self.languages, ["\n".join(t) for t in self.tables], self.base, self.starts, self.langs, self.gains

    def __setstate__(self, state):
        self.languages, texts, self.base, self.starts, self.langs, self.gains = state
        self.tables, at = [], 0
        for text in texts:
            items = text.split("\n") if text else []
            self.tables.append(dict(zip(items, range(at, at + len(items)), strict=True)))
            at += len(items)
        self._forget()

    def _forget(self):
        """Words met so far are scored once: `index` gives their rows of `rows`."""
        self.index, self.rows, self.used = {}, np.zeros((0, len(self.languages))), 0

    def backoff(self, word: str) -> tuple[int, list[int]]:
        """(kind, rows): the word itself if it is known, or the longest n-grams of which any is known."""
        row = self.tables[0].get(word)
        if row is not None:
            return 0, [row]
        padded = f" {word} "
        for n in range(LONGEST, 1, -1):
            known = self.tables[n].get
            rows = [r for i in range(len(padded) - n + 1) if (r := known(padded[i:i + n])) is not None]
            if rows:
                return n, rows
        known = self.tables[1].get
        return 1, [r for c in word if (r := known(c)) is not None]

    def _learn(self, words: list[str]):
        width = len(self.languages)
        if self.used + len(words) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), self.used + len(words)), width))
            grown[:self.used] = self.rows[:self.used]
            self.rows = grown
        found = [self.backoff(w) for w in words]
        sizes = np.array([len(r) for _, r in found])
        flat = np.array([x for _, r in found for x in r], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        first, many = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
        entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        owner = np.repeat(owner, many)
        own = np.bincount(owner * width + self.langs[entry], weights=self.gains[entry] / sizes[owner], minlength=len(words) * width).reshape(-1, width)
        own = own + np.where(sizes[:, None] > 0, self.base[[k for k, _ in found]], 0.0)
        self.rows[self.used:self.used + len(words)] = own
        self.index.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the evidence for it); (und, 0) for a text without letters or a model without languages."""
        words = words_of(text)
        if not self.languages or not any(c.isalpha() for w in words for c in w):  # numerals such as superscripts are no letters
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), 1 << 16):
            part = words[at:at + (1 << 16)]
            try:
                rows = [self.index[w] for w in part]
            except KeyError:
                if len(self.index) > min(CACHED_WORDS, CACHED_CELLS // len(self.languages)):
                    self._forget()
                self._learn(list({w for w in part if w not in self.index}))
                rows = [self.index[w] for w in part]
            total += np.add.reduce(self.rows[rows])
        lead = total / len(words) * min(len(words), FULL_EVIDENCE)
        share = np.exp(lead - lead.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, item, count): words (n = 0) and n-grams of the texts, added up per batch."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counts in words.items():
            tables = [counts, *(Counter() for _ in range(LONGEST))]
            for w, c in counts.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        tables[n][g] += c
            for n, t in enumerate(tables):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t)), pa.array([n] * len(t), pa.int32()), pa.array(list(t)), pa.array(list(t.values()), pa.int64())],
                                                 names=["lang", "n", "item", "count"])


def fit(labelled: DataFrame, rows_per_language: int = 3_000, max_languages: int = 256, max_entries: int = 2_000_000, min_count: int = 2) -> Model:
    """A model from `labelled` (doc_id, text, lang); rows without language are left out.

    Fitted on a bounded sample, chosen by a hash of doc_id and language: about `rows_per_language` whole documents of each of the
    `max_languages` most frequent languages. The model keeps words and n-grams seen `min_count` times in a language: of each language and each kind (words, 1- to 4-grams)
    the most frequent ones up to an equal part of `max_entries`, so that neither frequent languages nor short n-grams displace others, and of what is kept
    the counts of all languages. Its size does not depend on the table. No rows: a model without languages.
    """
    labelled = labelled.filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [{} for _ in range(LONGEST + 1)], np.zeros((LONGEST + 1, 0)), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))))
    draw = F.shiftrightunsigned(F.xxhash64("lang", "doc_id"), 11).cast("double") * F.lit(2.0**-53)
    sample = labelled.filter(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")
    counted = materialise(sample.mapInArrow(_count, "lang string, n int, item string, count long").groupBy("n", "item", "lang").agg(F.sum("count").alias("count")).filter(F.col("count") >= min_count))
    table = _kept(counted, max(1, max_entries // ((LONGEST + 1) * len(languages)))).toArrow()
    discard(counted)
    return _model(languages, *(table.column(c) for c in ("n", "item", "lang", "count")))


def _kept(counted: DataFrame, most: int) -> DataFrame:
    """Rows of the items that are among the about `most` most frequent of their kind in any language; counts are compared by eighths of
    octaves, inside the last of which a hash decides."""
    level = F.floor(8 * F.log2("count")).cast("int")
    crowded = counted.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most).select("lang", "n")
    levels = counted.join(F.broadcast(crowded), ["lang", "n"], "left_semi").groupBy("lang", "n", level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    if not levels:
        return counted
    cuts: dict[tuple[str, int], tuple[int, float]] = {}
    above: Counter = Counter()
    for r in sorted(levels, key=lambda r: -r["level"]):
        key = r["lang"], r["n"]
        if key not in cuts and above[key] + r["rows"] > most:
            cuts[key] = r["level"], (most - above[key]) / r["rows"]
        above[key] += r["rows"]
    limits = F.broadcast(counted.sparkSession.createDataFrame([(*k, *v) for k, v in cuts.items()], "lang string, n int, cut int, part double"))
    draw = F.shiftrightunsigned(F.xxhash64("item"), 11).cast("double") * F.lit(2.0**-53)
    chosen = counted.join(limits, ["lang", "n"], "left").filter(F.col("cut").isNull() | (level > F.col("cut")) | ((level == F.col("cut")) & (draw < F.col("part"))))
    return counted.join(chosen.select("n", "item").distinct(), ["n", "item"], "left_semi")


def _model(languages: list[str], ns, items, langs, counts) -> Model:
    """Log frequencies, smoothed by half a count; columns as lists or Arrow arrays."""
    rows = pa.table({"n": ns, "item": items, "lang": langs, "count": counts}).sort_by([("n", "ascending"), ("item", "ascending"), ("lang", "ascending")])
    kind, hits = rows.column("n").to_numpy().astype(np.int64), rows.column("count").to_numpy() + 0.5
    number = {lang: i for i, lang in enumerate(languages)}
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    lang = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int32)[lang.indices.to_numpy()]
    item = rows.column("item").combine_chunks()
    fresh = np.ones(len(kind), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | pc.not_equal(item.slice(1), item.slice(0, len(item) - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(fresh)
    tables: list[dict[str, int]] = []
    base = np.zeros((LONGEST + 1, len(languages)))
    for n in range(LONGEST + 1):
        own = first[kind[first] == n]
        tables.append(dict(zip(item.take(pa.array(own)).to_pylist(), range(at := sum(map(len, tables)), at + len(own)), strict=True)))
        if len(own):
            sums = np.bincount(lang[kind == n], weights=hits[kind == n] - 0.5, minlength=len(languages)) + 0.5 * len(own)
            base[n] = math.log(0.5) - np.log(sums)
    return Model(languages, tables, base, np.append(first, len(kind)), lang, np.log(hits) - math.log(0.5))


def predicted(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred, score> of a text column. The model, bounded by `fit`, is broadcast."""
    sent = spark.sparkContext.broadcast(model)
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    return predict(text)


def fold(key: Column, folds: int) -> Column:
    """crc32 of a key as text, modulo `folds`; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)), F.lit(0))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang; other columns are left).

    Learns from the labelled rows of all folds but `held_out`; a prediction reads nothing but the text. A null text, one without a letter,
    and any text where no row is labelled give ``und`` and score 0. Ties go to the first language by name. Texts are read whole.
    An empty table gives an empty result.
    """
    out = fold(F.col("doc_id"), folds) == held_out
    model = fit(docs.filter(~out).select("doc_id", "text", "lang"))
    return docs.select("doc_id", out.alias("held_out"), predicted(F.col("text"), model, docs.sparkSession).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
