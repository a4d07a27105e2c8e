"""Toxicity, whitening and cross-tokenizer alignment against plain versions on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from questlog.llm import alignment, ragged, toxicity, whitening

SCHEMA = "doc_id long, text string, lang string, score double, toxic_ int, held_out boolean, before long"
INSULTS = ["oaf", "lout", "knave", "dolt", "cur"]


# ---- toxicity

def _posts(rng, count, insults):
    common = [f"w{i}" for i in range(80)]
    out = []
    for i in range(count):
        words = [rng.choice(common) if rng.random() < 0.8 else f"r{rng.randrange(5000)}" for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def posts():
    return _posts(random.Random(3), 1200, INSULTS)


def _tables(spark, posts, extra=()):
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1, True, 7) for i, t, _ in posts] + [(*x, "en", 0.5, 1, True, 7) for x in extra], SCHEMA).repartition(4)
    return docs, spark.createDataFrame([(i, 1, int(x)) for i, _, x in posts], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_texts(spark, posts):
    extra = [(5000, None), (5001, ""), (5002, "?! ..."), (None, posts[0][1]), (None, None), (5003, posts[0][1]), (posts[3][0], posts[3][1]), (5004, "w1 " * 60_000 + "oaf")]
    docs, labels = _tables(spark, posts, extra)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(posts) + len(extra) and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = {r["doc_id"]: r["predicted"] for r in got if r["held_out"] and r["doc_id"] < 5000}
    truth = {i: x for i, _, x in posts}
    assert np.mean([held[i] for i in held if truth[i]]) >= 0.95 and np.mean([held[i] for i in held if not truth[i]]) <= 0.02
    score = defaultdict(set)
    for r in got:
        score[r["doc_id"]].add(r["score"])
    blank = {*score[5000], *score[5001], *score[5002]}
    assert len(blank) == 1 and blank <= score[None] and score[5003] <= score[None] and len(score[posts[3][0]]) == 1
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_toxicity_reads_no_label_of_the_held_out(spark, posts):
    docs, labels = _tables(spark, posts)
    held = toxicity.fold(F.col("doc_id"), 4) == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert first.keys() == second.keys() and all(math.isclose(first[i], second[i], rel_tol=1e-9) for i in first)


@pytest.mark.parametrize("rows,score", [([], 0.0), ([(1, 0), (2, 0), (None, 1), (3, None)], 0.5 / 3), ([(1, 1), (1, 0)], 1.5 / 2), ([(99, 1)], 0.0)])
def test_toxicity_without_two_classes(spark, rows, score):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "d")], "doc_id long, text string")
    got = toxicity.score_documents(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), folds=1, held_out=9)
    assert [round(r["score"], 9) for r in got.collect()] == [round(score, 9)] * 4


def test_toxicity_of_blank_labelled_texts(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else None) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(8)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, labels, folds=1, held_out=9).collect()} == {3.5 / 9}


def test_kneser_ney_estimates(monkeypatch):
    """Probabilities of every word after every context sum to one, and equal those of a plain count."""
    monkeypatch.setattr(toxicity, "SIGMAS", 0.0)
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 2)
    rng = random.Random(4)
    texts = [(" ".join(rng.choice("aaabbcde") for _ in range(12)), rng.random() < 0.5) for _ in range(30)]
    parts = list(toxicity.count_pairs(pa.array([t for t, _ in texts]), np.array([x for _, x in texts])))
    assert len(parts) == 1
    f = parts[0]
    m = toxicity.fit_counts(f["before"].view(np.uint64), f["word"].view(np.uint64), np.stack([f["ordinary"], f["toxic"]], 1), np.array([sum(not x for _, x in texts), sum(x for _, x in texts)]))
    raw = "abcde".encode()
    hashes = ragged.words(np.frombuffer(" ".join("abcde").encode(), np.uint8), np.array([0, 9]), ragged.PUNCTUATION)[0]
    assert len(m.words) == 5 and len(raw) == 5
    number = dict(zip("abcde", toxicity.numbered(m.words, hashes), strict=True))
    for k in (0, 1):
        counts = Counter(p for t, x in texts if x == bool(k) for p in zip(["^", *t.split()], t.split(), strict=False))
        both = {p for t, _ in texts for p in zip(["^", *t.split()], t.split(), strict=False)}
        d = toxicity.discount(np.array(list(counts.values())))
        kinds, shared = Counter(w for _, w in counts), Counter(w for _, w in both)
        dk, ds = toxicity.discount(np.array(list(kinds.values()))), toxicity.discount(np.array(list(shared.values())))
        base = {w: (shared[w] - ds) / len(both) + ds * len(shared) / len(both) / 6 for w in shared}
        for h in "abcde^":
            total, seen = sum(n for (a, _), n in counts.items() if a == h), sum(a == h for a, _ in counts)
            at = len(m.words) + 1 if h == "^" else number[h]
            everything = 0.0
            for w in "abcde":
                lower = max(kinds[w] - dk, 0) / len(counts) + dk * len(kinds) / len(counts) * base[w]
                want = max(counts[h, w] - d, 0) / total + d * seen / total * lower
                key = at * (len(m.words) + 2) + number[w]
                place = np.searchsorted(m.pairs, key)
                own = m.pair_estimates[place, k] if place < len(m.pairs) and m.pairs[place] == key else 0.0
                got = own + m.backoffs[at, k] * m.word_estimates[number[w], k]
                assert math.isclose(got, want, rel_tol=1e-9), (k, h, w)
                everything += got
            everything += m.backoffs[at, k] * m.word_estimates[len(m.words), k]  # the rare word
            assert math.isclose(everything, 1.0, rel_tol=1e-9)


# ---- whitening

def _cases():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    yield rng.normal(size=(20, 20))
    yield q @ np.diag([5, 5, 5, 3, 3 - 1e-13, 1, 1, .5, .1, 1e-9, 0, 0.0]) @ q.T
    yield np.diag([3.0, 3, 3, 3, 1, 0])
    yield np.eye(7) * 1e-200
    yield np.diag([1e150, 1.0])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])
    yield np.array([[4.0]])
    yield np.ones((9, 9))
    yield np.kron(np.eye(3), np.array([[1.0, .5], [.5, 1.0]]))
    yield np.zeros((5, 5))
    yield np.diag(np.full(29, 1.0), 1) + np.diag(np.full(29, 1.0), -1) + np.diag(np.abs(np.arange(30) - 14.5))


@pytest.mark.parametrize("a", list(_cases()))
def test_eigenvalues_and_vectors(a):
    a = (a + a.T) / 2
    count = min(6, len(a))
    values, vectors = whitening.leading_components(a, count)
    want = np.linalg.eigvalsh(a)[::-1][:count]
    scale = max(np.abs(want).max(), np.finfo(float).tiny)
    assert np.allclose(values / scale, want / scale, atol=1e-13)
    assert np.abs(vectors @ vectors.T - np.eye(count)).max() < 1e-12
    assert np.abs(vectors @ (a / scale) - (values / scale)[:, None] * vectors).max() < 1e-12


def _plain_whitening(rows, count=4):
    """Plain numpy and whole numbers."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = Counter(len(v) for _, v in good)
    width = min(sizes, key=lambda d: (-sizes[d], d))
    good = [(i, [math.floor(256.0 * c) for c in v]) for i, v in good if len(v) == width]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[x - s / n for x, s in zip(v, sums, strict=True)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    out = {}
    for i, x in good:
        c = np.array([a - s / n for a, s in zip(x, sums, strict=True)])
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), np.abs(c @ u / np.sqrt(np.maximum(e, 1e-300)))))
    return out, e / np.trace(centred.T @ centred / n)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 9)) * np.array([9, 6, 4, 3, 1, 1, 1, .5, .2]) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(300 + i, rows[0][1]) for i in range(150)] + [rows[5], rows[5], (None, rows[7][1]), (None, None), (900, None), (901, []), (902, [1.0] * 8 + [None]), (903, [math.nan] * 9), (904, [math.inf] + [0.0] * 8), (905, [1.0, 2.0]),
                                                        (906, [-0.0] * 9), (907, [-1e-9] * 9)]
    schema = "vec_id long, embedding array<double>, label int, x array<long>, n long, component string"
    table = spark.createDataFrame([(*r, 1, [2], 3, "c") for r in rows], schema).repartition(4)
    got = whitening.whiten(table).collect()
    want, explained = _plain_whitening(rows)
    assert len(got) == 4 * sum(len(v) for v in want.values()) and {r["vec_id"] for r in got} == set(want)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for r in got:
        k = r["component"] - 1
        n, deviation, white = want[r["vec_id"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation) and math.isclose(r["explained"], explained[k], rel_tol=1e-9)
        assert math.isclose(abs(r["whitened"]), white[k], rel_tol=1e-7, abs_tol=1e-7)
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] is not None and (r["vec_id"] == 0 or 300 <= r["vec_id"] < 400)}) == 4
    assert whitening.whiten(table.limit(0)).collect() == [] and whitening.whiten(table.filter("vec_id = 903")).collect() == []


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted(whitening.whiten(table).collect())
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [(1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0)]
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(6)] + [(9, [1e300, -1e300, 0.0])][:0], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert len(got) == 18 and all((r["whitened"] is None) == (r["component"] > 1) and math.isclose(r["explained"], float(r["component"] == 1), abs_tol=1e-12) for r in got)
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 3.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(far).collect()) == 6 and all(r["deviation"] is None for r in whitening.whiten(far).collect() if r["vec_id"] < 3)


def test_whitening_sums_are_exact():
    big = 1 << 40
    x = np.array([[big, -big], [big + 3, 5]])
    sums = [int(v) for v in x.sum(axis=0)]
    assert whitening.deviations(x, 2, sums) == [None if v >= 1 << 63 else v for v in (sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)]
    parts = list(whitening._sum_rows(2)(iter([pa.RecordBatch.from_arrays([pa.array(x.tolist())], names=["x"])])))[0]
    assert [(h << 31) + lo for lo, h in zip(parts.column(1).to_pylist(), parts.column(2).to_pylist(), strict=True)] == sums


# ---- alignment of tokenizers

def _plain_alignment(rows):
    """Library tokens, pairs by loops."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = alignment.byte_characters()
    done, held = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            ids_a, ids_b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(chars[c] for c in t.id_to_token(k)) for k in ids_a]
            bytes_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("\u2581", " ").encode() for k in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                cuts = sorted({*ends_a} & {*ends_b})
                groups = [([k for k, e in zip(ids_a, ends_a, strict=True) if p < e <= q], [k for k, e in zip(ids_b, ends_b, strict=True) if p < e <= q]) for p, q in zip([0, *cuts[:-1]], cuts, strict=True)]
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        held.update(links.keys())
        done.append((i, groups, links))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for i, groups, links in done:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), sum(n for (a, b), n in links.items() if held[a, b] == top[a]),
               sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "")


def _aligned_texts():
    rng = random.Random(6)
    parts = ["the ", "quick", " brown", "\n", "\t", "  ", "   ", "ing", "tion", "\u00e9", "\u4e2d\u6587", "\U0001f600", "12", "3456", "<|endoftext|>", "<s>", "</s>", "<0x41>", "'s", ".", ",", "\x00", "\u00a0", "\u3000", "e\u0301", "fi", "\ufb01", "Thonnting "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts += ["", None, " ", "  ", "a ", "a  ", "\u2581", "a \u2581b", "plain", "plain", "x" * 5000, "ab" * 3000 + " end", " " * 4000 + "x", "\n" * 3000, "word " * 4000, "\u4e2d\u6587\u5b57" * 900, "".join(chr(0x1F300 + k % 500) for k in range(600))]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "another"), (None, "no id"), (None, None)]


def _same(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("settings", [{}, {"FAN": 2, "SHARDS": 3, "CHUNK_RECORDS": 500, "FRAME": 7, "TEXT_ROWS": 4, "WIDE_GROUP": 4, "CACHED_WORDS": 5}])
def test_alignment(spark, monkeypatch, settings):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = _aligned_texts()
    docs = spark.createDataFrame([(i, t, 1, "k", 2, [3], "c") for i, t in rows], "doc_id long, text string, n_a int, keys string, chunk int, records array<int>, sha string").repartition(3)
    for name, value in settings.items():
        monkeypatch.setattr(alignment, name, value)
    got = alignment.align(docs, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert _same(tuple(r) for r in got.collect()) == _same(_plain_alignment(rows))
    assert alignment.align(docs.limit(0), *paths).collect() == []
    assert [tuple(r) for r in alignment.align(docs.filter("text is null and doc_id is null"), *paths).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_merge_of_runs_and_maxima(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 3)
    rng = np.random.default_rng(3)
    runs = [np.unique(rng.integers(0, 400, n)) for n in (0, 1, 50, 200, 7)]
    counts = [rng.integers(1, 9, len(r)) for r in runs]
    want = Counter()
    for r, c in zip(runs, counts, strict=True):
        for key, n in zip(r.tolist(), c.tolist(), strict=True):
            want[key] += n
    merged = list(alignment.merge_runs([alignment._packed(r, c) for r, c in zip(runs, counts, strict=True)]))
    assert merged == sorted(want.items())
    top = Counter()
    for key, n in want.items():
        top[key // 20] = max(top[key // 20], n)
    assert list(alignment.with_maxima(iter(merged), 20)) == [(k, 2 * n + (n == top[k // 20])) for k, n in sorted(want.items())]


def test_words_apart_are_as_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    b = alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert b.by_word
    for text in (t for _, t in _aligned_texts() if t and "\u2581" not in t):
        data = np.frombuffer((" " + text).encode(), np.uint8)
        ids, first = b.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == b.model.encode(text) and first.tolist() == [0, len(ids)]
    b.by_word = False
    data = np.frombuffer(b" one two three", np.uint8)
    ids, first = b.encode(data, np.array([0, 4, len(data)]))
    assert ids.tolist() == b.model.encode("one") + b.model.encode("two three") and len(first) == 3
