"""Language ID, fingerprints, token counts, SimHash, packing and language-model scores against brute force on small tables."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from questlog.llm import bpe, langid, lm, minhash, packing, ragged, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, fp string, block int, ahead int, bucket_ int, train int, length int"


def _text(rng, words=60):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + rng.choice(["", "s", "ing", ",", "."]) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    """Plain texts, exact and near copies, nulls, empty and long texts, repeated rows, repeated and null ids."""
    rng = random.Random(5)
    base = [_text(rng) for _ in range(60)]
    near = [t.rsplit(" ", 1)[0] + " end" for t in base[:10]]
    texts = base + base[:8] + near + [None, "", " \n\t ", "one", "two words", "x" * 3000, "word " * 4000, "it's  ÉTÉ 中文 <|endoftext|> 12 ½  "]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (7, "another text under an id that is taken"), (None, "no id"), (None, None), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "z", 1, 2, 3, 4, 5) for i, t in corpus], SCHEMA).repartition(3)


def _key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# ---- token counts

def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = list("aaabcdest'' \n\t  .,!?éßñ中文字  　½²Ⅷ😀'") + ["'s", "'ll", "'re", " 've", "<|endoftext|>", "<|endof", "aaaa", "the ", "  \n", "\x1c", "\x85", "​", "é́"]
    cases = ["", " ", "'s", " 's", "''s", "it'll've", "a  b", "a \n b", "  a  ", "a" * 500, "<|endoftext|>", "a <|endoftext|><|endoftext|>  ", "'lxx"]
    cases += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    want = Tokenizer.from_file(PATH).encode_batch(cases, add_special_tokens=False)
    vocab = bpe.Vocabulary(PATH)
    for case, got, w in zip(cases, bpe.row_ids(vocab, pa.array(cases)), want, strict=True):
        assert got.tolist() == w.ids, case
    assert bpe.row_counts(vocab, pa.array([*cases, None])).tolist() == [*(len(w.ids) for w in want), 0]


def test_word_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(ragged, "SLICE_BYTES", 8)
    vocab, whole = bpe.Vocabulary(PATH), bpe.vocabulary(PATH)
    texts = pa.array([f"number {i} of some words" for i in range(50)])
    assert [x.tolist() for x in bpe.row_ids(vocab, texts)] == [x.tolist() for x in bpe.row_ids(whole, texts)]


def test_token_table(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in corpus]
    got = bpe.token_table(docs, PATH).collect()
    assert _key((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == _key(want) and all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert bpe.token_table(docs.limit(0), PATH).collect() == []


# ---- packing

def test_every_id_is_packed_once(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in corpus)
    packed = packing.materialise(packing.pack_documents(docs, PATH, capacity=256, with_ids=True))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 256 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"], r["start"]].append(tuple(ids.tolist()))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    got = Counter()
    for (doc, size), n in Counter((i, len(x)) for i, x in want.elements()).items():
        parts = [sorted(pieces[doc, size, s]) for s in range(0, size, 256)]
        assert all(len(p) == n for p in parts)
        if n == 1 or len(parts) == 1:
            for p in zip(*parts, strict=True):
                got[doc, sum(p, ())] += 1
    assert all(want[k] == n for k, n in got.items())
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    whole = packing.sequences(packed, 256).collect()
    assert len(whole) == len(places) and sum(r["tokens"] for r in whole) == sum(len(i[1]) * n for i, n in want.items()) and all(len(r["ids"]) == 256 for r in whole)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []


def test_plan_is_exact_and_tight():
    rng = random.Random(3)
    for _ in range(20):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 400)))
        plan = packing.plan(counts, 100)
        used = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(n * m for n, m in pattern.items()) <= 100
            for n, m in pattern.items():
                used[n] += m * times
        assert used == counts
    counts = {n: 50 for n in range(1, 100)}
    assert sum(t for _, t in packing.plan(counts, 100)) <= 1 + math.ceil(sum(n * c for n, c in counts.items()) / 100)
    assert packing.plan({60: 1, 39: 1, 20: 2, 30: 1}, 100)[0][0] == {60: 1, 20: 2}


# ---- SimHash

def _simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    prints = {t: _simhash(t) for _, t in corpus}
    assert _key((r["doc_id"], r["fp"] & (2**64 - 1)) for r in got) == _key((i, prints[t]) for i, t in corpus)
    nodes = sorted(set(prints.values()))
    root = _roots(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in corpus:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    assert all(r["component_id"] == least.get(root[r["fp"] & (2**64 - 1)]) for r in got)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_golay_code_is_perfect():
    table = simhash.error_table()
    assert len(set(table.tolist())) == 2048 and max(int(e).bit_count() for e in table) == 3
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    row, index = simhash.codewords(words)
    assert set(np.bincount(row).tolist()) == {1, 6}


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_links_join_all_at_two_bits(spark, limit):
    """Chains and crowds of fingerprints, met by pairs, by hubs, and by both."""
    rng = random.Random(limit)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds[:12]:
        for _ in range(20):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(frame, limit).collect()]
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert set(found) <= set(near) and _roots(signed, found) == _roots(signed, near)


# ---- fingerprints

def _shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints(docs, corpus):
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = minhash.fingerprints(docs).collect()
    assert _key((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == _key(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 7 and r["doc_id"] != 3:
            by_text[corpus[r["doc_id"]][1] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert minhash.fingerprints(docs.limit(0)).collect() == []
    assert [r["near_next"] for r in minhash.fingerprints(docs.filter("doc_id = 0")).collect()] == [1.0]


@pytest.mark.parametrize(("limit", "block"), [(32, 128), (1, 4)])
def test_near_duplicates_by_bands(spark, monkeypatch, limit, block):
    """Every pair at 0.8 or more is joined and none below, with pairs and with blocks of crowded bands."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    base = [_text(rng, 80) for _ in range(40)]
    rows = list(base)
    for t in base[:15]:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += [base[0], base[0], None, "", " ", "one two"]
    docs = spark.createDataFrame(list(enumerate(rows)) + [(None, base[1])], "doc_id long, text string").repartition(3)
    sets = [_shingles(t or "") for t in rows]
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(rows)) for j in range(i)}
    want = _roots(range(len(rows)), [p for p, x in likeness.items() if x >= 0.8])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, group_limit=limit).collect()}
    assert got.pop(None) == want[1] and got == want
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_signatures_estimate_jaccard():
    rng = random.Random(2)
    a = [_text(rng, 200) for _ in range(30)]
    b = [x.rsplit(" ", rng.randint(1, 150))[0] + " " + _text(rng, 40) for x in a]
    left, right = minhash.signatures(pa.array(a)), minhash.signatures(pa.array(b))
    off = [abs((x == y).mean() - len(_shingles(p) & _shingles(q)) / len(_shingles(p) | _shingles(q))) for x, y, p, q in zip(left, right, a, b, strict=True)]
    assert np.mean(off) < 0.05 and max(off) < 0.17


# ---- language ID

def test_language_id(spark):
    rng = random.Random(9)
    words = {"en": "the house and river with many stones over water".split(), "de": "das haus und fluss mit vielen steinen über wasser".split(), "fr": "la maison et rivière avec beaucoup de pierres sur eau".split()}
    rows = [(i, " ".join(rng.choice(words[la]) for _ in range(30)), la, 1) for i, la in enumerate(["en", "de", "fr"] * 40)]
    rows += [(1000, None, "en", 1), (1001, "12 34 --", "de", 1), (1002, "", None, 1), (None, "das haus", None, 1), (1003, "steinenhaus", None, 1), (1004, "the " * 30000, None, 1), (1004, "the " * 30000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(docs).collect()}
    assert all((i, la) in got for i, _, la, _ in rows[:120])
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (None, "de"), (1003, "de"), (1004, "en")} <= set(got)
    assert all(0 <= r["score"] <= 1 and (r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)) for r in got.values())
    assert all(got[i, "und"]["score"] == 0 for i in (1000, 1001, 1002)) and langid.identify(docs).count() == len(rows)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_bounded_model_keeps_rare_languages(spark):
    """Two frequent languages with many words beside 18 with few: all languages keep their words, and one that shares a kept word its own count of it."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(3000 if k < 2 else 30)] for k in range(20)}
    rows = [(la, " ".join(rng.choice(own) for _ in range(40))) for la, own in words.items() for _ in range(600 if la < "l02" else 6)]
    rows += [("l00", "shared " * 500), ("l19", "shared shared")]
    model = langid.fit(spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string"), max_entries=20 * 5 * 100)
    assert all(sum(w in model.tables[0] for w in words[la]) >= 20 for la in words)
    assert sum(w in model.tables[0] for w in words["l00"]) < 200
    row = model.tables[0]["shared"]
    gains = dict(zip(model.langs[model.starts[row]:model.starts[row + 1]].tolist(), model.gains[model.starts[row]:model.starts[row + 1]].tolist(), strict=True))
    assert {k: round(math.exp(g) * 0.5, 6) for k, g in gains.items()} == {0: 500.5, 19: 2.5}
    held = [(la, " ".join(rng.choice(own) for _ in range(10))) for la, own in words.items() for _ in range(20)]
    assert np.mean([model.predict(t)[0] == la for la, t in held]) >= 0.98
    again = pickle.loads(pickle.dumps(model))
    assert again.tables == model.tables and [again.predict(t) for _, t in held] == [model.predict(t) for _, t in held]


def test_unseen_words_back_off_to_shorter_grams():
    entries = [(0, "known", "a"), (4, "xyza", "a"), (3, "pqr", "b"), (2, "uv", "a"), (1, "m", "b"), (1, "n", "a")]
    entries += [(n, "filler"[:n or 6], la) for n in range(5) for la in "ab"]
    model = langid._model(["a", "b"], *(list(c) for c in zip(*entries, strict=True)), [9] * len(entries))
    assert model.predict("known")[0] == "a" and model.predict("xyza")[0] == "a" and model.predict("pqr")[0] == "b" and model.predict("uv")[0] == "a" and model.predict("mmm")[0] == "b"
    assert model.predict("n")[0] == "a" and model.predict("?")[0] == model.predict("² ½")[0] == "und" and model.predict("öö") == ("a", 0.5)


# ---- language model

def _brute(corpus, train):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in corpus]
    counts = Counter(w for t, own in zip(tokens, train, strict=True) if own for w in t)
    return tokens, counts


def test_language_model_counts_and_base_score(docs, corpus, monkeypatch):
    train = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in corpus]
    tokens, counts = _brute(corpus, train)
    n, v = sum(counts.values()), len(counts)
    want = [(i, not own, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
            for (i, _), t, own in zip(corpus, tokens, train, strict=True)]
    got = lm.score_documents(docs, langid.fold(F.col("doc_id"), 5) != 1).collect()
    assert _key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == _key(want)
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm.score_documents(docs.limit(0), F.lit(True)).collect() == []
    untrained = lm.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in untrained) and len(untrained) == len(corpus)


def test_bigram_estimates_are_exact(spark):
    rows = [(1, "a b a b c"), (2, "a b d"), (3, "b a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("doc_id") <= 2).collect()}
    tokens = {i: [*t.split(), "$"] for i, t in rows}
    one, two, ctx = Counter(), Counter(), Counter()
    for i in (1, 2):
        for a, b in zip(["^", *tokens[i]], tokens[i], strict=False):
            one[b] += 1
            two[a, b] += 1
            ctx[a] += 1
    n, v = sum(one.values()), len(one)
    key, count = Counter(), None
    for i in (1, 2):
        own1, own2, ownc = Counter(), Counter(), Counter()
        for a, b in zip(["^", *tokens[i]], tokens[i], strict=False):
            own1[b] += 1
            own2[a, b] += 1
            ownc[a] += 1
        for a, b in zip(["^", *tokens[i]], tokens[i], strict=False):
            c, p, w = ctx[a] - ownc[a], two[a, b] - own2[a, b], one[b] - own1[b]
            p2, p1 = (p / c if c else 0.0), w / (n - len(tokens[i]))
            bins = lm._bins(np.array([p2 * (v + 1), p1 * (v + 1)]))
            key[int((lm.bucket(np.array([c]))[0] * lm.BINS + bins[0]) * lm.BINS + bins[1])] += 1
    weights = lm.mixture_weights(np.array(list(key)), np.array(list(key.values())))
    for i, t in tokens.items():
        want = 0.0
        for a, b in zip(["^", *t], t, strict=False):
            w = weights[int(lm.bucket(np.array([ctx[a]]))[0])]
            want += math.log10(w[0] * (two[a, b] / ctx[a] if ctx[a] else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_mixture_weights_are_those_of_the_likelihood():
    keys = np.array([(3 * lm.BINS + lm.BINS // 2 + 8) * lm.BINS + lm.BINS // 2 - 2, (3 * lm.BINS) * lm.BINS + lm.BINS // 2 + 4])
    weights = lm.mixture_weights(keys, np.array([70, 30]))
    like = lambda a: 70 * math.log(a * 16 + (1 - a) * 0.5) + 30 * math.log((1 - a) * 4)
    best = max((i / 1000 for i in range(1000)), key=like)
    assert abs(weights[3][0] - best) < 0.02 and np.allclose(weights.sum(axis=1), 1)


def test_arrays_survive_squeezing():
    for a in ([], [0], [5, 0, 2**63], list(range(1000))):
        assert lm.expand(lm.squeeze(np.array(a, np.uint64))).tolist() == a
