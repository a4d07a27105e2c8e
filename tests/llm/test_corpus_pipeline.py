"""The whole pipeline against a plain version of its stages on a small table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from questlog.llm import langid, mixing

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = r"[^\x20\x09-\x0D]+"


def _simhash(text):
    import xxhash

    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _topic(text):
    return ("empty" if not text.strip(" ") else "table" if " | " in text else "shout" if "!!" in text else "marks" if re.search(r"[#$%&*]{3}", text)
            else "figures" if re.search(r"[0-9]{4}", text) else "prose")


def _mixed(docs):
    """doc_ids drawn: cells raked by plain numpy, the scale found by bisection."""
    tokens, cell = Counter(), {}
    for i, text, lang, source in docs:
        cell[i] = (source or "", lang or "", _topic(text))
        tokens[cell[i]] += len(re.findall(WORD, text))
    cells = [c for c, n in tokens.items() if n]
    t = np.array([tokens[c] for c in cells], float)
    w = t / t.sum()
    targets = []
    for k, d in enumerate(mixing.DIMENSIONS):
        values = sorted({c[k] for c in cells})
        code = np.array([values.index(c[k]) for c in cells])
        goal = np.bincount(code, weights=t) ** mixing.POWERS[d]
        targets.append((code, goal / goal.sum()))
    for _ in range(200):
        for code, goal in targets:
            w = w * (goal / np.bincount(code, weights=w))[code]
    low, high = 0.0, (t / w).max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(t, mid * w).sum() < 0.8 * t.sum() else (low, mid)
    rate = dict(zip(cells, np.minimum(1, high * w / t), strict=True))
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return {i for i, *_ in docs if draw(i) < rate.get(cell[i], 1.0)}


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary = {la: [f"{la}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] for la in ("en", "de", "fr")}
    rows = []
    for i in range(150):
        la = rng.choice(["en", "en", "de", "fr"])
        words = [rng.choice(vocabulary[la]) for _ in range(rng.choice([20, 60, 200, 900]))]
        words += rng.choice([[], ["|", "x", "|"], ["wow!!"], ["###"], ["2024"]])
        rows.append((i, " ".join(words), la, f"src{min(int(rng.expovariate(1)), 3)}", 1))
    rows += [(200 + i, rows[i][1], rows[i][2], "src0", 1) for i in range(25)]
    rows += [(230 + i, rows[i][1].rsplit(" ", 1)[0] + " end", rows[i][2], "src0", 1) for i in range(25)]
    rows += [(300, None, "en", "src0", 0), (301, "", "de", None, 0), (302, "12 !?", None, "src1", 0), (303, " \n", "fr", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))

    docs = [(i, t, la, s) for i, t, la, s, _ in rows if langid.words_of(t)]
    prints = {i: _simhash(t) for i, t, *_ in docs}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = _mixed([d for d in docs if find(d[0]) == d[0]])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t, *_ in docs if i in kept}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and total == len(want[i]) and crc == zlib.crc32(np.array(want[i][start:start + length], "<u4").tobytes())
            at += length
        assert at == len(want[i])
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 2 + 1.05 * sum(map(len, want.values())) / 2048  # so few lengths leave some slack
