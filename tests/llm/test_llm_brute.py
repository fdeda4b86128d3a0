"""Language ID and the quality classifier against plain loops; null ids, repeats, a text of a megabyte and empty tables in every operator."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ann, exact_dedup, language_id, line_dedup, ngram_join, packing, pieces, pii, quality, substring_dedup
from spanloom.llm.queries import tokenizer_path

MASK = 2**64 - 1
TEXTS = ["", "ab", "The cat sat; the CAT sat.\nOn a mat!", "été à la plage, déjà", "12 34 12 34 12", "x" * 500, "a b c a b c a b", "  \t\n", "Line one\nLine two\n\n", "ünïcödé ÄÖÜ 😀", None]


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def byte_grams(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for order in (3, 4):
        for i in range(len(b) - order + 1):
            g = order
            for c in b[i : i + order]:
                g = ((g << 8) | c) & MASK
            yield mixed(g)


def test_language_filters_equal_a_loop(spark):
    rows = [("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"), ("le chat et le chien " * 2, "fr"), ("the end", "en"), (None, "en"), ("no language", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), grams=15, bits=10)
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.prior, [0.25, 0.5, 0.25])
    bits = {}
    for i, lang in enumerate(model.languages):
        counts = Counter(g for t, x in rows if x == lang and t for g in byte_grams(t))
        signed = lambda g: g - (g >> 63 << 64)
        kept = sorted(counts, key=lambda g: (-counts[g], signed(g)))[:15]
        own = {p for g in kept for p in (g & 1023, (g >> 32) & 1023)}
        bits[i] = own
        assert {int(k) for k in np.flatnonzero((model.slots[:, 0] >> np.uint64(i)) & np.uint64(1))} == own
        assert model.false_rate[i] == pytest.approx((len(own) / 1024) ** 2)
    langs, scores = model.predict(pa.array(TEXTS))
    for t, lang, score in zip(TEXTS, langs, scores, strict=True):
        grams = list(byte_grams(t))
        found = [sum((g & 1023) in bits[i] and ((g >> 32) & 1023) in bits[i] for g in grams) for i in range(3)]
        real = [max(0, f - r * len(grams)) / (1 - r) for f, r in zip(found, model.false_rate, strict=True)]
        real = [(x + p) if grams else p for x, p in zip(real, model.prior, strict=True)]
        best = max(range(3), key=lambda i: (real[i], -i))
        if any(c.isalpha() for c in t or ""):
            assert lang == model.languages[best] and score == pytest.approx(1 / sum((x / max(real)) ** 8 for x in real))
        else:
            assert lang == "und" and score == 0


def kind(b):
    c = chr(b)
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c == " " else 4 if c == "\n" else 5 if b >= 128 else 7 + signs.index(c) if c in signs else 6


def loop_features(text):
    data = (text or "").encode()
    kinds = Counter(map(kind, data))
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size = len(words), [len(w) for w in words]
    mean = sum(size) / max(n, 1)
    spread = sum((s - mean) ** 2 for s in size) / max(n, 1)
    pairs = list(zip(words, words[1:], strict=False))
    share = [np.sqrt(kinds[k] / max(len(data), 1)) for k in range(quality.KINDS)]
    upper = sum(65 <= w[0] <= 90 for w in words) / max(n, 1)
    distinct = [len(set(x)) / len(x) if x else 1.0 for x in (words, pairs)]
    return [*share, np.log1p(len(data)) / 10, np.log1p(n) / 10, mean / 10, np.sqrt(spread) / 10, *distinct, upper, kinds[4] * 20 / max(n, 1)]


def test_quality_features_equal_a_loop():
    got = quality.features(pa.array(TEXTS))
    assert np.allclose(got, [loop_features(t) for t in TEXTS])


def test_quality_training_equals_a_loop():
    """The same steps with sums over single rows, and the risk that they lower."""
    rng = np.random.default_rng(0)
    p, u, prior = rng.normal(1, 1, (30, 3)), rng.normal(0, 1.5, (40, 3)), 0.4
    got = quality.nn_pu(p, u, prior, steps=12)
    both = np.vstack([p, u])
    centre, scale = both.mean(0), both.std(0) + 1e-3
    ps, us = (np.clip((x - centre) / scale, -6, 6) for x in (p, u))
    draw, w, m, v = np.random.default_rng(7), np.zeros(4), np.zeros(4), np.zeros(4)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, 13):
        xp, xu = ([np.append(x[i], 1.0) for i in draw.integers(0, len(x), len(x))] for x in (ps, us))
        slope = lambda rows: sum(sig(x @ w) * (1 - sig(x @ w)) * x for x in rows) / len(rows)  # noqa: B023, E731
        loss = lambda rows: sum(sig(x @ w) for x in rows) / len(rows)  # noqa: B023, E731
        rest = slope(xu) - prior * slope(xp)
        g = -prior * slope(xp) + rest if loss(xu) - prior * loss(xp) >= 0 else -rest
        g = g + 1e-4 * np.append(w[:3], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.08 * (1 - step / 13) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(np.append(got.weights, got.bias), w)
    full = quality.nn_pu(p, u, prior)

    def risk(model):
        sp, su = model.score(p), model.score(u)
        return prior * (1 - sp).mean() + max(0.0, su.mean() - prior * sp.mean())

    assert risk(full) < risk(got) < risk(quality.nn_pu(p, u, prior, steps=0))


# --- every operator on awkward rows ---

LONG = " ".join(f"w{i % 977} x{i}" for i in range(90_000))  # over a megabyte
ROWS = [(None, "a null id, a@b.co\nline"), (1, "twice the same words in one row here"), (1, "twice the same words in one row here"), (2, LONG), (3, None), (4, ""), (None, "a null id, a@b.co\nline")]

OPERATORS = {
    "language_id": lambda d: language_id.identify(d, language_id.fit(d.withColumn("lang", F.lit("en")))).select("doc_id", "lang_pred", "score"),
    "ngram_join": lambda d: ngram_join.ngram_components(d, k=3, num=90, den=100),
    "pieces": lambda d: pieces.digest(d, tokenizer_path("piece_bpe_32k.model")),
    "pii": lambda d: pii.find(d).select("doc_id", "n_email", "base_sha256"),
    "quality": lambda d: quality.score(d, quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.full(quality.FEATURES, 0.1), 0.0, 0.5)).select("doc_id", "score", "predicted"),
    "substring_dedup": lambda d: substring_dedup.substring_dedup(d, window=35).drop("kept"),
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d).select("doc_id", "group_size", "text_sha256"),
    "line_dedup": lambda d: line_dedup.line_dedup(d, min_docs=10).select("doc_id", "n_lines", "n_dropped"),
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_repeats_and_long_texts(odd, name):
    rows = [tuple(r) for r in OPERATORS[name](odd).collect()]
    ids = Counter(r[0] for r in rows)
    assert ids == Counter(i for i, _ in ROWS)
    for i in (None, 1):
        assert len({r for r in rows if r[0] == i}) == 1, "rows that repeat have one result"


def test_packing_of_null_ids_repeats_and_long_texts(odd):
    got = packing.pack(odd, tokenizer_path("byte_bpe_50k.tiktoken"), capacity=1024, with_ids=False).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    whole = Counter()
    for i, t in ROWS:
        whole[i] += len(packing.ids_of(packing.encoder(tokenizer_path("byte_bpe_50k.tiktoken")), t or "")) + 1
    assert total == whole


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_packing_of_an_empty_table(odd):
    assert packing.pack(odd.limit(0), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


# --- recall of wide vectors ---


@pytest.mark.parametrize("d, rank", [(64, 64), (384, 32), (384, 128)])
def test_recall_by_width(d, rank):
    """A scan of codes holds the 5 nearest of 40 queries among its best 2.5 %, whatever the width."""
    rng = np.random.default_rng(1)
    n, most = 4096, 102
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)) / np.sqrt(rank) + 0.3 * rng.normal(size=(n, d))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x[:2048], 1, steps=2)
    codes = index.encode(index.unit(x), 4.0).astype(int)
    pairs, tables = codes[:, 0::2] * 16 + codes[:, 1::2], index.tables(index.unit(x[:40]))
    hit = 0
    for q in range(40):
        rough, exact = tables[q][np.arange(pairs.shape[1]), pairs].sum(1), unit @ unit[q]
        rough[q] = exact[q] = -9
        hit += len(set(np.argsort(-rough)[:most]) & set(np.argsort(-exact)[:5]))
    assert hit >= 0.9 * 200
