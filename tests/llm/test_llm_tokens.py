"""Alignment, spelling variants and rank-array BPE against brute force, on awkward rows and on real ones."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spanloom.llm import alignment, queries, rank_bpe, spelling
from spanloom.llm.queries import tokenizer_path

AWKWARD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "\n  b", " \n b\t c ", "x\x1cy z\x1f", "it's we'll 'tis I'M", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "<|endoftext", "ΣΑΣ Straße İstanbul ﬁn", "été ́x", "日本語の文章。長い　文", "😀👩‍👩‍👧 ok", "12345 3.14 ½ ²", "▁a b", "a▁ b", "b" * 3000, "ab" * 2000, "!!??..--" * 50, "a\x00b", "a b c　d", "\r\nline\r\n", "tail\u0085x", "<s> <0x0A> [INST]", "ꟊ ꟁ \U00010940", "kilometres kilometers kilometre"]
FIELDS = "doc_id long, text string, lang string, n string, word string, key string, part string, form string, token_ids string, decoded string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *[None] * 8) for i, t in enumerate(AWKWARD)] + [(None, "no id", *[None] * 8), (5, "twice", *[None] * 8), (5, "twice", *[None] * 8)]
    real = [(1000 + r.doc_id, r.text, *[None] * 8) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    long = [(5000, " ".join(r[1] for r in real if r[1])[:1_000_000], *[None] * 8)]
    return spark.createDataFrame(rows + real + long, FIELDS).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def by_row(rows):
    return sorted(rows, key=repr)


# --- BPE ---


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_rank_bpe_equals_the_library(docs, rows, library):
    got = rank_bpe.digest(docs, tokenizer_path("word_bpe_49k.json")).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(map(tuple, got)) == by_row(want)


def test_rank_bpe_on_every_kind_of_sign(library):
    rng, table = np.random.default_rng(5), rank_bpe.RankTable.load(tokenizer_path("word_bpe_49k.json"))
    letters = [chr(c) for c in [*range(1, 0x3000), *range(0x1F600, 0x1F650)]]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(3000)] + ["".join(rng.choice(list("abcdea thr"), 200)) for _ in range(300)]
    ids, offsets = table.encode(texts, rank_bpe.Learned())
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_rank_bpe_one_place_at_a_time(library):
    """A table whose joins may not be done at once takes the leftmost of each word alone, with the same ids here."""
    table = rank_bpe.RankTable(tokenizer_path("word_bpe_49k.json"))
    assert table.at_once
    words = ["banana", "aaaaaaa", "thethethe", "x"]
    fast = table.stretches(words)[0].tolist()
    table.at_once = False
    assert table.stretches(words)[0].tolist() == fast


def test_decode_of_odd_ids(spark, library):
    ids = [[1, None, 2], [], None, [49406, 99999, -1, 320], [49407]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, token_ids array<int>")
    got = {r.k: r.decoded for r in rank_bpe.decode(df, tokenizer_path("word_bpe_49k.json")).collect()}
    want = {k: None if x is None else library.decode([i for i in x if i is not None and 0 <= i < 49408], skip_special_tokens=False) for k, x in enumerate(ids)}
    assert got == want


def test_rank_bpe_keeps_other_columns_and_empty_tables(docs):
    out = rank_bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))
    assert out.columns == [c for c in docs.columns if c != "token_ids"] + ["token_ids"]
    assert rank_bpe.digest(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


# --- alignment ---


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in signs} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in signs)}
    done, count = [], Counter()
    for i, t in rows:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        ba = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ids_a]
        bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            done.append((i, [], [], [], ""))
            continue
        owner_a = np.repeat(np.arange(len(ba)), [len(x) for x in ba])
        owner_b = np.repeat(np.arange(len(bb)), [len(x) for x in bb])
        links = sorted(set(zip(owner_a.tolist(), owner_b.tolist(), strict=True)))
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        count.update(pairs)
        cuts = sorted(set(np.cumsum([len(x) for x in ba]).tolist()) & set(np.cumsum([len(x) for x in bb]).tolist()))
        ends_a, ends_b = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
        groups, p, q = [], 0, 0
        for c in cuts:
            x, y = int(np.searchsorted(ends_a, c)) + 1, int(np.searchsorted(ends_b, c)) + 1
            groups.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
            p, q = x, y
        done.append((i, ids_a, ids_b, pairs, ";".join(groups)))
    highest = Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return [(i, len(x), len(y), g.count(";") + bool(g), len(p), sum(count[k] == highest[k[1]] for k in p), sum(count[k] for k in p), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for i, x, y, p, g in done]


@pytest.mark.parametrize("radix, records", [(8, 1 << 21), (3, 500)])
def test_alignment(docs, rows, radix, records):
    paths = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")
    got = alignment.align(docs.where("doc_id is null or doc_id < 5000"), *paths, radix=radix, records=records).collect()
    assert by_row(map(tuple, got)) == by_row(brute_alignment([r for r in rows if r[0] != 5000]))


def test_alignment_of_an_empty_table(docs):
    paths = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")
    assert alignment.align(docs.limit(0), *paths).count() == 0
    assert [r.n_a for r in alignment.align(docs.where("doc_id = 0"), *paths).collect()] == [0]


def test_runs_come_back():
    rng = np.random.default_rng(1)
    code = np.sort(rng.integers(0, 2**40, 5000).repeat(rng.integers(1, 6, 5000)))
    doc = rng.integers(0, 2**22, len(code))
    order = np.lexsort((doc, code))
    code, doc, times = code[order], doc[order], rng.integers(1, 10**6, len(code))
    p, n, s, d, t = alignment.pack_run(code, doc, times)
    pairs = np.cumsum(alignment.unshuffled(p, "<u8").astype(np.int64))
    assert (np.repeat(pairs, alignment.unshuffled(s, "<u4")) == code).all()
    assert (np.cumsum(alignment.unshuffled(d, "<u4"), dtype=np.uint32) == doc).all() and (alignment.unshuffled(t, "<u4") == times).all()
    assert alignment.unshuffled(n, "<u8").sum() == times.sum()


def test_heap_merge():
    rng = np.random.default_rng(2)
    runs = [(np.unique(rng.integers(0, 300, k)), None) for k in (0, 5, 80, 200)]
    runs = [(p, rng.integers(1, 9, len(p))) for p, _ in runs]
    want = Counter()
    for p, c in runs:
        for x, n in zip(p.tolist(), c.tolist(), strict=True):
            want[x] += n
    pairs, counts = alignment.merge_counts(runs)
    assert pairs == sorted(want) and dict(zip(pairs, counts, strict=True)) == dict(want)


# --- spelling ---


def brute_spelling(rows, least=7, min_count=2, factor=10, drop_each=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_each and h % drop_each == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= min_count}
    near = {w: set() for w in n}
    open_ = {}
    for w in n:  # two words are near if and only if they meet with one code point out (or one with all in)
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            open_.setdefault(v, []).append(w)
    for v, ws in open_.items():
        for x in ws:
            for y in ws:
                if x < y and (len(x) == len(y) and sum(a != b for a, b in zip(x, y, strict=True)) == 1 or abs(len(x) - len(y)) == 1):
                    near[x].add(y), near[y].add(x)
    form = {}
    for w, ys in near.items():
        best = min(ys, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling(docs, rows):
    got = spelling.variants(docs, least=7, min_count=2, factor=10, drop_each=31).collect()
    assert sorted(map(tuple, got)) == brute_spelling(rows)


def test_spelling_of_words_made_alike(spark):
    rng = np.random.default_rng(3)
    words = {"abababa", "aaaaaaa", "aaaaaaaa", "aaaaaab"}
    while len(words) < 1500:
        w = "".join(rng.choice(list("abÿ"), int(rng.integers(7, 11))))
        words.add(w)
    rows = [(k, " ".join([w] * int(rng.choice([1, 2, 30, 400])))) for k, w in enumerate(sorted(words))]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), drop_each=5).collect()
    want = brute_spelling(rows, drop_each=5)
    assert sorted(map(tuple, got)) == want and any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)


def test_spelling_of_nothing(docs):
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("doc_id < 3")).count() == 0


def test_queries_are_registered():
    assert {"op11_spill_alignment", "op12_spelling_variants", "op13_rank_array_bpe"} <= set(queries.queries())
