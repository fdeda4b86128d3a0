"""Spelling variants by asymmetric q-chunks: words of one edit apart, and each word's more frequent form.

Of two words the shorter one contributes chunks and the other one positional grams of the same sizes. The chunk word is cut into two disjoint
halves; one edit spares one of them, and of the two disjoint quarters of the half that it may fall into it spares one as well. Spared chunks
stand in the other word at their own place, or one further if the edit comes before them and adds a code point; so a chunk word
gives four keys (what is left when one quarter is open), the gram word gives the same keys at shifts 0 and 1, and equal keys join. Joined
words are verified. Words that share a key differ in one quarter alone, so groups stay small where prefixes are common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize

#: Letters of runs: A-Z, a-z and U+00C0 to U+00FF.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, min_count: int = 2, drop_each: int = 31) -> DataFrame:
    """(word, n) of all words of at least `least` code points that stand at least min_count times in all texts.

    A word is a maximal run of letters with A-Z lower-cased. With drop_each > 0, where it divides h, the CRC-32 of "<id>:<run>", the run loses its
    code point h % length, which plants typing errors. A null id stands as an empty one; null texts have no words."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if drop_each:
        h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(h % drop_each == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def quarters(n: Column) -> list[tuple[Column, Column]]:
    """[lo, hi) of the four quarters of a word of n code points: halves, cut in halves again."""
    half, first, third = F.floor(n / 2), F.floor(F.floor(n / 2) / 2), F.floor(n / 2) + F.floor((n - F.floor(n / 2)) / 2)
    return [(F.lit(0).cast("long"), first), (first, half), (half, third), (third, n.cast("long"))]


def keys(words: DataFrame, side: str) -> DataFrame:
    """(size, quarter, key, word, n, shift): size is the chunk word's length. The chunk side has shift 0; the gram side has both shifts."""
    rows = []
    for shift in (0, 1) if side == "gram" else (0,):
        size = F.length("word") - shift
        for k, (lo, hi) in enumerate(quarters(size)):
            left = F.substring(F.col("word"), F.lit(1), lo.cast("int"))
            right = F.substring(F.col("word"), (hi + shift + 1).cast("int"), F.length("word"))
            rows.append(F.struct(size.cast("int").alias("size"), F.lit(k).alias("quarter"), F.concat(left, F.lit("\t"), right).alias("key"), F.lit(shift).alias("shift")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("x")).select("word", "n", "x.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) of every two words (word, n; each word once) of one inserted, deleted or replaced code point, each pair once."""
    chunk = keys(words, "chunk").select("size", "quarter", "key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    gram = keys(words, "gram").select("size", "quarter", "key", "shift", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = chunk.join(gram, ["size", "quarter", "key"]).where((F.col("shift") == 1) | (F.col("a") < F.col("b")))
    sure = met.where(F.levenshtein("a", "b", 1) == 1)
    return sure.select("a", "b", "n_a", "n_b").distinct()  # an insertion beside an equal letter has several places


def forms(words: DataFrame, factor: int = 10) -> DataFrame:
    """words (word, n) with n_near, form, form_n and root.

    n_near: how many words are one edit away. form: of these the most frequent (ties: the first in code-point order), if it is at least
    `factor` times as frequent as the word; else null. root: where following forms ends; the word itself if it has none. Repeated words must
    have been added up; an empty table gives no rows. A word with very many near words is folded in partial sums, in no group."""
    words = materialize(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), first.alias("x"))
    big = -F.col("x.less") >= F.col("n") * factor
    found = materialize(found.select("word", "n_near", F.when(big, F.col("x.near")).alias("form"), F.when(big, -F.col("x.less")).alias("form_n")), "spelling-forms")
    # each form is `factor` times as frequent, so chains are short; pointers are doubled until none moves
    root = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = materialize(root.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if root.where("moved").isEmpty():
            break
        root = root.drop("moved")
    out = words.join(found, "word", "left").join(root.drop("moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, min_count: int = 2, factor: int = 10, drop_each: int = 0) -> DataFrame:
    """forms() of the words of all texts; see word_counts. Very long texts are rows like others; a run of letters as long as its text is one word."""
    return forms(word_counts(docs, id_col, text_col, least, min_count, drop_each), factor)
