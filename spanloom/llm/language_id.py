"""Language ID by language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: a slot holds one bit of every language's filter, so a lookup of an n-gram is
the AND of its slots and returns all languages that contain it at once. A text's popcount for each language, less
the false positives that the filter's fill predicts, decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.textvec import _LOWER, mix, raw, slices

U = np.uint64
ORDERS = (3, 4)
#: Places of n-grams that are looked up in one go, whatever the length of a text.
BLOCK = 1 << 18


def byte_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text) of the n-grams of bytes that lie within one text, ASCII in lower case, a block of places at a time."""
    total = len(data) - order + 1
    for lo in range(0, total, BLOCK):
        hi = min(total, lo + BLOCK)
        x = _LOWER[data[lo : hi + order - 1]]
        g = np.full(hi - lo, order, dtype=np.uint64)
        for j in range(order):
            g <<= U(8)
            g |= x[j : j + hi - lo]
        text = (np.searchsorted(offsets, np.arange(lo, hi + order - 1), "right") - 1).astype(np.int32)
        ok = text[: hi - lo] == text[order - 1 :]
        yield mix(g[ok]), text[: hi - lo][ok]


@dataclass
class Filters:
    """slots: (2 ** bits, words of 64 languages); false_rate: of each language, the chance that a foreign n-gram is found."""

    languages: list[str]
    bits: int
    slots: np.ndarray
    false_rate: np.ndarray
    prior: np.ndarray  # shares of the languages, that part what n-grams leave level

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray], bits: int, sizes: list[int]) -> Filters:
        slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), dtype=np.uint64)
        rates = np.zeros(len(languages))
        for i, g in enumerate(grams):
            for at in cls.places(g, bits):
                np.bitwise_or.at(slots[:, i // 64], at, U(1) << U(i % 64))
            rates[i] = float(((slots[:, i // 64] >> U(i % 64)) & U(1)).mean()) ** 2
        return cls(languages, bits, slots, rates, np.array(sizes) / max(1, sum(sizes)))

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = U((1 << bits) - 1)
        return (hashes & mask).astype(np.int32), ((hashes >> U(32)) & mask).astype(np.int32)

    def popcounts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, n-grams found in each language) of each text."""
        data, offsets = raw(column)
        n, found = np.zeros(len(column)), np.zeros((len(column), len(self.languages)))
        for g, text in (part for order in ORDERS for part in byte_grams(data, offsets, order)):
            one, two = self.places(g, self.bits)
            n += np.bincount(text, minlength=len(column))
            for w in range(self.slots.shape[1]):
                plane = self.slots[:, w]
                hit = plane[one] & plane[two]
                for i in range(w * 64, min(len(self.languages), w * 64 + 64)):
                    found[:, i] += np.bincount(text[((hit >> U(i % 64)) & U(1)).astype(bool)], minlength=len(column))
        return n, found

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n, found = self.popcounts(column)
        lettered = has_letter(column)
        if not self.languages:
            return ["und"] * len(column), np.zeros(len(column))
        real = np.maximum(0, found - self.false_rate * n[:, None]) / (1 - np.minimum(self.false_rate, 0.999))
        real = np.where(n[:, None] > 0, real + self.prior, self.prior)
        best = real.argmax(1)
        rel = (real / np.maximum(real.max(1, keepdims=True), 1e-12)) ** 8  # the best has 1
        score = np.where(real.max(1) > 0, 1 / np.maximum(rel.sum(1), 1), 0)
        score = np.where(lettered, score, 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = raw(column)
    ascii_letter = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), out=ascii_letter[1:])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, grams: int = 20_000, bits: int = 18) -> Filters:
    """Filters of the `grams` commonest n-grams of each language, from about per_language texts of each. The sample is bounded
    whatever the input's size: rows, not texts, are drawn, so that copies of a text are rows like others, and a language of up to
    per_language rows is taken whole. Rows whose text or language is null are left out."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filters([], bits, np.zeros((1 << bits, 1), np.uint64), np.zeros(0), np.zeros(0))
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 1.0 if n <= per_language else per_language / n)])
    sample = rows.where(F.rand(17) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0)):
                langs = np.array(b.column(1).slice(lo, hi - lo).to_pylist(), dtype=object)
                data, offsets = raw(b.column(0).slice(lo, hi - lo))
                for g, text in (part for order in ORDERS for part in byte_grams(data, offsets, order)):
                    for lang in set(langs):
                        values, n = np.unique(g[(langs == lang)[text]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams)
    got = top.select("lang", "gram").toArrow()  # at most `grams` rows a language
    lang, gram = np.array(got.column(0).to_pylist(), dtype=object), got.column(1).to_numpy()
    return Filters.build(languages, [gram[lang == x].astype(np.int64).view(np.uint64) if len(gram) else np.zeros(0, np.uint64) for x in languages], bits, [sizes[x] for x in languages])


def identify(docs: DataFrame, model: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; columns of these names that docs has are replaced.

    Null and empty texts, and texts without any letter, are "und" with score 0. What n-grams leave level goes to the commoner
    language, then to the first in alphabetical order. An empty table stays empty; with no
    language learned all is "und"."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits words
    rest = docs.drop("lang_pred", "score")
    place = rest.columns.index(text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(place)):
                part = b.slice(lo, hi - lo)
                lang, score = shared.value.predict(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, schema)
