"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.textvec import Words, grams, raw, slices

#: Bytes by kind: each printable ASCII sign apart, letters by case, digits, white space, the rest.
_KIND = np.zeros(256, dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == " " else 4 if _c == "\n" else 5 if _i >= 128 else 6
for _n, _i in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_i] = 7 + _n
KINDS = int(_KIND.max()) + 1
FEATURES = KINDS + 8


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values of each text over its values (1 for none)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    n = np.diff(first)
    return np.where(n > 0, np.bincount(t[new], minlength=len(n)) / np.maximum(n, 1), 1.0)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers a text, from the text alone."""
    data, offsets = raw(column)
    rows, length = len(column), np.diff(offsets)
    text = np.repeat(np.arange(rows), length)
    kinds = np.bincount(text * KINDS + _KIND[data], minlength=rows * KINDS).reshape(rows, KINDS).astype(np.float64)
    words = Words(column)
    n = np.diff(words.first)
    size = words.ends - words.starts
    mean = np.bincount(words.text_of(), weights=size, minlength=rows) / np.maximum(n, 1)
    spread = np.bincount(words.text_of(), weights=(size - mean[words.text_of()]) ** 2, minlength=rows) / np.maximum(n, 1)
    pairs = grams(words.hashes, 2)
    inside = words.text_of()[: len(pairs)] == words.text_of()[1:] if len(words.hashes) > 1 else np.zeros(0, bool)
    pair_first = np.concatenate([[0], np.cumsum(np.bincount(words.text_of()[: len(pairs)][inside], minlength=rows))]) if len(pairs) else np.zeros(rows + 1, np.int64)
    lead = data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    upper = np.bincount(words.text_of(), weights=(lead >= 65) & (lead <= 90), minlength=rows) / np.maximum(n, 1)
    share = np.sqrt(kinds / np.maximum(length, 1)[:, None])
    more = [np.log1p(length) / 10, np.log1p(n) / 10, mean / 10, np.sqrt(spread) / 10, _distinct(words.hashes, words.first), _distinct(pairs[inside], pair_first), upper, kinds[:, 4] * 20 / np.maximum(n, 1)]
    return np.column_stack([share, *more])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Model:
    """Logistic model that minimises prior * R_p+ + max(0, R_u- - prior * R_p-) with Adam, its rate
    falling to 0; where the second part falls below 0, the step goes up its gradient instead, as the estimator prescribes."""
    both = np.vstack([positive, unlabelled])
    centre, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - centre) / scale, -6, 6) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), 0.0
    m, v, rng = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        xp, xu = (x[rng.integers(0, len(x), min(len(x), 4096))] for x in (p, u))
        # the sigmoid loss is bounded, as the estimator wants: l(z, +1) = s(-z), l(z, -1) = s(z)
        sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        dp, du = sp * (1 - sp), su * (1 - su)
        grad = lambda x, d: np.append(x.T @ d, d.sum()) / len(x)
        negative = su.mean() - prior * sp.mean()
        g_neg = grad(xu, du) - prior * grad(xp, dp)
        g = -prior * grad(xp, dp) + g_neg if negative >= 0 else -g_neg
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(centre, scale, w, float(b), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 5, margin: float = 0.25) -> float:
    """The share of positives among unlabelled rows, from positives and unlabelled rows alone. A logistic model tells the two apart, each
    row scored by the fold that leaves it out; for every threshold, the share of unlabelled rows above it over that of positives
    bounds the prior from above, and the least of these bounds (each widened by `margin` standard errors) is the estimate. Within 0.05 to 0.95."""
    rng, sp, su = np.random.default_rng(3), [], []
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    for k in range(folds):
        out_p, out_u = np.arange(len(p)) % folds == k, np.arange(len(u)) % folds == k
        if out_p.all() or out_u.all():
            return 0.5
        model = nn_pu(p[~out_p], u[~out_u], 0.5, steps=300)
        sp.append(model.score(p[out_p]))
        su.append(model.score(u[out_u]))
    sp, su = np.sort(np.concatenate(sp)), np.sort(np.concatenate(su))
    at = np.quantile(sp, np.linspace(0.05, 0.9, 50))
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    wide = margin * (np.sqrt(above_p * (1 - above_p) / len(sp)) + np.sqrt(above_u * (1 - above_u) / len(su)))
    bounds = ((above_u + wide) / np.maximum(above_p - wide, 1e-6))[above_p > wide]
    return min(0.95, max(0.05, float(bounds.min()))) if len(bounds) else 0.5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000) -> Model:
    """Trusted positives: documents with label 1; unlabelled: documents without a label. At most about `most` of either,
    chosen by a hash of the id (a bounded sample). The class prior is estimated on the same sample, from positives and unlabelled
    rows alone (estimate_prior); labels 0 only keep their documents out. A document with contrary labels counts as unlabelled."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
    known = marks.agg(F.count_if(F.col("lo") == 1)).first()
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    n_docs = docs.count()
    share = lambda n: F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))
    good = marks.where((F.col("lo") == 1) & (F.col("hi") == 1)).select("__id").where(share(known[0]))
    unknown = base.where(share(n_docs)).join(marks.where("lo = hi").select("__id"), "__id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0)):
                x = features(b.column(0).slice(lo, hi - lo))
                flat = pa.array(x.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(flat, FEATURES).cast(pa.list_(pa.float32()))], names=["x"])

    def matrix(df: DataFrame) -> np.ndarray:
        got = df.select("text").mapInArrow(run, "x array<float>").toArrow().column(0).combine_chunks()  # at most about `most` rows
        flat = got.flatten().to_numpy() if len(got) else np.zeros(0)
        return flat.reshape(-1, FEATURES).astype(np.float64)

    p, u = matrix(base.join(good, "__id", "left_semi")), matrix(unknown)
    if not len(p) or not len(u):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    return nn_pu(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: good likelier) and predicted (1 if score >= 0.5) added; columns of these names are
    replaced. Null counts as empty, and empty texts are scored like others. An empty table stays empty; without positives or unlabelled rows
    the score is 0.5 everywhere."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")
    place = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(place)):
                part = b.slice(lo, hi - lo)
                s = shared.value.score(features(part.column(place)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
