"""Approximate nearest neighbours with score-aware (anisotropic) product quantisation.

Codes of four bits a subspace are fitted so that the part of the residual parallel to the vector, which moves inner products
most, costs more than the rest. Vectors lie in leaves around coarse centres; a query's tables of 16 sums a subspace scan the codes of
every leaf in blocks. The best of each block are ranked by their exact cosine, which gives a cosine to reach; every other row goes by its
own code's error, which bounds the sum that it must show to reach it, and those that may are ranked too. So no row is missed, whatever
the codes are worth; poor codes rule out less. Codes are made once, two to a byte, and stored with the vectors; equal queries are
searched once, and queries too are dealt in blocks, so that a task's share is bounded on both sides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialize


def level(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component to 0.5 or more, below 1: no cosine changes, and none overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = level(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Index:
    """centres: (leaves, d); books: (subspaces, 16, width), for vectors of length one padded to subspaces * width."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def unit(self, x: np.ndarray) -> np.ndarray:
        return np.pad(_unit(x), ((0, 0), (0, self.padded - x.shape[1])))

    def leaf(self, unit: np.ndarray, probes: int = 1) -> np.ndarray:
        near = unit[:, : self.centres.shape[1]] @ self.centres.T
        probes = min(probes, near.shape[1])
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]

    def encode(self, unit: np.ndarray, parallel: float, passes: int = 2) -> np.ndarray:
        """Codes (n, subspaces): the nearest, then by coordinates the code that costs least with the others held."""
        m, _, width = self.books.shape
        parts = unit.reshape(len(unit), m, width)
        cross = np.einsum("nmw,mkw->nmk", parts, self.books)
        square = (parts**2).sum(2)[:, :, None] - 2 * cross + (self.books**2).sum(2)[None]  # of the residual, by code
        along = (parts**2).sum(2)[:, :, None] - cross  # the residual's part along the vector, by code
        codes = square.argmin(2)
        rows = np.arange(len(unit))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for s in range(m):
                others = total - along[rows, s, codes[:, s]]
                cost = square[:, s] + (parallel - 1) * (others[:, None] + along[:, s]) ** 2
                codes[:, s] = cost.argmin(1)
                total = others + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def errors(self, unit: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(along, across) of each row: what its codes stand for is `along` times the row plus a part square to it, `across` long."""
        chosen = self.books[np.arange(codes.shape[1])[None], codes].reshape(len(unit), -1)
        along = (chosen * unit).sum(1)
        return along, np.linalg.norm(chosen - along[:, None] * unit, axis=1)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(queries, pairs of subspaces, 256): sums for two codes at a time, so that a scan looks up bytes."""
        m = self.books.shape[0]
        four = np.einsum("qmw,mkw->qmk", unit.reshape(len(unit), m, -1), self.books)
        return (four[:, 0::2, :, None] + four[:, 1::2, None, :]).reshape(len(unit), m // 2, 256).astype(np.float32)


def fit(sample: np.ndarray, leaves: int, subspaces: int | None = None, parallel: float = 4.0, steps: int = 4, seed: int = 5) -> Index:
    """Index of a bounded sample: spherical k-means for the centres, then codes and books in turn. A book's entry is the
    least-squares answer of its rows' anisotropic cost, the other subspaces held. By default a subspace is four components wide at most, so
    that codes grow with the vectors: 16 sums say too little of a wider one."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    subspaces = subspaces or max(16, -(-d // 4))
    subspaces += subspaces % 2
    width = max(1, -(-d // subspaces))
    unit = _unit(sample)
    centres = unit[rng.permutation(len(unit))[:leaves]]
    for _ in range(steps if leaves > 1 else 0):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    full = np.pad(unit, ((0, 0), (0, subspaces * width - d)))
    parts = full.reshape(len(full), subspaces, width)
    books = np.stack([parts[rng.integers(0, len(full), 16), s] for s in range(subspaces)])
    index = Index(centres, books)
    for _ in range(steps):
        codes = index.encode(full, parallel)
        for s in range(subspaces):
            chosen = index.books[np.arange(subspaces)[None], codes]  # (n, subspaces, width)
            residual = full - chosen.reshape(len(full), -1)
            mine = residual.copy().reshape(len(full), subspaces, width)
            mine[:, s] = parts[:, s]  # the residual without this subspace's code
            along = (mine.reshape(len(full), -1) * full).sum(1)
            target = mine[:, s] + (parallel - 1) * along[:, None] * parts[:, s]
            for k in range(16):
                rows = codes[:, s] == k
                if rows.any():
                    p = parts[rows, s]
                    a = rows.sum() * np.eye(width) + (parallel - 1) * p.T @ p
                    index.books[s, k] = np.linalg.solve(a, target[rows].sum(0))
    return index


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in order of the components."""
    dot, a, b = np.zeros(len(x)), 0.0, np.zeros(len(x))
    for j in range(len(q)):
        dot, a, b = dot + q[j] * x[:, j], a + q[j] * q[j], b + x[:, j] * x[:, j]
    return dot / (np.sqrt(a) * np.sqrt(b))


def _top(exact: np.ndarray, best: np.ndarray, ids: list[list[int]], most: int) -> tuple[dict[int, float], float | None]:
    """The ids of the rows `best`, nearest first, until there are `most` and all that tie with the last; and its cosine, if there are so many."""
    found, worst = {}, None
    for c in np.argsort(-exact, kind="stable").tolist():
        if worst is not None and exact[c] < worst:
            break
        for i in ids[best[c]]:
            found.setdefault(i, float(exact[c]))
        if worst is None and len(found) >= most:
            worst = float(exact[c])
    return found, worst


def search(index: Index, x: np.ndarray, ids: list[list[int]], pairs: np.ndarray, along: np.ndarray, across: np.ndarray, q: np.ndarray, most: int, rerank: int) -> Iterator[dict[int, float]]:
    """{id: cosine} for each row of q: its `most` nearest ids among the rows x, and those that tie with the last.

    pairs: bytes of codes, (pairs of subspaces, rows); x and q are level. A query of cosine c to a row gets c * along + sqrt(1 - c^2) * w from
    its codes, |w| <= across. That has no second minimum in c, so a row of cosine t or more gets no less than the value at t with
    w = -across, or the least of all, if that lies above t."""
    reach = np.hypot(along, across)
    turn = -along / np.maximum(reach, 1e-300)  # the cosine with the least sum
    norms, near = np.sqrt(np.einsum("nj,nj->n", x, x)), np.where(along > 1e-6, along, np.inf).astype(np.float32)
    blur = 8 * x.shape[1] * np.finfo(float).eps  # more than the rounding of a cosine
    for lo in range(0, len(q), 64):
        few = q[lo : lo + 64]
        unit, goals = index.unit(few), np.full(len(few), -np.inf)
        kept = np.ones((len(few), len(x)), dtype=bool)  # rows that a query's codes don't rule out
        for at, table in enumerate(index.tables(unit)):
            rough = table[0][pairs[0]]
            for s in range(1, table.shape[0]):
                rough += table[s][pairs[s]]
            best = np.argpartition(-rough / near, rerank)[:rerank] if len(rough) > rerank else np.arange(len(rough))
            worst = _top(_exact(few[at], x[best]), best, ids, most)[1]
            if worst is not None:
                goals[at] = goal = min(worst, 1.0) - blur
                floor = np.where(goal > turn, goal * along - np.sqrt(1 - goal * goal) * across, -reach)
                kept[at] = rough >= floor - 1e-12 - 4 * len(table) * np.finfo(np.float32).eps * np.abs(table).max(1).sum()  # sums are rounded
        some, rows = np.flatnonzero(kept.any(0)), [[] for _ in few]
        for part in range(0, len(some), 4096):
            r = some[part : part + 4096]
            cosines = (unit[:, : x.shape[1]] @ x[r].T) / norms[r]
            for at, row in zip(*np.nonzero(kept[:, r] & (cosines >= goals[:, None] - blur)), strict=True):
                rows[at].append(r[row])
        for at, best in enumerate(rows):
            best = np.array(best, dtype=np.int64)
            yield _top(_exact(few[at], x[best]), best, ids, most)[0]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 8192, leaf_rows: int = 8192, probes: int | None = None, rerank: int = 400, block: int = 16_384, ask_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query's k nearest rows of vectors other than its own id, by cosine in double
    precision, nearest first, ties to the smaller id; all candidates, if there are fewer.

    queries: rows of the same columns. Vectors that are null, empty or zero, that hold null or non-finite components, or
    whose length isn't the commonest one take no part, nor do null ids; such queries return nothing. Equal vectors are searched as one and
    give their smallest ids, and equal queries are searched once, so a hot vector adds no work. Rows that repeat an id and vector count
    once; an id with several vectors counts by its nearest, and as a query by all of them. The
    index is fitted on `sample` rows at most, taken by a hash, and holds every row; centres are rows / leaf_rows, 4096 at most, and leaves
    over `block` vectors are scanned in blocks for `ask_block` queries or so at a time. In each the best `rerank` codes are ranked
    exactly, and then every row that its code's error may hide. Every leaf is scanned at any size, so the result is exact; a number of
    `probes` leaves a query's other leaves out, which costs recall where vectors have no clusters. Empty tables give no rows."""
    spark = vectors.sparkSession
    clean = lambda df: (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0))
    )
    base, asked = clean(vectors), clean(queries)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    d, n = sizes
    base, asked = base.where(F.size("v") == d), asked.where(F.size("v") == d)

    # one row for each distinct vector, with its k + 1 smallest ids
    keyed = base.withColumn("h", F.xxhash64("v"))
    ranked = keyed.withColumn("r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = materialize(ranked.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select("v", "ids"), "ann-classes")
    # one row for each distinct query; its number stays the same once written
    distinct = materialize(asked.select("v").distinct().select("v", F.monotonically_increasing_id().alias("q")), "ann-queries")

    part = classes.where(F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))).select("v").limit(2 * sample)
    rows = part.toArrow().column(0).combine_chunks()  # about `sample` vectors
    if not len(rows):
        rows = classes.select("v").limit(sample).toArrow().column(0).combine_chunks()
    index = fit(rows.flatten().to_numpy().reshape(-1, d), min(4096, max(1, -(-n // leaf_rows))))
    shared = spark.sparkContext.broadcast(index)

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            if len(b):
                x = level(matrix(b.column(0)))
                unit = index.unit(x)
                codes = index.encode(unit, 4.0)
                packed = codes[:, 0::2] * np.uint8(16) + codes[:, 1::2]
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d)
                columns = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())), b.column(1), pa.array(index.leaf(unit)[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in packed], pa.binary()), *map(pa.array, index.errors(unit, codes))]
                yield pa.RecordBatch.from_arrays(columns, names=["v", "ids", "leaf", "codes", "along", "across"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                leaf = shared.value.leaf(shared.value.unit(matrix(b.column(0))), probes).astype(np.int32)
                ends = pa.array(np.arange(len(b) + 1, dtype=np.int32) * leaf.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(leaf.ravel()))], names=["v", "q", "leaf"])

    stored = materialize(classes.mapInArrow(store, "v array<double>, ids array<long>, leaf int, codes binary, along double, across double"), "ann-leaves")
    blocks = stored.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    salted = stored.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("v", F.lit(9)), F.col("blocks")).cast("int"))  # 4096 leaves at most
    parts = blocks.select(F.col("leaf").alias("leaf"), F.col("blocks").alias("blocks"))  # apart from the columns of salted
    if probes is None:
        asks = distinct.crossJoin(F.broadcast(parts))
    else:
        asks = distinct.mapInArrow(route, "v array<double>, q long, leaf array<int>").select("v", "q", F.explode("leaf").alias("leaf"))
        asks = asks.join(F.broadcast(parts), "leaf")
    shares = max(1, -(-distinct.count() // ask_block))
    asks = asks.select("v", "q", "leaf", F.pmod(F.xxhash64("q"), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    salted = salted.select("v", "ids", "codes", "along", "across", "leaf", "block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def scan(key, left, right):
        out = {c: [] for c in ("q", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("v")), level(matrix(right.column("v")))
            ids, numbers = left.column("ids").to_pylist(), right.column("q").to_pylist()
            pairs = np.frombuffer(b"".join(left.column("codes").to_pylist()), dtype=np.uint8).reshape(len(x), -1).T.copy()
            # the k + 1 nearest ids, the query's own perhaps among them
            for number, found in zip(numbers, search(shared.value, x, ids, pairs, left.column("along").to_numpy(), left.column("across").to_numpy(), q, k + 1, rerank), strict=True):
                for i, score in sorted(found.items(), key=lambda f: (-f[1], f[0]))[: k + 1]:
                    out["q"].append(number), out["vec_id"].append(i), out["score"].append(score)
        return pa.table({"q": pa.array(out["q"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    by = ["leaf", "block", "share"]
    hits = salted.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(scan, "q long, vec_id long, score double")
    hits = hits.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    nearest_of = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(nearest_of)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    hits = materialize(hits, "ann-hits")
    askers = asked.select("v", F.col("vec_id").alias("query_id")).join(distinct, "v").select("q", "query_id").distinct()
    each = hits.join(askers, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a query may have several vectors
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
