"""N-gram Jaccard join with signature trees.

The join keeps every pair of documents whose shingle sets overlap by at least num / den. Documents with one
set are one class. Classes meet in a group when they agree in one of the parts that `parts` cuts every set into
(sets that link differ in too few shingles to differ in every part). A group is searched by a signature tree: leaves of
documents in order of size, nodes with the OR of their documents' token bitmaps and their range of sizes, and a dual
traversal that drops a pair of nodes when the sizes or the largest possible overlap rule a link out.

The trees are searched twice. First the bitmaps alone move, a bit or two a shingle, to all of a document's groups, and the pairs
that their overlap allows make components of possible links. Every link lies within such a component, so a text moves once, to its
component's tree, where exact sets decide.

Groups of more than `leaf` classes or `LOAD` shingles are dealt over several trees, each with the same hub, and what hub
and trees leave apart meets in further trees, block against block; no partner or candidate is dropped."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import connected_components, delete_tables, materialize
from spanloom.llm.textvec import Words, mix, shingle_sets, slices

FAN = 16
LOAD = 1 << 21


# --- passes over the texts -------------------------------------------------------------------------------------


def _digests(k: int):
    """Of each document its set's size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi in slices(texts):
                sets = shingle_sets(Words(texts.slice(lo, hi - lo), lower=True, lanes=2), k, lanes=2)
                sizes = np.array([len(s) for s, _ in sets], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(sizes)])
                prints = []
                for lane in (0, 1):  # sums of two hashes that share nothing: 128 bits of the set
                    flat = np.concatenate([s[lane] for s in sets])
                    total = np.zeros(len(flat) + 1, np.uint64)
                    np.cumsum(mix(flat), out=total[1:])
                    prints.append(total[at[1:]] - total[at[:-1]])
                f1, f2 = prints
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], names=["doc_id", "n", "f1", "f2"])

    return run


SPARE = 3


class Parts:
    """Cuts of a set such that two sets that link agree in one part.

    Sizes lie in bands a little wider than den / num, so sets that link lie in one band or in neighbours; a set takes part in its
    own band's level and in the one below. With sizes up to `high` at a level, sets that link differ in at most
    d = (den - num) * 2 * high / (den + num) shingles. Each shingle lies in one of some 1.4 * d ranges of hashes, so a set with more than d
    ranges in use has one in use without a difference: that range's shingles are the same in both sets. The few
    sets with fewer ranges in use give their empty ranges as parts too.

    More is true: any d + 1 ranges in use hold one without a difference. So a set needs only its d + 1 rarest parts, and those
    as rare as the last of them: of two sets that link, the one whose last is rarer shares one of its parts with the other, which keeps it
    as well. `of` gives with each part how many of the level's parts are more than d + 1 (times two, plus the level's parity; -1 or
    -2 where all parts have to stay)."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.step = math.log(den / num) * 1.0001 if num < den else 1.0

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, num, den = len(s), self.num, self.den
        if not n or (n * den // num == n and -(-num * n // den) == n):  # only an equal set links
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        own = math.floor(math.log(n) / self.step)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((s ^ (s >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25), out=total[1:])
        out, room = [], []
        for level in (own, own - 1):
            high = math.floor(math.exp((level + 2) * self.step) * 1.000001) + 1
            d = (den - num) * 2 * high // (den + num)
            m = d + 1 + SPARE + 2 * d // 5
            edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
            cut = np.concatenate([[0], np.searchsorted(s, edges), [n]])
            part = mix((total[cut[1:]] - total[cut[:-1]]) + mix(np.arange(m, dtype=np.uint64) + np.uint64((level + 2) << 32)) * np.uint64(3))
            used = cut[1:] > cut[:-1]
            few = used.sum() <= d
            out.append(part if few else part[used])
            room.append(np.full(len(out[-1]), (-1 if few else int(used.sum()) - d - 1) * 2 + level % 2, dtype=np.int32))
        return np.concatenate(out), np.concatenate(room)


REPEATS = 4
#: Rounds in which parts meet, each with its share of the hashes, so that the largest shuffle is this many times smaller.
ROUNDS = 2


def _parts(k: int, num: int, den: int, turn: int = 0, rounds: int = 1):
    """Rows of the round's parts (part % rounds == turn), combined within chunks of about 4 MB of text: of equal sets only the smallest id's parts are given (no other can be
    the smallest of its class). A part found in REPEATS documents of a chunk or more is marked as `many`, and its rows but the smallest
    id's have that id as `head`. So no part has more than REPEATS - 1 rows without a head a chunk."""
    cutter = Parts(num, den)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    def of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, room = cutter.of(s)
        mine = part % np.uint64(rounds) == turn
        return part[mine], room[mine]

    def combined(ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        seen, out = set(), []
        for lo, hi in slices(texts):
            for s in shingle_sets(Words(texts.slice(lo, hi - lo), lower=True), k):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                out.append(none if key in seen else of(s))
                seen.add(key)
        flat, room, owner = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]), np.repeat(ids, [len(x) for x, _ in out])
        # parts in order, the smallest id of each first
        at = np.argsort(flat, kind="stable")
        flat, owner, room = flat[at], owner[at], room[at]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(first, len(flat)))
        many = np.repeat(times >= REPEATS, times)
        head = np.repeat(owner[first], times)
        is_first = np.zeros(len(flat), dtype=bool)
        is_first[first] = True
        follow = many & ~is_first
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(owner), pa.array(many), pa.array(head, mask=~follow), pa.array(room)], names=["part", "doc_id", "many", "head", "room"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable")
            b = b.take(pa.array(order))
            for lo, hi in slices(b.column(1), 4 << 20):
                yield combined(b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False), b.column(1).slice(lo, hi - lo))

    return run


# --- the tree --------------------------------------------------------------------------------------------------


def bitmap(s: np.ndarray) -> np.ndarray:
    """The set's token bitmap: a power of two of bits, 64 at least, and one to two a token beyond. With 1.4 bits a token the largest
    possible overlap of two sets of n tokens that share nothing comes to about 0.65 n, below the 0.89 n that links at 0.8 need."""
    words = 1 << max(0, (len(s) - 1).bit_length() - 6)
    h = s >> np.uint64(20)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_or.at(out, ((h >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def folded(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows, folded to the length of the shortest."""
    width = min(map(len, bitmaps))
    return np.stack([np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in bitmaps])


class Level:
    """Nodes: OR of the bitmaps, smallest and largest size, largest number of tokens that share a bit with others."""

    def __init__(self, bits, low, high, shared):
        self.bits, self.low, self.high, self.shared = bits, low, high, shared

    def parents(self) -> Level:
        cut = np.arange(0, len(self.low), FAN)
        return Level(np.bitwise_or.reduceat(self.bits, cut, axis=0), np.minimum.reduceat(self.low, cut), np.maximum.reduceat(self.high, cut), np.maximum.reduceat(self.shared, cut))

    def may_link(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        ok = (self.high[i] * den >= self.low[j] * num) & (self.high[j] * den >= self.low[i] * num)
        left = np.flatnonzero(ok)
        for at in np.array_split(left, 1 + len(left) * self.bits.shape[1] // LOAD):  # bounds the memory
            x, y = i[at], j[at]
            most = np.bitwise_count(self.bits[x] & self.bits[y]).sum(-1, dtype=np.int64) + np.minimum(self.shared[x], self.shared[y])
            ok[at] = most * (num + den) >= num * (self.low[x] + self.low[y])
        return ok


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tree_links(size: np.ndarray, bitmaps: list[np.ndarray], sets: list[np.ndarray] | None, num: int, den: int, labels: np.ndarray) -> np.ndarray:
    """Labels (small integers, one for each place) of the components that links make, joined to those that labels has before.
    Without sets, the pairs that sizes and bitmaps allow count as links. Node pairs of one component are skipped, as a
    link in them would join nothing."""
    m, label, bits = len(size), np.unique(labels, return_inverse=True)[1], folded(bitmaps)
    order = np.lexsort((bits[:, 0], size))
    size, back, label, bits = size[order], np.argsort(order), label[order], bits[order]
    docs = Level(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64))
    levels = [docs]
    while len(levels[-1].low) > FAN or len(levels) == 1:
        levels.append(levels[-1].parents())
    top = len(levels[-1].low)
    i, j = np.triu_indices(top)
    for depth in range(len(levels) - 1, 1, -1):  # down to pairs of leaves
        ok = levels[depth].may_link(i, j, num, den)
        i, j = i[ok], j[ok]
        below = len(levels[depth - 1].low)
        ci = (i[:, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), dtype=np.int64)
        cj = (j[:, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), dtype=np.int64)
        ok = (ci < below) & (cj < below) & (ci <= cj)
        i, j = ci[ok], cj[ok]
    ok = levels[1].may_link(i, j, num, den)
    for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
        ra, rb = np.arange(a * FAN, min(m, a * FAN + FAN)), np.arange(b * FAN, min(m, b * FAN + FAN))
        apart = label[ra][:, None] != label[rb][None, :]
        if a == b:
            apart &= ra[:, None] < rb[None, :]
        if not apart.any():
            continue
        x, y = np.nonzero(apart)
        x, y = ra[x], rb[y]
        ok = docs.may_link(x, y, num, den) & (size[x] > 0) & (size[y] > 0)
        for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            if label[p] != label[q]:
                if sets is not None:
                    one, two = sets[order[p]], sets[order[q]]
                    both = overlap(one, two)
                    if den * both < num * (len(one) + len(two) - both):
                        continue
                label[label == label[q]] = label[p]
    return label[back]


def _sketches(k: int):
    """Of each document its set's size and bitmap, as 8-byte numbers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                sets = shingle_sets(Words(b.column(1).slice(lo, hi - lo), lower=True), k)
                what = [np.append(np.uint64(len(s)), bitmap(s)).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(what, pa.binary())], names=["doc_id", "what"])

    return run


def _search(k: int, num: int, den: int, exact: bool):
    """Batches sorted by (canon, tree) with doc_id, label, what (a text if exact, else a sketch); out come edges (a, b) of a
    forest of the links found."""

    def group(ids: list, marks: list, what: list) -> tuple[np.ndarray, np.ndarray]:
        rows = {(i, w): m for i, m, w in zip(ids, marks, what, strict=True)}
        ids, marks = np.array([i for i, _ in rows], dtype=np.int64), np.array(list(rows.values()), dtype=np.int64)
        if exact:
            column, sets = pa.array([w for _, w in rows], pa.large_string()), []
            for lo, hi in slices(column):
                sets += shingle_sets(Words(column.slice(lo, hi - lo), lower=True), k)
            size, bits = np.array([len(s) for s in sets], dtype=np.int64), [bitmap(s) for s in sets]
        else:
            both = [np.frombuffer(w, dtype=np.uint64) for _, w in rows]
            sets, size, bits = None, np.array([x[0] for x in both], dtype=np.int64), [x[1:] for x in both]
        after = tree_links(size, bits, sets, num, den, marks)
        root = np.full(after.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, after, ids)
        new = root[after] != ids
        return ids[new], root[after][new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, ([], [], [])
        for b in batches:
            got = b.to_pydict()
            a, z = [], []
            for key, *row in zip(zip(got["canon"], got["tree"], strict=True), got["doc_id"], got["label"], got["what"], strict=True):
                if key != now:
                    if len(rows[0]) > 1:
                        x, y = group(*rows)
                        a.append(x), z.append(y)
                    now, rows = key, ([], [], [])
                for r, v in zip(rows, row, strict=True):
                    r.append(v)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], names=["a", "b"])
        if len(rows[0]) > 1:
            x, y = group(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


# --- the join --------------------------------------------------------------------------------------------------


def likely(docs: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """docs without most rows whose doc_id isn't in ids, by a bitmap of `bits` hashes (1 MB, whatever the input), so that few other
    texts go into the exact join that follows. A full bitmap only lets more rows through."""
    page = 1 << 15
    h = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marks = ids.select(h.alias("h")).groupBy(F.expr(f"h div {page}").alias("__page")).agg(F.expr(f"bitmap_construct_agg(h % {page})").alias("__marks"))
    placed = docs.withColumn("__h", h).withColumn("__page", F.expr(f"__h div {page}"))
    byte = F.expr(f"cast(conv(hex(substring(__marks, cast((__h % {page}) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(shiftleft(1, cast(__h % 8 as int)) as int)")
    return placed.join(F.broadcast(marks), "__page").where(byte.bitwiseAND(bit) != 0).select(*docs.columns)


def search_groups(member: DataFrame, what: DataFrame, search, leaf: int) -> DataFrame:
    """(node, root) of the components that links within groups make. member: canon (the group), doc_id, n (shingles), each pair once;
    what: doc_id and what the trees hold of it; search: from _search."""
    weigh = F.ceil(F.greatest(F.count(F.lit(1)) / leaf, F.sum("n") / LOAD)).cast("int")
    trees = member.groupBy("canon").agg(F.count(F.lit(1)).alias("size"), weigh.alias("trees")).where("size > 1").drop("size")
    placed = member.join(materialize(trees, "ngram-trees"), "canon")
    placed = materialize(placed.withColumn("tree", F.pmod(F.xxhash64("doc_id"), F.col("trees")).cast("int")), "ngram-placed")

    def links(rows: DataFrame) -> DataFrame:
        """rows: canon, tree, doc_id, label."""
        full = rows.join(what, "doc_id").select("canon", "tree", "doc_id", "label", "what")
        full = full.repartition("canon", "tree").sortWithinPartitions("canon", "tree")
        return materialize(full.mapInArrow(search, "a long, b long"), "ngram-edges")

    own = placed.select("canon", "tree", "doc_id", F.col("doc_id").alias("label"))
    hub = placed.where("trees > 1 and tree = 0").select("canon", F.explode(F.sequence(F.lit(1), F.col("trees") - 1)).alias("tree"), "doc_id", F.col("doc_id").alias("label"))
    edges = links(own.unionByName(hub))
    labels = connected_components(edges)

    # groups of several trees: what isn't in the group's largest component yet meets all of the group
    large = placed.where("trees > 1").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id"))
    large = materialize(large.select("canon", "tree", "trees", "doc_id", "label", "n"), "ngram-large")
    main = large.groupBy("canon", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("canon").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = large.join(main, "canon").where("label != main")
    blocks = rest.groupBy("canon").agg(weigh.alias("blocks"))
    rest = rest.join(blocks, "canon").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("blocks")).cast("int"))
    rest = materialize(rest.select("canon", "trees", "blocks", "block", "doc_id", "label"), "ngram-rest")
    if rest.isEmpty():
        return labels
    span = F.sequence(F.lit(0), F.col("trees") - 1)
    one = rest.select("canon", F.explode(span).alias("t"), "blocks", "block", "doc_id", "label").withColumn("tree", F.col("t") * F.col("blocks") + F.col("block"))
    two = large.join(blocks, "canon").select("canon", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", "doc_id", "label")
    two = two.withColumn("tree", F.col("tree") * F.col("blocks") + F.col("block"))
    more = links(one.select("canon", "tree", "doc_id", "label").unionByName(two.select("canon", "tree", "doc_id", "label")).distinct())
    return connected_components(edges.unionByName(more))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", leaf: int = 1024, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: component_id is the smallest doc_id that links reach.

    Links: documents whose sets of distinct k-word shingles (A-Z in lower case, words [^\\x20\\x09-\\x0D]+, whole texts)
    have 100 * intersection >= 100 * num / den * union, checked in integers. With fewer than k words the whole sequence is the only
    shingle. Null and empty texts and texts without a word have no shingle and link with nothing. Rows that repeat an id share
    a component. Rows with a null id get the size of their set and a null component. An empty table gives no rows."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    moved = any(x in base._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "InMemoryTableScan", "Scan ExistingRDD"))
    if moved:  # a task that runs again may get the rows of a shuffle in another order, and so cut them into other chunks
        base = materialize(base, "ngram-docs")
    sized = materialize(base.mapInArrow(_digests(k), "doc_id long, n long, f1 long, f2 long"), "ngram-digest")

    # one document for each set
    real = sized.where("doc_id is not null and n > 0")
    classes = materialize(real.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "ngram-classes")
    reps = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n").alias("n"))

    # candidates: classes that agree in a part, under the smallest class of each such part; parts move once, combined within
    # batches, so a part that a third of all documents share takes few rows of one window
    # rows with a head, which are few, go through the same shuffle, so that they and their heads come from one cut of the texts; each
    # chunk's are a group of their own, so a part that many documents share isn't one task's
    same = Window.partitionBy("part", "head")
    tables = []
    for turn in range(rounds):
        cuts = base.where("doc_id is not null").mapInArrow(_parts(k, num, den, turn, rounds), "part long, doc_id long, many boolean, head long, room int")
        cuts = cuts.withColumn("canon", F.min("doc_id").over(same)).withColumn("c", F.count(F.lit(1)).over(same)).where("c > 1 or many")
        # only heads and their followers are joined by part later
        tables.append(materialize(cuts.withColumn("part", F.when(F.col("many") | F.col("head").isNotNull(), F.col("part"))), "ngram-met"))
    met = reduce(DataFrame.unionByName, tables)
    headless = met.where("head is null")
    heads = headless.where("many").select("part", F.col("doc_id").alias("head"), "canon", "c").distinct()
    followers = met.where("head is not null").select("part", "doc_id", "head", "room").join(heads, ["part", "head"]).select("canon", "doc_id", "room", "c")
    shared = headless.select("canon", "doc_id", "room", "c").unionByName(followers).join(reps, "doc_id")
    # of each set and level the d + 1 rarest parts, those that only it has (which are not in `met`) being the first of them
    level = Window.partitionBy("doc_id", F.pmod("room", F.lit(2)))
    spare = F.floor(F.col("room") / 2)
    ranked = shared.withColumn("need", F.when(spare < 0, F.count(F.lit(1)).over(level)).otherwise(F.count(F.lit(1)).over(level) - spare))
    ranked = ranked.withColumn("rank", F.rank().over(level.orderBy("c"))).where("rank <= need")
    member = materialize(ranked.select("canon", "doc_id", "n").distinct(), "ngram-groups")
    delete_tables(*tables)
    crowd = member.groupBy("canon").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("canon")
    member = member.join(crowd, "canon", "left_semi")

    # possible links by bitmaps, which are small; then each text once, with what it may link with
    sketches = likely(base, member.select("doc_id").distinct()).mapInArrow(_sketches(k), "doc_id long, what binary")
    maybe = search_groups(member, materialize(sketches, "ngram-sketches"), _search(k, num, den, False), leaf)
    member = maybe.select(F.col("root").alias("canon"), F.col("node").alias("doc_id")).join(reps, "doc_id")
    texts = likely(base, maybe.select(F.col("node").alias("doc_id"))).withColumnRenamed("text", "what")
    labels = search_groups(member, texts, _search(k, num, den, True), leaf)

    if moved:
        delete_tables(base)

    # back from classes to documents
    root = labels.select(F.col("node").alias("rep"), "root")
    named = classes.join(root, "rep", "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("component_id"))
    out = sized.join(named, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component only, all columns as they were; null ids stay."""
    found = ngram_components(docs, k, num, den, id_col, text_col)
    gone = found.where("doc_id is not null and component_id != doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
