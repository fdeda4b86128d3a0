"""Labels in place: tags, spans and entity chunks as functions of a row's arrays, without a shuffle of tokens.

Offsets are array<struct<start, end>> in order of start, annotations array<struct<label, span_start, span_end, ...>>; ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being found once: the optimizer may put an expression into a lambda that uses it, once an element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ordered(anns: Column) -> Column:
    """Annotations in order of start, then length from long to short, then place."""
    keyed = F.transform(anns, lambda a, i: F.struct(a["span_start"].alias("s"), (a["span_start"] - a["span_end"]).alias("n"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda x: x["a"])


def token_ranges(offsets: Column, anns: Column) -> Column:
    """array<struct<entity, lo, hi>>: of each annotation that overlaps a token, its tokens [lo, hi). As offsets rise, both ends are counts."""
    before = lambda a: F.size(F.filter(offsets, lambda t: t["end"] <= a["span_start"]))
    upto = lambda a: F.size(F.filter(offsets, lambda t: t["start"] < a["span_end"]))
    ranges = F.transform(ordered(anns), lambda a: F.struct(F.upper(a["label"]).alias("entity"), before(a).alias("lo"), upto(a).alias("hi")))
    return F.filter(ranges, lambda r: r["lo"] < r["hi"])


def tag(index: Column, ranges: Column) -> Column:
    """The tag of one token: of the ranges over it, the first gives the entity; the last of that entity gives B on its own first token, else I."""
    over = F.filter(ranges, lambda r: (r["lo"] <= index) & (index < r["hi"]))
    same = F.filter(over, lambda r: r["entity"] == F.get(over, F.lit(0))["entity"])
    last = F.get(same, F.size(same) - 1)
    return F.when(F.size(over) == 0, F.lit("O")).otherwise(F.concat(F.when(last["lo"] == index, F.lit("B-")).otherwise(F.lit("I-")), last["entity"]))


def tags(offsets: Column, anns: Column) -> Column:
    """array<string>: a tag for each token."""

    def of(x: Column) -> Column:
        some = F.transform(x["o"], lambda _, i: tag(i, x["r"]))
        return F.when(F.size(x["r"]) == 0, F.transform(x["o"], lambda _: F.lit("O"))).otherwise(some)

    both = let(F.struct(offsets.alias("o"), anns.alias("a")), lambda x: F.struct(x["o"].alias("o"), token_ranges(x["o"], x["a"]).alias("r")))
    return let(both, of)


def rebased(anns: Column, start: Column, end: Column) -> Column:
    """The annotations that lie within [start, end], relative to start."""
    inside = F.filter(anns, lambda a: (a["span_start"] >= start) & (a["span_end"] <= end))
    return F.transform(inside, lambda a: a.withField("span_start", a["span_start"] - start).withField("span_end", a["span_end"] - start))


def window_labels(rows: DataFrame, windows: str = "ws", offsets: str = "offsets", anns: str = "annotations") -> DataFrame:
    """One row a window of rows (arrays of windows, offsets, annotations): side, slide_index, start_tok, end_tok, char_start, char_end,
    the window's annotations and offsets relative to char_start, and its tags.

    Only annotations that lie whole within the window count; a window's tokens are labelled anew, so that a span begins with B in each."""
    w = rows.select("*", F.explode(windows).alias("w")).drop(windows)
    own = F.slice(F.col(offsets), F.col("w.start_tok") + 1, F.col("w.end_tok") - F.col("w.start_tok"))

    def placed(x: Column) -> Column:
        start, end = F.get(x["own"], F.lit(0))["start"], F.get(x["own"], F.size(x["own"]) - 1)["end"]
        return F.struct(x["own"].alias("own"), x["anns"].alias("anns"), start.alias("start"), end.alias("end"))

    def relative(x: Column) -> Column:
        moved = F.transform(x["own"], lambda t: F.struct(F.greatest(F.lit(0), t["start"] - x["start"]).alias("start"), F.greatest(F.lit(0), t["end"] - x["start"]).alias("end")))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), moved.alias("offsets"), rebased(x["anns"], x["start"], x["end"]).alias("anns"))

    def labelled(x: Column) -> Column:
        return F.struct(x["start"].alias("char_start"), x["end"].alias("char_end"), x["anns"].alias("window_annotations"), x["offsets"].alias("window_offsets"), tags(x["offsets"], x["anns"]).alias("tags"))

    x = let(let(let(F.struct(own.alias("own"), F.col(anns).alias("anns")), placed), relative), labelled)
    keep = [c for c in rows.columns if c not in (windows, offsets, anns)]
    return w.select(*keep, "w.side", "w.slide_index", "w.start_tok", "w.end_tok", x.alias("x")).select(*keep, "side", "slide_index", "start_tok", "end_tok", "x.*")


def decoded(offsets: Column, labels: Column) -> Column:
    """array<struct<label, span_start, span_end>>: B opens a span, following I of its entity go on, any other tag closes it; an orphan I is left out."""
    span = "struct<label:string,span_start:bigint,span_end:bigint>"
    fresh = lambda t: F.struct(F.substring(t["tag"], 3, 100).alias("label"), t["start"].cast("long").alias("span_start"), t["end"].cast("long").alias("span_end"))
    both = F.struct(offsets.alias("o"), labels.alias("l"))
    pairs = let(both, lambda x: F.transform(x["o"], lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.get(x["l"], i).alias("tag"))))
    state = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("open"))
    closed = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, t: Column) -> Column:
        more = s["open"].isNotNull() & (t["tag"] == F.concat(F.lit("I-"), s["open"]["label"]))
        longer = F.struct(s["done"].alias("done"), F.struct(s["open"]["label"].alias("label"), s["open"]["span_start"].alias("span_start"), t["end"].cast("long").alias("span_end")).alias("open"))
        other = F.struct(closed(s).alias("done"), F.when(t["tag"].startswith("B-"), fresh(t)).alias("open"))
        return F.when(more, longer).otherwise(other)

    spans = F.aggregate(pairs, state, step, closed)
    return F.transform(spans, lambda x: x.withField("label", F.lower(x["label"])))


def aligned(offsets: Column, anns: Column) -> Column:
    """array<struct<label, span_start, span_end>>: annotations stretched to the tokens that they overlap; those without a token are left out."""
    edge = lambda o, i, c: F.get(o, i)[c].cast("long")

    def of(x: Column) -> Column:
        return F.transform(token_ranges(x["o"], x["a"]), lambda r: F.struct(F.lower(r["entity"]).alias("label"), edge(x["o"], r["lo"], "start").alias("span_start"), edge(x["o"], r["hi"] - 1, "end").alias("span_end")))

    return let(F.struct(offsets.alias("o"), anns.alias("a")), of)


def comes_back(offsets: Column, labels: Column, anns: Column) -> Column:
    """Whether decoding the tags gives every annotation, stretched to tokens, and nothing else; compared as multisets."""
    one = F.struct(offsets.alias("o"), labels.alias("l"), anns.alias("a"))
    return let(one, lambda x: F.array_sort(aligned(x["o"], x["a"])) == F.array_sort(decoded(x["o"], x["l"])))


def chunks(labels: Column) -> Column:
    """array<struct<type, first, last>> of a tag array by the lenient rule: a chunk begins at a B, after an O, or where the type changes, so
    that an I without a B opens one too."""
    chunk = "struct<type:string,first:int,last:int>"
    state = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open"))
    closed = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, t: Column) -> Column:
        kind = F.substring(t["tag"], 3, 100)
        more = s["open"].isNotNull() & t["tag"].startswith("I-") & (s["open"]["type"] == kind)
        one = F.struct(kind.alias("type"), t["i"].alias("first"), t["i"].alias("last"))
        longer = F.struct(s["done"].alias("done"), F.struct(kind.alias("type"), s["open"]["first"].alias("first"), t["i"].alias("last")).alias("open"))
        return F.when(more, longer).otherwise(F.struct(closed(s).alias("done"), F.when(t["tag"] != "O", one).alias("open")))

    return F.aggregate(F.transform(labels, lambda t, i: F.struct(t.alias("tag"), i.alias("i"))), state, step, closed)


def entity_counts(rows: DataFrame, gold: Column, pred: Column, names: list[str]) -> DataFrame:
    """(type, tp, fp, fn) over rows of label ids: places whose gold id is negative are left out of both sides, ids become tags by `names`, and
    chunks match as sets of (type, first, last). Each type with a chunk on either side has a row."""
    name = F.array(*map(F.lit, names))
    both = F.filter(F.arrays_zip(gold.alias("g"), pred.alias("p")), lambda x: x["g"] >= 0)
    d = rows.select(both.alias("both")).where(F.size("both") > 0)
    d = d.select(F.transform("both", lambda x: F.get(name, x["g"])).alias("g"), F.transform("both", lambda x: F.get(name, x["p"])).alias("p"))
    d = d.select(chunks(F.col("g")).alias("g"), chunks(F.col("p")).alias("p"))
    hit = F.array_intersect("g", "p")
    one = lambda a, k: F.transform(a, lambda c: F.struct(c["type"].alias("type"), *[F.lit(int(n == k)).alias(n) for n in ("tp", "p", "g")]))
    e = d.select(F.explode(F.concat(one(hit, "tp"), one(F.col("p"), "p"), one(F.col("g"), "g"))).alias("x")).select("x.*")
    s = e.groupBy("type").agg(*[F.sum(c).alias(c) for c in ("tp", "p", "g")])
    return s.select("type", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
