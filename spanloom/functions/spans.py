"""Column functions over half-open character spans and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["span_end"], b["span_end"]) - F.greatest(a["span_start"], b["span_start"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two spans; 0 when they are apart or empty."""
    inter = overlap(a, b)
    union = (a["span_end"] - a["span_start"]) + (b["span_end"] - b["span_start"]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def same_label(a: Column, b: Column) -> Column:
    return F.lower(a["label"]) == F.lower(b["label"])


def stripped(s: Column) -> Column:
    """Without white space of any script, and the separators \\x1c to \\x1f, at both ends."""
    return F.regexp_replace(s, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def near(tolerance: int) -> dict[str, Callable[[Column, Column], Column]]:
    """Predicates on offsets that differ by `tolerance` at most."""
    start = lambda g, p: F.abs(g["span_start"] - p["span_start"]) <= tolerance
    end = lambda g, p: F.abs(g["span_end"] - p["span_end"]) <= tolerance
    both = lambda g, p: start(g, p) & end(g, p)
    return {"start": start, "end": end, "both": both, "relaxed": lambda g, p: both(g, p) & (overlap(g, p) > 0)}


_ALIKE: dict[str, Callable[[Column, Column], Column]] = {
    "iou50": lambda g, p: iou(g, p) >= 0.5,
    "iou80": lambda g, p: iou(g, p) >= 0.8,
    "text": lambda g, p: stripped(g["text"]) == stripped(p["text"]),
}
#: Match predicates by name, gold against prediction of one label; offsets with a tolerance of 5.
MATCHES = _ALIKE | near(5)


def match_families(tolerances: tuple[int, ...] = (10, 50)) -> dict[str, Callable[[Column, Column], Column]]:
    """All predicates, those on offsets once for each tolerance (start10, ...)."""
    return _ALIKE | {f"{k}{t}": m for t in tolerances for k, m in near(t).items()}


def one_to_one(gold: Column, pred: Column, matches: Callable[[Column, Column], Column]) -> Column:
    """True positives of one-to-one matching: each gold element in order takes the first unused prediction that matches."""
    places = F.when(F.size(pred) > 0, F.sequence(F.lit(0), F.size(pred) - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")

    def step(used: Column, g: Column) -> Column:
        free = F.filter(places, lambda j: ~F.array_contains(used, j) & matches(g, F.get(pred, j)))
        return F.concat(used, F.slice(free, 1, 1))

    return F.size(F.aggregate(gold, none, step))


def greedy(gold: Column, pred: Column, matches: Callable[[Column, Column], Column]) -> Column:
    """one_to_one() of spans whose labels agree, whatever their case."""
    return one_to_one(gold, pred, lambda g, p: same_label(g, p) & matches(g, p))


def multiset_hits(gold: Column, pred: Column) -> Column:
    """How many elements two arrays share, repeats counted as often as both have them."""
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.transform(F.array_intersect(gold, pred), lambda t: F.least(times(gold, t), times(pred, t))), F.lit(0), lambda s, x: s + x)


def normal_text(s: Column) -> Column:
    """Stripped, then without white space and the marks U+0F0B and U+0F0D at the end."""
    return F.regexp_replace(stripped(s), "(?U)[\\s\\x1c-\\x1f\\u0F0B\\u0F0D]+$", "")


def exact_hits(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) on sets of (label, start, end): duplicates count once."""
    key = lambda s: F.struct(F.lower(s["label"]), s["span_start"], s["span_end"])
    a, b = F.array_distinct(F.transform(gold, key)), F.array_distinct(F.transform(pred, key))
    tp = F.size(F.array_intersect(a, b))
    return tp, F.size(b) - tp, F.size(a) - tp


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def tier(n: Column, window: int, medium: int) -> Column:
    return F.when(n <= window, "short").when(n <= medium, "medium").otherwise("long")


def bucket(chars: Column, short: int = 50_000, medium: int = 500_000) -> Column:
    return F.when(chars < short, "short").when(chars < medium, "medium").otherwise("long")


def keyed_order(seed: int, key: Column) -> Column:
    """A seeded order of rows that is the same on any layout of the data."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def rebased(spans: Column, offset: Column) -> Column:
    """Spans of a window, moved by the window's offset."""
    return F.transform(spans, lambda s: s.withField("span_start", s["span_start"] + offset).withField("span_end", s["span_end"] + offset))


def distinct_spans(spans: Column) -> Column:
    """Each start, end and text once (the first label of those that share them), in order of start and end."""
    place = F.transform(spans, lambda s, i: F.struct(s["span_start"].alias("a"), s["span_end"].alias("b"), s["text"].alias("t"), i.alias("i"), s.alias("s")))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & x["t"].eqNullSafe(y["t"])
    first = F.filter(place, lambda x: ~F.exists(F.slice(place, 1, x["i"]), lambda y: same(x, y)))
    return F.transform(F.array_sort(first), lambda x: x["s"])
