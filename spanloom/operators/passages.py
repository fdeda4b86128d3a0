"""Passages found whole within texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, span_start): where each passage of items (item_id, text) first stands in each text of docs (doc_id, text) that holds it.

    Texts and passages meet by a key, never all with all. An inner word of a passage, between two white spaces, is whole in every text that holds
    it: the longest is the key. Passages of one or two words have none: they meet by the first g characters, g being the length of the shortest
    such passage, with all g-grams of the texts; that pass is made only if there are such passages. Empty and null passages match nothing."""
    inner = F.split(F.regexp_replace("text", "\n", " "), " ")
    inner = F.when(F.size(inner) > 2, F.filter(F.slice(inner, F.lit(2), F.size(inner) - 2), lambda w: w != ""))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    b = items.where(F.length("text") > 0).select("item_id", F.col("text").alias("passage"), longest.alias("key"))
    texts = docs.select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("key"))
    met = words.join(b.where("key is not null"), "key").select("item_id", "passage", "doc_id")
    short = b.where("key is null").drop("key")
    least = short.agg(F.min(F.length("passage")).alias("g")).first()["g"]
    if least is not None:
        signs = F.split("text", "")
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - least + 1, F.lit(1))), lambda i: F.array_join(F.slice(signs, i, least), ""))
        each = docs.where(F.length("text") >= least).select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
        met = met.unionByName(each.join(short.withColumn("key", F.substring("passage", 1, least)), "key").select("item_id", "passage", "doc_id"))
    found = met.join(texts, "doc_id").where(F.expr("contains(text, passage)"))
    return found.select("item_id", "doc_id", (F.expr("locate(passage, text)") - 1).cast("long").alias("span_start")).distinct()
