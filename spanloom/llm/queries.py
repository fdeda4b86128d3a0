"""The queries op1_ to op13_ over the tables of a folder, and the SQL of those that SQL can express.

Each query's columns are a digest of its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import alignment, ann, exact_dedup, language_id, line_dedup, ngram_join, packing, pieces, pii, quality, rank_bpe, spelling, substring_dedup
from spanloom.llm.common import read_table, ship

#: Documents whose labels and languages are never learned from.
HELD_OUT = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == HELD_OUT


def op1_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~F.coalesce(held_out(), F.lit(False)))
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=1024, with_ids=False)


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), window=35).drop("kept")


def op9_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), with_groups=False)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"), least=7, min_count=2, factor=10, drop_each=31)


def op13_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.digest(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = [op1_anisotropic_ann, op2_language_bitmask, op3_signature_tree_join, op4_suffix_array_pieces, op5_boosted_pii, op6_pu_quality, op7_cost_packing, op8_recompression_dedup, op9_extendible_hash_dedup, op10_levelled_line_dedup, op11_spill_alignment, op12_spelling_variants, op13_rank_array_bpe, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in _ALL}


_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT k, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT k, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM t),
x AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
m AS (SELECT x.k, x.i, word, max(CASE WHEN c > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY x.k ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM x LEFT JOIN h ON h.k = x.k AND h.i = x.i),
a AS (SELECT k, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (k)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT k, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
y AS (SELECT k, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key FROM y WHERE key <> '' GROUP BY key HAVING count(DISTINCT k) >= 10),
a AS (SELECT k, count(f.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL) AS kept FROM y LEFT JOIN f USING (key) GROUP BY k)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN a USING (k)
"""


_OP12 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda k: list_reduce(range(0, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS r FROM documents),
keyed AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT r, n, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substring(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM (SELECT r, n, hex(encode(id || ':' || r)) AS x FROM keyed)),
hashed AS (SELECT r, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) AS h FROM bytes, tab),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
open_ AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM open_ a JOIN open_ b ON a.i = b.i AND a.v = b.v AND a.word < b.word UNION SELECT w.word, o.word FROM open_ o JOIN words w ON w.word = o.v),
both_ AS (SELECT a AS word, b AS near FROM near UNION ALL SELECT b, a FROM near),
best AS (SELECT b.word, count(*) AS n_near, arg_min(near, {'n': -y.n, 'w': near}) AS form, max(y.n) AS form_n FROM both_ b JOIN words y ON y.word = near GROUP BY 1),
formed AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT k.word, k.next, f.form FROM walk k JOIN formed f ON f.word = k.next)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_signature_tree_join": _OP3, "op8_recompression_dedup": _OP8, "op9_extendible_hash_dedup": _OP9, "op10_levelled_line_dedup": _OP10, "op12_spelling_variants": _OP12}
