"""Queries of this package's operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe.llm import ann, dac, edit_counts, jaccard_join, langid, packing, periodic, pii, substring_dedup, suffix_dedup, topk, treebpe, whitening
from perilframe.llm.common import table


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key of pseudonyms; a key for trials, if it has none."""
    return spark.conf.get("spark.perilframe.pii.secretKey", "for trials only")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms; n_pii is 0 where there was none."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after its personal numbers and addresses are cut out."""
    docs = edit_counts.redactions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return edit_counts.count_edited(docs, vocabulary("byte_bpe_50k.json"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of every document, and digests of all its runs and of what is left without their repeats."""
    found = periodic.collapse(periodic.planted(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic.longest(F.col("runs")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digest of what is left of every document without its repeated strings of 100 bytes."""
    found = suffix_dedup.cut(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_topk, op2_substring_dedup, op3_language, op4_pseudonyms, op5_packing, op6_edit_counts, op7_neighbours, op8_token_files, op9_tree_bpe, op10_jaccard_join, op11_periodic_runs, op12_whitening, op13_suffix_dedup)
    return {f.__name__: f for f in every}


#: op1 over all pairs; the other operators' work can't be said in SQL, or not over whole tables.
_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


#: op13 over a table of all strings of 100 bytes, each as hexadecimal digits.
_STRINGS = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
k AS (SELECT doc_id, 256 * i AS p, substr(h, 512 * i + 1, 512 + 198) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 512 + 1)) AS i FROM d)),
w AS (SELECT doc_id, p + i AS p, md5(substr(part, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, p, part, unnest(range(0, least(256, len(part) // 2 - 99))) AS i FROM k)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) > 1 AS again FROM w),
b AS (SELECT doc_id, p + i AS p, substr(part, 2 * i + 1, 2) AS x FROM (SELECT doc_id, p, part, unnest(range(0, least(256, len(part) // 2))) AS i FROM k)),
c AS (SELECT b.doc_id, b.p, x, coalesce(max(CASE WHEN again THEN b.p END) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.p = b.p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS fresh FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (fresh) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOPK, "op13_suffix_dedup": _STRINGS}
