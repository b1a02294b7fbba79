"""The training corpus, in five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe.llm import jaccard_join, langid, packing, pii, substring_dedup
from perilframe.llm.common import DOCUMENT_COLUMNS, as_documents, small_batches, stored, table
from perilframe.llm.queries import pseudonym_key, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted; ``und`` ones go. A missing lang becomes the prediction."""
    small_batches(spark)
    docs = as_documents(docs)
    found = langid.predict(docs, langid.train(docs)).where("lang_pred <> 'und'")
    return as_documents(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones (five-word shingles, 0.8): that of the least doc_id. Of rows that repeat it, with one text or several, the first by their columns' order stays."""
    small_batches(spark)
    docs = as_documents(docs)
    firsts = jaccard_join.join(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    whole = F.struct(*(F.col(c).alias(c) for c in docs.columns))
    kept = docs.join(firsts, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(whole).alias("first")).select("first.*")
    return as_documents(kept.unionByName(docs.where("doc_id is null")))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages are cut out of all documents but the first with them."""
    small_batches(spark)
    return as_documents(substring_dedup.cut(as_documents(docs)))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their pseudonyms."""
    return as_documents(pii.pseudonymise(as_documents(docs), pseudonym_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, dealt to sequences of at most 1024 ids."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard_join", jaccard_dedup), ("substring_dedup", passage_dedup), ("pii", pseudonyms), ("packing", pack)]
#: Training, components and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
