"""A training corpus from `documents`: language ID, toxicity, near-duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protloom.llm import decontaminate, langid, mixing, simhash, toxicity
from protloom.llm.common import read, shared_dir


# All stages but the last keep rows as they are: rows of null doc_id and repeated rows go or stay by their texts alone, except
# that near-duplicates leaves one row of each repeated doc_id. An empty table stays empty, whatever the stage.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (und): null texts and texts without a letter. Without labelled rows to learn from
    all are und. Of languages of equal likelihood the first by name is named, which bears on no decision here."""
    langs, table = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs, langs, table, keep_text=True).where("lang_pred <> 'und'").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from labels of documents still there. A document labelled twice counts as
    toxic if either label says so; labels without a document, or null, play no part; without labels nothing goes."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model, keep_text=True).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the least doc_id of documents linked by SimHash fingerprints of five-word runs (2 or fewer differing
    bits) or by a similarity of these runs' sets of 0.8 or more, which fingerprints alone don't reach. Rows of null doc_id
    stay; of rows that repeat a doc_id one stays."""
    return simhash.keep_one(docs, width=5, similarity=0.8).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Items that are null or have fewer than five words are contained in none;
    rows of null doc_id stay, of repeated ids all go or stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's plan: a row for each time that a document is to be read, in which epoch and block. Null sources are a source
    of their own, null ids and repeated rows are planned as they stand, ties in the order go by block and doc_id."""
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("simhash", near_duplicates), ("decontamination", decontamination), ("mixing", mixture)]

#: The stages learn models and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
