"""Corpus pipeline: rules, classifier, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept; all but the last return the columns of
``documents``. Labels come from the folder's tables. Nulls, empty texts and repeated rows have the results
that the operators define; rows that repeat an id are one
document to the near-duplicate stage, which keeps the one with the smallest text (then lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stairwell.llm import lsh_forest, packing, quality_rules, semantic_votes
from stairwell.llm.common import small, stored
from stairwell.llm.suffix_repeats import SuffixRepeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
GOOD = 0.7  # score from which a document stays


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled rules of their language."""
    docs = quality_rules.with_stratum(docs.select(*COLUMNS))
    # Written with the texts: measured once, and no filter can pull the measures' expressions into itself.
    measured = stored(quality_rules.add_base_counts(docs), "quality-counts")
    cutoffs = stored(quality_rules.choose_cutoffs(measured, _table(spark, sf_dir, "labels")), "cutoffs")
    return quality_rules.judge(measured, cutoffs).where("kept").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled documents vote for quality; the labelled texts are those of the folder."""
    model = semantic_votes.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return semantic_votes.add_score(docs.select(*COLUMNS), model).where(F.col("score") >= GOOD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-copies."""
    docs = docs.select(*COLUMNS)
    found = lsh_forest.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    dropped = stored(found.where("not kept").select("doc_id").distinct(), "dropped")
    left = docs.join(small(dropped, 16), "doc_id", "left_anti")
    ids = left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = stored(ids, "repeated-ids")
    if again.isEmpty():
        return left
    again = small(again, 16)
    first = F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "r.*").select(*COLUMNS)
    return left.join(again, "doc_id", "left_anti").unionByName(one)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without passages of 100 bytes or more that start earlier; a character that a cut would split goes, too."""
    cut = SuffixRepeats(docs.select(*COLUMNS), 100, carry=COLUMNS).cut(readable=True)
    # Unchanged texts stay as they are.
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", pack),
]

# Learned scores, set similarity over whole texts and the packing rule are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
