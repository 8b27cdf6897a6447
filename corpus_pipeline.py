"""The corpus pipeline: language ID, quality rules, near-dedup, mixing, packing.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet into the folder that driver and executors share and
reads it again, so a lost executor costs no more than its own tasks.

Defined results.  Null, empty and letterless texts go in the first stage; a null doc_id, lang or source is
a value like another.  Texts of any length are judged whole.  Repeated rows count one by one until near-dedup
keeps one of them; of rows with equal doc_ids the one with the least hash stays.  Further columns are handed
through up to packing, whatever their names.  An empty table gives no rows in any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import langid, mixing, packing, quality, simhash
from tessella.llm.common import delete, shared_dir, table, whole_row
from tessella.llm.queries import BYTES

#: A text is no prose in any learned language beyond this code length; equal odds of all bytes cost 8.
MOST_BITS_PER_BYTE = 6.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter, whose language stays open, or that no language describes."""
    model = langid.train(docs.filter(~langid.held_out()))
    judged = docs.select(whole_row(docs).alias("row")).withColumn("p", langid.predicted(docs, model, "row.text"))
    return judged.filter(f"p.lang_pred <> 'und' and p.score >= 0.5 and p.bits_per_byte <= {MOST_BITS_PER_BYTE}").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail a rule of policy v1."""
    return quality.filtered(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, BYTES, with_ids=True)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: Fingerprints, mixing by dynamic programming and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return docs
