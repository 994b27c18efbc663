"""A training corpus from `documents`: quality, near copies, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`.  Null and empty texts pass through as the operators say: they are scored, count as copies of one
another, hold no personal data, and give no word to the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import removed, shared_folder, stored, table
from lattica.llm.mixing import mix
from lattica.llm.near_copies import drop_near_copies
from lattica.llm.pii import sanitise
from lattica.llm.piece_encoding import round_trip
from lattica.llm.rule_ensemble import drop_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and what reveals it replaced."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mix(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids with begin and end, their number, and the text that they decode to."""
    out = round_trip(docs.select("doc_id", "lang", "source", "text"))
    return out.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("PII", personal_data), ("mixing sources", mixture), ("SentencePiece encoding", encoding)]

#: SQL cannot express the stages' learned and iterated parts; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again. The last is returned unwritten.

    A stage's files go once the next is written, those of the last but one stay for the result that reads them; if a
    stage fails, all go.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
            if k:
                removed(spark, f"{folder}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        removed(spark, folder)
        raise
