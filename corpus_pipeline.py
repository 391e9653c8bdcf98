"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Every stage works on all rows it is given and keeps any further columns. What a stage writes for itself is deleted when its result is written.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, langid, mixing, near_copies, sharding
from tidemark.llm.common import scratch, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose languages are not found, or do not explain their text, go.

    Null and empty texts and texts without a letter go; repeated rows are judged alike; where no row has a language, all texts with a letter stay; an empty table stays empty."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that of the smallest doc_id.

    Null and empty texts are one group; of rows with one doc_id, one stays; a null doc_id stays only where its group has no other; an empty table stays empty."""
    return near_copies.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts, which have no words, stay; repeated rows go or stay together; an empty benchmark leaves all."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that two epochs take has two rows.

    A null source is one source; texts without words, nulls among them, are never taken; repeated rows count each; an empty table stays empty."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; columns of these names that documents have already give way.

    A null text has no bytes; rows alike are shared out if they are many; an empty table stays empty."""
    return sharding.sharded(docs)


STAGES = [("identify_language", identify_language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL can't express fingerprints, language proportions or histogram splitters.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
