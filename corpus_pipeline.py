"""From raw documents to shards of a training mix, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import byte_cnn, mixing, sharding
from folio.llm.decontamination import decontaminated
from folio.llm.ngram_join import least_of_component
from folio.llm.runtime import discard, scratch, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier gives a probability of good quality of a half or more.

    A null text is judged as an empty one; repeated rows are judged alike, and
    without labels of both kinds all are kept or all go.
    """
    net = byte_cnn.learned(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.scored(docs, net).where("score >= 0.5").drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id, or of rows without ids any.

    Rows of null and empty texts are all kept; of repeated rows one is.
    """
    return least_of_component(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that repeat no passage of a benchmark item; those of null and empty texts repeat none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, and a null text has no words to count."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, by id; a null id has the shard of the empty one."""
    return sharding.with_shard(docs, F.col("doc_id"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("source_mix", source_mix),
    ("sharding", shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what a stage leaves besides is removed.

    What the operators do with nulls, repeated rows, ties and empty tables
    holds for the stages: an empty table gives an empty one in each.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, made = docs, []
        with scratch(spark, made):
            docs = stored(stage(spark, docs, sf_dir), name)
            made.append(docs)
        if name != STAGES[0][0]:  # the first reads the table itself
            discard(last)
    return docs
