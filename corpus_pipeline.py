"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs.  All but the last return the columns of ``documents``; the last adds what the mix says
about each document and leaves out those that it does not take.

All stages: columns beyond doc_id, text and source are carried along, whatever they are called; an empty table
stays empty; null ids are ids like others.  Each stage says what it does with null and empty texts and ties.

No stage can be said in SQL as a whole (boosted trees, hashed joins over n-grams, edit distances), so there is
no ORACLE_SQL; the tests hold each stage against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.llm import decontaminate, mixing, quality_model, shingle_join, substring_dedup
from basketloom.llm.store import free_name, remove, scratch, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  It is fitted on a bounded sample of all labels.

    Null texts are judged as empty ones; rows alike are judged alike; a score of just 0.5 is kept.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score = free_name(docs.columns, "score")
    return quality_model.score(docs, model, *docs.columns, name=score).filter(F.col(score) >= 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Null and wordless texts are no one's duplicates and all stay; of rows alike in id and text one stays; a group
    without any id keeps one of its documents.
    """
    return shingle_join.one_of_each(docs).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that stand elsewhere too; a document that loses all its words goes.

    Null, empty and short texts stay as they are; rows alike are each other's duplicates.
    """
    return substring_dedup.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.  Null and empty texts hold none; rows alike go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, repeats and taken.

    A null source is a source of its own; rows alike in id and text are taken together or not at all; where docs
    has a column of one of those names, the mix's gets an underscore after it.
    """
    return mixing.mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            after = keep(written(stage(spark, docs, sf_dir), name))
        if hasattr(docs, "table_path"):
            remove(spark, docs.table_path)
        docs = after
    return docs
