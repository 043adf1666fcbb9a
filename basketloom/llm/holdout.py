"""Held-out folds and bounded, reproducible samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def is_fold(doc_id: Column, modulus: int, value: int) -> Column:
    """Whether the id lies in the fold; false for a null id."""
    return F.coalesce(fold(doc_id, modulus) == value, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, keep: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` rows (doc_id, y) of each class 0 and 1, chosen by a hash of the id.

    ``keep`` filters the rows that may be learned from.  Rows without id or label are left out; of repeated
    ids the largest label counts.  The bound makes the result fit for a broadcast at any input size.
    """
    rows = (
        labels.filter(keep & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("y"))
    )
    return _first(rows, 0, per_class).unionByName(_first(rows, 1, per_class))


def _first(rows: DataFrame, y: int, n: int) -> DataFrame:
    return rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def attach(documents: DataFrame, sample: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``documents`` in the bounded ``sample``, with its ``y``; the large side is not shuffled.

    Of rows that share an id the one with the smallest hash counts, so the result is as bounded as the sample.
    """
    rows = documents.select("doc_id", *columns).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64(*columns).alias("h"), *columns)).alias("row"))
    return rows.select("doc_id", *(F.col("row")[c].alias(c) for c in columns), "y")
