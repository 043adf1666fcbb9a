"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each source's budget in words follows its weight, but is at most ``most`` times what the source has; the
excess goes to the others by weight (water-filling).  A budget is met by whole passes over the source plus one
partial pass: documents whose hash lies below a threshold.  The threshold is found without sorting: words are
summed by source and by the leading bits of the hash, the bucket in which the budget runs out is refined by
the following bits, and so on until single hashes remain.  Only that bucket's rows are looked at again.

Sources are levelled in one task, a narrow row for each; sources that number in the tens of millions (host names,
say) still fit one sort.

Nulls, empty tables and odd rows: a null source is a source of its own, last in order; a null or empty text has
size 0.  Rows alike in id and text share a hash and are taken together or not at all.  A source without words
has target 0.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_name, numbered, scratch, written

#: Hexadecimal digits of the hash that one round of refinement resolves, and the rounds.
DIGITS, ROUNDS = 3, 5
_WIDTH = DIGITS * ROUNDS
WORD = r"[^\x20\x09-\x0D]+"


def cyclic_weight(position: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... for positions from 0."""
    return (position % 3 + 1).cast("double")


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row for each source (``source``, ``source_size``, ``weight``).

    Sources in the order of ``most * size / weight`` reach their ceilings one after the other as the level
    rises; the level at which the sum is met leaves a prefix of them at the ceiling.  As many rows as sources.
    """
    ceiling = F.col("source_size") * F.lit(float(most))
    whole, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_ratio", ceiling / F.col("weight")).withColumn("_place", F.col("position"))
    rows = (
        rows.withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_full", F.coalesce(F.sum(ceiling).over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
    # The first source whose ceiling is not reached at its level sets the level for all.
    rows = rows.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place", "_level"))).over(whole)["_level"])
    return rows.withColumn("target", F.when(F.col("_final").isNull(), ceiling).otherwise(F.least(ceiling, F.col("_final") * F.col("weight")))).drop("_ratio", "_place", "_all", "_full", "_open", "_level", "_final")


def sized(documents: DataFrame, *extra: str) -> DataFrame:
    """Narrow rows: doc_id, source, size and the hash as ``ROUNDS`` groups of hexadecimal digits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary"))).cast("binary"))
    return documents.select("doc_id", "source", *extra, F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.substring(key, 1, _WIDTH).alias("h"))


def plan(rows: DataFrame, most: float = 3.0) -> DataFrame:
    """One row for each source: source, source_size, target, passes (whole ones) and the threshold of the partial one.

    A document belongs to the partial pass if its ``h`` is below ``edge``, as text.
    """
    with scratch(rows.sparkSession) as keep:
        return keep(written(_plan(rows, most), "plan"))


def _plan(rows: DataFrame, most: float) -> DataFrame:
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_source = by_source.withColumn("position", (F.row_number().over(place) - 1).cast("long"))
    by_source = targets(by_source.withColumn("weight", cyclic_weight(F.col("position"))), most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = written(
        by_source.select("source", "source_size", "target", passes.alias("passes"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("prefix", F.lit("")),
        "budgets",
    )
    for r in range(1, ROUNDS + 1):
        inside = rows.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.substring("d.h", 1, DIGITS * (r - 1)) == F.col("s.prefix"))) if r > 1 else rows.alias("d")
        sums = inside.groupBy(F.col("d.source").alias("source"), F.substring("d.h", 1, DIGITS * r).alias("bucket")).agg(F.sum("d.size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        # The boundary bucket is the first one whose words do not fit wholly any more.
        over = (
            sums.alias("b").join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
            .filter(F.col("b.upto") > F.col("s.rest"))
            .groupBy(F.col("b.source").alias("source"))
            .agg(F.min(F.struct("b.bucket", (F.col("b.upto") - F.col("b.words")).alias("before"), "b.words")).alias("edge"))
        )
        # Where nothing runs out, everything fits: the edge is past all hashes ("g" follows "f").
        state = written(
            state.alias("s").join(over.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source")), "left").select(
                "s.source", "s.source_size", "s.target", "s.passes",
                F.when(F.col("o.edge").isNull(), F.col("s.rest")).otherwise(F.col("s.rest") - F.col("o.edge.before")).alias("rest"),
                F.coalesce(F.col("o.edge.bucket"), F.when(F.col("s.prefix") == "", F.lit("g")).otherwise(F.col("s.prefix"))).alias("prefix"),
                F.coalesce(F.col("o.edge.words"), F.lit(0)).alias("words"),
            ),
            f"budgets{r}",
        )
    # The last hash is taken too if that comes nearer to the budget than leaving it.
    take = (F.col("prefix") != "g") & (F.col("words") > 0) & (2 * F.col("rest") >= F.col("words"))
    return state.select("source", "source_size", "target", "passes", F.when(take, F.concat(F.col("prefix"), F.lit("g"))).otherwise(F.col("prefix")).alias("edge"))


def mixed(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds source_size, target and ``repeats`` (times that the mix takes the document) to sized rows."""
    out = rows.alias("d").join(budgets.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return out.select("d.*", "p.source_size", "p.target", (F.col("p.passes") + (F.col("d.h") < F.col("p.edge")).cast("long")).alias("repeats"))


def mixture(documents: DataFrame, most: float = 3.0) -> DataFrame:
    """The documents that the mix takes, all columns as they were, with size, source_size, target, repeats and taken.

    Where ``documents`` has a column of such a name, the mix's column gets underscores after it.
    """
    names = documents.columns
    where = {c.lower(): f"c{k}" for k, c in enumerate(names)}
    inner = numbered(documents)
    rows = inner.select(*inner.columns, *(F.col(where[c]).alias(c) for c in ("doc_id", "source", "text")))
    budgets = plan(written(sized(rows), "sized"), most)
    taken = mixed(sized(rows, *inner.columns), budgets).filter("repeats > 0").withColumn("taken", F.col("size") * F.col("repeats"))
    added, bear = [], list(names)
    for c in ("size", "source_size", "target", "repeats", "taken"):
        bear.append(free_name(bear, c))
        added.append(F.col(c).alias(bear[-1]))
    return taken.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *added)


def mix(documents: DataFrame, most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and taken words of every document."""
    rows = written(sized(documents), "sized")
    return mixed(rows, plan(rows, most)).withColumn("taken", F.col("size") * F.col("repeats")).drop("h")
