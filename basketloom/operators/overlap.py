"""Overlapping intervals within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.functions.genes import overlaps

#: Intervals of a group that are compared at once; those of larger groups meet only what lies near them.
NEAR = 128


def _loses(a: Column, rivals: Column, order: str, share: float) -> Column:
    """Whether the interval loses against one of the rivals, itself among them or not."""

    def beats(b: Column) -> Column:
        earlier = (b[order] < a[order]) & F.coalesce(b["bitscore"] >= a["bitscore"], F.lit(False))
        later = (b[order] > a[order]) & ~F.coalesce(a["bitscore"] >= b["bitscore"], F.lit(False))
        return F.coalesce((earlier | later) & overlaps(a["q_start"], a["q_end"], b["q_start"], b["q_end"], share), F.lit(False))

    return F.exists(rivals, beats)


def _kept(rows: Column, order: str, share: float) -> Column:
    """The intervals of a list, which is in the order of their starts, that lose against none."""

    def near(part: Column) -> Column:
        first, last = F.array_min(F.transform(part, lambda a: a["q_start"])), F.array_max(F.transform(part, lambda a: a["q_end"]))
        rivals = F.filter(rows, lambda b: (b["q_start"] < last) & (b["q_end"] > first))
        # A list of one list gives it a name, so that it is made once for each part.
        return F.flatten(F.transform(F.array(rivals), lambda found: F.filter(part, lambda a: ~_loses(a, found, order, share))))

    parts = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(NEAR)), lambda k: F.slice(rows, k, NEAR))
    few = F.filter(rows, lambda a: ~_loses(a, rows, order, share))
    return F.when(F.size(rows) == 1, rows).when(F.size(rows) <= NEAR, few).otherwise(F.flatten(F.transform(parts, near)))


def survivors(rows: DataFrame, keys: list[str], order: str, share: float = 0.1) -> DataFrame:
    """Rows that lose against none; those of a group are read once, as one list.

    Rows have q_start, q_end, bitscore and ``order``, which is unique within a group.  Of two that overlap by
    more than ``share`` (0 to 1) of the shorter one, that with the lower score loses, at equal scores the later one.
    A loser still beats others.  Rows without a key, a start or an end overlap none; without a score the earlier loses.
    """
    others = [c for c in rows.columns if c not in keys]
    one = F.struct("q_start", *(c for c in others if c != "q_start"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_rows"))
    grouped = F.lit(True)
    for k in keys:
        grouped = grouped & F.col(k).isNotNull()
    kept = F.when(grouped, _kept(F.col("_rows"), order, share)).otherwise(F.col("_rows"))
    return lists.select(*keys, F.inline(kept)).select(*rows.columns)
