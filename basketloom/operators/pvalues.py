"""Hypergeometric tails of interactions, and their correction for false discoveries."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import interactions
from .lineage import cut, run_offsets, sorted_runs

#: With more neighbours than places (a negative ``n0``) tails are generalised exact rationals up to this many places.
EXACT = 5_000


def binomial(n: int, k: int) -> int:
    """Binomial coefficient, also for negative ``n``; 0 for negative ``k``."""
    if k < 0:
        return 0
    return math.comb(n, k) if n >= 0 else (-1) ** k * math.comb(k - n - 1, k)


def _generalised(n0: int, n1: int, n2: int, b1: int, b2: int, total_b: int, total: int) -> float:
    """The tail as a difference of exact binomials, which may lie outside 0 to 1."""
    whole = binomial(total, total_b)
    if whole == 0:
        return 1.0
    if b1 == 0 or b2 == 0:
        near, seen = (n1, b1) if b2 == 0 else (n2, b2)
        return (whole - sum(binomial(n0, total_b - d) * binomial(near, d) for d in range(seen))) / whole
    less = sum(binomial(n0, total_b - d1 - d2) * binomial(n1, d1) * binomial(n2, d2) for d1 in range(b1 + 1) for d2 in range(b2 + 1) if (d1, d2) != (b1, b2))
    return (whole - less) / whole


#: log(n!) less Stirling's first terms, for n up to 15.
_STIRLING = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)])


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """log(n!) - log(sqrt(2 pi n) (n / e)^n)."""
    x = np.maximum(n, 16.0)
    square = 1 / (x * x)
    series = (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))) / x
    return np.where(n > 15, series, _STIRLING[np.minimum(n, 15).astype(int)])


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without loss where x is near the mean."""
    gap = x - mean
    v = gap / (x + mean)
    near, odd, power = gap * v, 2 * x * v, v * v
    for j in range(1, 12):
        odd = odd * power
        near = near + odd / (2 * j + 1)
    return np.where(np.abs(v) < 0.1, near, x * np.log(x / mean) - gap)


def _log_binomial(x: np.ndarray, n: np.ndarray, drawn: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log probability of x hits in n trials of chance drawn / (drawn + left), by the saddle-point expansion."""
    p, q = drawn / (drawn + left), left / (drawn + left)
    inner = (x > 0) & (x < n)
    at, of = np.where(inner, x, 1.0), np.where(inner, n, 2.0)
    p1, q1 = np.where(inner, p, 0.5), np.where(inner, q, 0.5)
    middle = _stirling_rest(of) - _stirling_rest(at) - _stirling_rest(of - at) - _deviance(at, of * p1) - _deviance(of - at, of * q1) + 0.5 * np.log(of / (2 * np.pi * at * (of - at)))
    none, every = n * np.where(q > 0.5, np.log1p(-p), np.log(q)), n * np.where(p > 0.5, np.log1p(-q), np.log(p))
    return np.where(inner, middle, np.where(n == 0, 0.0, np.where(x == 0, none, every)))


@np.errstate(divide="ignore", invalid="ignore")
def log_chance(k: np.ndarray, near: np.ndarray, rest: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """log C(near, k) C(rest, draws - k) / C(near + rest, draws); the counts are whole numbers as doubles.

    Three binomial probabilities of the chance draws / places.  None is a difference of large logarithms, so what
    is lost does not grow with the number of places.
    """
    left = near + rest - draws
    fits = (k >= 0) & (k <= near) & (draws - k >= 0) & (draws - k <= rest) & (left >= 0)
    k, near, rest, draws, left = (np.where(fits, v, d) for v, d in ((k, 1.0), (near, 2.0), (rest, 2.0), (draws, 2.0), (left, 2.0)))
    certain = (draws == 0) | (left == 0)  # one outcome only
    d, f = np.where(certain, 1.0, draws), np.where(certain, 1.0, left)
    log = _log_binomial(k, near, d, f) + _log_binomial(draws - k, rest, d, f) - _log_binomial(draws, near + rest, d, f)
    return np.where(fits, np.where(certain, 0.0, log), -np.inf)


def _series(k: np.ndarray, near: np.ndarray, rest: np.ndarray, draws: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sum of the chances from ``k`` on, away from the mean, as a multiple of the first; all rows at once, in chunks of terms."""
    total, term, at = np.ones(len(k)), np.ones(len(k)), k.copy()
    alive, width = np.arange(len(k)), 32
    while len(alive):
        n, r, m, u = (v[alive, None] for v in (near, rest, draws, up))
        d = at[alive, None] + np.where(u, 1, -1) * np.arange(width)
        ratio = np.where(u, (n - d) * (m - d) / ((d + 1) * (r - m + d + 1)), d * (r - m + d) / ((n - d + 1) * (m - d + 1)))
        terms = term[alive, None] * np.cumprod(np.maximum(ratio, 0.0), axis=1)
        total[alive] += terms.sum(axis=1)
        term[alive] = terms[:, -1]
        at[alive] += np.where(up[alive], width, -width)
        alive = alive[term[alive] > total[alive] * 1e-19]
        width = int(min(2 * width, max(32, (1 << 20) // max(len(alive), 1))))
    return total


@np.errstate(divide="ignore", invalid="ignore", over="ignore")
def upper(near: np.ndarray, rest: np.ndarray, draws: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chance that ``first`` or more of ``draws`` fall on the ``near`` places; beyond the mean a sum of positive terms."""
    low, high = np.maximum(0.0, draws - rest), np.minimum(near, draws)
    inside = (first > low) & (first <= high)
    k, n, r, m = (np.where(inside, v, d) for v, d in ((first, 1.0), (near, 1.0), (rest, 1.0), (draws, 1.0)))
    up = k > m * n / (n + r)
    start = np.where(up, k, k - 1)
    part = np.exp(log_chance(start, n, r, m) + np.log(_series(start, n, r, m, up)))
    return np.where(inside, np.where(up, part, 1 - part), np.where(first > high, 0.0, 1.0))


@np.errstate(divide="ignore", invalid="ignore", under="ignore")
def _few_and_many(n0: np.ndarray, n1: np.ndarray, n2: np.ndarray, b1: np.ndarray, b2: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Chance of at most ``b1`` draws on the first kind of places and more than ``b2`` on the second.

    Summed over the draws d on the first kind, downwards: each is a ratio times the one before, and with one draw
    more left for the other places, more than b2 of the second kind come up if they did before, or if b2 had
    and the new draw is of the second kind.  All that is added is positive.
    """
    others = n0 + n2
    d = np.minimum(np.minimum(b1, n1), draws - b2)
    total, alive, width = np.zeros(len(d)), np.flatnonzero((d >= 0) & (n2 > b2)), 32
    log_first = log_chance(d, n1, others, draws)
    left = draws - d
    many, log_at = upper(n2, n0, left, b2 + 1), log_chance(b2, n2, n0, left)
    mean = draws * n1 / np.maximum(n1 + others, 1)
    while len(alive):
        k = d[alive, None] - np.arange(width)
        m0, m1, m2, c2, o = (v[alive, None] for v in (n0, n1, n2, b2, others))
        m = draws[alive, None] - k
        fewer = np.maximum(k * (o - m) / ((m1 - k + 1) * (m + 1)), 0.0)
        stay = np.maximum((m + 1) * (m0 - m + c2) / ((m + 1 - c2) * np.maximum(o - m, 1)), 0.0)
        logs = log_first[alive, None] + np.cumsum(np.log(fewer), axis=1)
        ats = log_at[alive, None] + np.cumsum(np.log(stay), axis=1)
        before = np.hstack([log_at[alive, None], ats[:, :-1]])
        grown = many[alive, None] + np.cumsum(np.where(m < o, np.exp(before) * (m2 - c2) / np.maximum(o - m, 1), 0.0), axis=1)
        total[alive] += (np.exp(np.hstack([log_first[alive, None], logs[:, :-1]])) * np.hstack([many[alive, None], grown[:, :-1]])).sum(axis=1)
        log_first[alive], log_at[alive], many[alive] = logs[:, -1], ats[:, -1], np.minimum(grown[:, -1], 1.0)
        d[alive] -= width
        done = (d < 0) | ((d < mean) & (np.exp(log_first) * (d + 1) <= total * 1e-18))
        alive = alive[~done[alive]]
        width = int(min(2 * width, max(32, (1 << 20) // max(len(alive), 1))))
    return total


def tails(n0, n1, n2, b1, b2, total_b, total) -> np.ndarray:
    """``tail`` of whole arrays of parameters."""
    given = [np.asarray(v, np.int64) for v in (n0, n1, n2, b1, b2, total_b, total)]
    out = np.ones(len(given[0]))
    odd = given[0] < 0
    for k in np.flatnonzero(odd & (given[6] <= EXACT)):
        out[k] = _generalised(*(int(v[k]) for v in given))
    alone = ~odd & (given[5] <= given[6]) & ((given[3] == 0) | (given[4] == 0))
    if alone.any():
        n0, n1, n2, b1, b2, total_b, total = (v[alone].astype(float) for v in given)
        near, seen = np.where(b2 == 0, n1, n2), np.where(b2 == 0, b1, b2)
        other = n1 + n2 - near
        # All but fewer of this kind and none of the other: any of the other, or none of it and enough of this.
        out[alone] = upper(other, near + n0, total_b, np.ones(len(near))) + np.exp(log_chance(np.zeros(len(near)), other, near + n0, total_b)) * upper(near, n0, total_b, seen)
    both = ~odd & (given[5] <= given[6]) & (given[3] > 0) & (given[4] > 0)
    if both.any():
        n0, n1, n2, b1, b2, total_b, total = (v[both].astype(float) for v in given)
        # More of the first kind, or no more of it but more of the second, or just what was seen.
        seen = np.exp(log_chance(b1, n1, n0 + n2, total_b) + log_chance(b2, n2, n0, total_b - b1))
        out[both] = upper(n1, n0 + n2, total_b, b1 + 1) + _few_and_many(n0, n1, n2, b1, b2, total_b) + seen
    return np.where(odd, out, np.minimum(out, 1.0))


@lru_cache(maxsize=200_000)
def tail(n0: int, n1: int, n2: int, b1: int, b2: int, total_b: int, total: int) -> float:
    """Probability of at least the observed interactions of B with A.

    ``total`` places without A, of which ``n1`` touch A once, ``n2`` lie between two and ``n0`` neither; ``total_b``
    of them hold B, ``b1`` and ``b2`` are those next to and between A.  With one kind observed, its upper tail
    counts.  With both, everything counts but what has no more of either and less of one.  With more neighbours
    than places there is no such probability: up to ``EXACT`` places the formula's value is given, beyond it 1.
    """
    return float(tails(*([v] for v in (n0, n1, n2, b1, b2, total_b, total)))[0])


_PARAMETERS = ["n0", "n1", "n2", "b1", "b2", "total_b", "total"]


def _with_tails(rows: DataFrame) -> DataFrame:
    """(a, b, pval); equal parameters are worked out once."""

    @F.pandas_udf("double")
    def worked_out(n0: pd.Series, n1: pd.Series, n2: pd.Series, b1: pd.Series, b2: pd.Series, total_b: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(tails(n0, n1, n2, b1, b2, total_b, total), dtype=float)

    kinds = rows.select(_PARAMETERS).distinct().withColumn("pval", worked_out(*_PARAMETERS))
    return rows.join(kinds, _PARAMETERS).select("a", "b", "pval")


def _parameters(pairs: DataFrame, nodes: DataFrame, total: DataFrame) -> DataFrame:
    a = nodes.select(F.col("gene").alias("a"), F.col("cnt").alias("cnt_a"), "n1", "n2")
    b = nodes.select(F.col("gene").alias("b"), F.col("cnt").alias("total_b"))
    rows = pairs.join(a, "a").join(b, "b").join(F.broadcast(total))  # one row
    rows = rows.withColumn("total", F.col("n") - F.col("cnt_a"))
    return rows.withColumn("n0", F.col("total") - F.col("n1") - F.col("n2"))


def adjacency_pvalues(clusters: DataFrame) -> DataFrame:
    """(a, b, pval) of all directed pairs that are neighbours somewhere."""
    return _with_tails(_parameters(interactions.adjacency_pairs(clusters), interactions.adjacency_nodes(clusters), interactions.adjacency_total(clusters)))


def colocation_pvalues(clusters: DataFrame) -> DataFrame:
    """(a, b, pval) of all directed pairs that share a basket."""
    nodes = interactions.colocation_nodes(clusters).withColumn("n2", F.lit(0).cast("long"))
    pairs = interactions.colocation_pairs(clusters).withColumn("b2", F.lit(0).cast("long"))
    return _with_tails(_parameters(pairs, nodes, interactions.colocation_total(clusters)))


def harmonic(n: int) -> float:
    """Sum of 1 / i up to n."""
    if n < 1_000_000:
        return math.fsum(1 / i for i in range(1, n + 1))
    return math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n)


def adjusted(rows: DataFrame) -> DataFrame:
    """Adds ``adj``: Benjamini-Yekutieli adjusted ``pval``.

    With the p-values in order, ``adj`` is the least of ``p * n * c(n) / rank`` from a row on, at most 1.  Ranks and
    minima are worked out within the runs of a distributed sort, then carried over by one row for each run.
    """
    runs = sorted_runs(rows, "pval", "a", "b")
    ends = run_offsets(runs)
    n = int(ends.join(runs.groupBy("_run").count(), "_run").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    ranked = runs.join(F.broadcast(ends), "_run").withColumn("_v", F.col("pval") * F.lit(n * harmonic(n) if n else 0.0) / (F.col("_before") + F.col("_place") + 1))
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy("_run").agg(F.min("_v").alias("_m")).select("_run", F.min("_m").over(later).alias("_later"))
    on = Window.partitionBy("_run").orderBy("_place").rowsBetween(0, Window.unboundedFollowing)
    out = ranked.withColumn("_here", F.min("_v").over(on)).join(F.broadcast(least), "_run")
    return out.withColumn("adj", F.least(F.lit(1.0), F.col("_here"), F.coalesce("_later", F.lit(1.0)))).select(*rows.columns, "adj")


def both_directions(rows: DataFrame) -> DataFrame:
    """(g1, g2, pval): the larger adjusted p-value of the two directions of a pair; both must be there."""
    pairs = rows.groupBy(F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2"))
    return pairs.agg(F.max("adj").alias("pval"), F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")


def combined(*kinds: DataFrame) -> DataFrame:
    """(g1, g2, pval): the smallest p-value of a pair over several kinds of interaction."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.groupBy("g1", "g2").agg(F.min("pval").alias("pval"))


def interaction_edges(clusters: DataFrame) -> DataFrame:
    """(g1, g2, pval) of all pairs of genes, g1 < g2, from adjacency and co-location; the baskets are worked out once."""
    clusters = cut(clusters.select("bgc_id", "genes"))
    return combined(both_directions(adjusted(adjacency_pvalues(clusters))), both_directions(adjusted(colocation_pvalues(clusters))))
