"""Quality rules as weak supervision.

Each rule votes good (1), bad (0) or abstains (2) on a document.  Expectation-maximisation over the counts of
vote patterns estimates the rules' accuracies and the share of good documents; the posterior probability of
"good" replaces an all-rules-must-pass filter.  The patterns number at most 3**rules, whatever the input, so
what reaches the driver is bounded, and the estimate uses every document.

Nulls, empty tables and odd rows: a null or empty text has no words and fails the base rule; its row is kept
with zero counts.  Repeated rows are rated alike.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docstats import BASE, all_stats
from .store import written
from .textblocks import blocks, column_of

GOOD, BAD, ABSTAIN = 1, 0, 2

#: name -> (good where, bad where); a rule abstains elsewhere.  Arguments are per-document arrays.
RULES = {
    "length": (lambda s: s["n_words"] >= 60, lambda s: s["n_words"] < 30),
    "word_length": (lambda s: s["mean_word"].clip(3, 10) == s["mean_word"], lambda s: (s["mean_word"] < 2) | (s["mean_word"] > 14)),
    "symbols": (lambda s: s["symbols"] <= 0.02, lambda s: s["symbols"] > 0.1),
    "dup_lines": (lambda s: s["dup_lines"] <= 0.1, lambda s: s["dup_lines"] > 0.3),
    "repeats": (lambda s: s["repeats"] <= 0.1, lambda s: s["repeats"] > 0.35),
    "alpha_words": (lambda s: s["alpha_words"] >= 0.9, lambda s: s["alpha_words"] < 0.7),
    "upper": (lambda s: s["upper"] <= 0.2, lambda s: s["upper"] > 0.5),
    "exclaim": (lambda s: s["exclaim"] <= 0.05, lambda s: s["exclaim"] > 0.2),
    "symbol_words": (lambda s: s["symbol_words"] <= 0.02, lambda s: s["symbol_words"] > 0.15),
    "diversity": (lambda s: s["same_next"] <= 0.02, lambda s: s["same_next"] > 0.1),
}


def ratios(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    return s | {
        "mean_word": s["word_chars"] / words,
        "symbols": s["n_symbols"] / words,
        "dup_lines": s["n_dup_lines"] / lines,
        "repeats": s["n_repeat_words"] / words,
        "alpha_words": s["n_alpha_words"] / words,
        "upper": s["n_upper"] / np.maximum(s["n_alpha"], 1),
        "exclaim": s["n_exclaim"] / words,
        "symbol_words": s["n_symbol_words"] / words,
        "same_next": s["n_same_next"] / words,
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Pattern number of each document: its votes as digits of base 3."""
    s, code = ratios(s), np.zeros(len(s["n_words"]), np.int64)
    for good, bad in RULES.values():
        code = code * 3 + np.where(good(s), GOOD, np.where(bad(s), BAD, ABSTAIN))
    return code


def digits(code: np.ndarray) -> np.ndarray:
    """Votes of each pattern, one column for each rule."""
    n = len(RULES)
    return code[:, None] // 3 ** np.arange(n - 1, -1, -1) % 3


def fit(code: np.ndarray, count: np.ndarray, rounds: int = 200, prior: float = 0.85) -> dict:
    """Accuracies of the rules and share of good documents from counts of vote patterns.

    ``vote[y, j, v]`` is the probability that rule ``j`` gives vote ``v`` on a document of class ``y``.  Some
    pseudo-counts keep rare votes from probabilities of 0, and a "bad" vote stays at least 20 times as
    likely on bad documents as on good ones, which fixes the meaning of the two classes.  An empty input
    returns the starting values.
    """
    v, weight = digits(code), count.astype(float)
    start = np.array([[0.35, 0.5, 0.15], [0.01, 0.9, 0.09]])  # class bad, class good; votes bad, good, abstain
    vote = np.repeat(start[:, None, :], v.shape[1], 1)
    for _ in range(rounds if len(code) else 0):
        p = posterior(v, vote, prior)
        new = np.empty_like(vote)
        for y, q in ((0, (1 - p) * weight), (1, p * weight)):
            seen = np.stack([((v == k) * q[:, None]).sum(0) for k in (BAD, GOOD, ABSTAIN)], 1) + 2 * start[y]
            new[y] = seen / seen.sum(1, keepdims=True)
        least = 20 * new[1, :, BAD]
        short = new[0, :, BAD] < least
        new[1, short, BAD] = np.maximum(new[0, short, BAD] / 20, 1e-6)
        share = float(np.clip((p * weight).sum() / weight.sum(), 0.5, 0.98))
        done = np.abs(new - vote).max() < 1e-9 and abs(share - prior) < 1e-9
        vote, prior = new, share
        if done:
            break
    return {"vote": vote, "prior": prior}


def posterior(v: np.ndarray, vote: np.ndarray, prior: float) -> np.ndarray:
    """Probability of "good" for each row of votes."""
    odds = np.log(prior / (1 - prior)) + np.take_along_axis(np.log(vote[1] / vote[0])[None], v[:, :, None], 2)[:, :, 0].sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column_of(batch, "doc_id")
        for lo, hi, b in blocks(column_of(batch, "text")):
            s = all_stats(b)
            arrays = [pa.array(s[k].astype(np.int64)) for k in BASE] + [pa.array(votes(s))]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *arrays], names=["doc_id", *BASE, "pattern"])


def rate(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``posterior`` and ``kept`` of every document."""
    spark = documents.sparkSession
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in (*BASE, "pattern"))
    rated = written(documents.select("doc_id", "text").mapInArrow(_rate, schema), "rated")
    counts = rated.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3**rules rows
    code, n = (np.array([r[k] for r in counts], np.int64) for k in ("pattern", "n"))
    model = fit(code, n)
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(code, posterior(digits(code), **model))], "pattern long, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rated.join(F.broadcast(table), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))
        .select("doc_id", *BASE, "base_failed", "kept", "posterior")
    )
