"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to order ``ORDER`` is counted over training texts and then frozen.
The probability of a byte in a context is the longest context's estimate where the byte was seen there, else
the escape probability times the estimate of the next shorter context (escape method C: distinct successors
over occurrences plus distinct successors); a byte that was never seen takes eight bits beyond the last escape.
The code length of a text is the sum over its bytes; the language with the shortest code wins.  Only ASCII letters
are lower-cased and white space made one byte; all other bytes count as they are, so any script has its contexts.

Since the statistics are frozen, the escapes can be followed once for every context and byte that some language
has seen, and the trees of several languages unfolded into hash tables: for each order the code lengths of
every byte string seen under all languages, and the escapes of every context.  A lookup ends at the longest string that any
language has seen.  Every language named in the training documents is learned; their tables are shared and
compared in passes of ``LANGUAGES`` at most.

Nulls, empty tables and odd rows: a text that is null or holds no letter gets ``und`` with score 0.  Rows
without id or language are never learned from.  Without any training text every row is ``und``.  Equal code
lengths go to the language first in code point order.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import scratch, written
from .textblocks import LOWER, SPACE, U64, blocks, column_of, mix

#: Bytes of the longest context.
ORDER = 4
#: Training documents of each language, and bytes of them, at most; languages whose tables are held at once, at most.
PER_LANGUAGE, TRAIN_BYTES, LANGUAGES = 400, 2_000_000, 8
#: Code lengths are kept as 16-bit integers of this many steps to a bit.
STEPS = 1024
BLANK = 0x20
NORMAL = np.where(SPACE, BLANK, LOWER).astype(np.uint8)


class Table:
    """Rows of numbers by key; a key without a row has one of zeros."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        mixed = mix(keys)
        order = np.argsort(mixed)
        self.keys = mixed[order]
        self.rows = np.concatenate([rows[order], np.zeros((1, rows.shape[1]), rows.dtype)])
        self.bits = max(4, len(keys).bit_length() + 1)
        self.starts = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << U64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the rows, or -1.  Mixed keys are spread evenly, so a few steps from where their first bits begin find each."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        wanted = mix(keys)
        at = self.starts[(wanted >> U64(64 - self.bits)).astype(np.int64)]
        todo = np.arange(len(keys))
        while len(todo):
            inside = at < len(self.keys)
            if not inside.all():
                todo, at, wanted = todo[inside], at[inside], wanted[inside]
            have = self.keys[at]
            hit = have == wanted
            out[todo[hit]] = at[hit]
            more = have < wanted
            todo, at, wanted = todo[more], at[more] + 1, wanted[more]
        return out


@dataclass
class Model:
    languages: list[str]
    strings: list[Table]  # by order: code lengths of strings of order + 1 bytes
    escapes: list[Table]  # by order: code lengths of the escapes of contexts of so many bytes


def strings(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte of texts the ``ORDER`` bytes before it and itself, as one number; texts are preceded by white space."""
    s = NORMAL[data].astype(np.uint64)
    out = s.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(s), BLANK, np.uint64)
        before[k:] = s[:-k] if len(s) > k else BLANK
        for j in range(k):  # the first bytes of a text do not see the text before
            at = offs[:-1] + j
            before[at[at < offs[1:]]] = BLANK
        out |= before << U64(8 * k)
    return out


def last_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return x & U64((1 << 8 * n) - 1)


def fit(texts: list[tuple[str, str]]) -> Model:
    """Trees of the languages of (language, text) pairs."""
    languages = sorted({lang for lang, _ in texts})
    seen = []
    for lang in languages:
        raw = [t.encode() for k, t in texts if k == lang and t]
        seen.append(strings(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)))
    # Of bytes that a language has never seen: eight bits.
    below, lower = np.arange(256, dtype=np.uint64), np.full((256, len(languages)), 8 * STEPS)
    model = Model(languages, [], [])
    for order in range(ORDER + 1):
        found = [np.unique(last_bytes(x, order + 1), return_counts=True) for x in seen]
        keys = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint64)
        if not order:
            keys = below
        counts = np.zeros((len(keys), len(languages)))
        for j, (k, n) in enumerate(found):
            counts[np.searchsorted(keys, k), j] = n
        contexts, first, place = np.unique(keys >> U64(8), return_index=True, return_inverse=True)
        n, d = (np.add.reduceat(x, first) if len(first) else x for x in (counts, (counts > 0).astype(float)))
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(d > 0, np.log2((n + d) / d) * STEPS, 0).round().astype(np.int64)
            own = (np.log2((n + d)[place] / np.maximum(counts, 0.5)) * STEPS).round().astype(np.int64)
        # Whole steps throughout, so that a sum is the same whichever languages share the tables.
        bits = np.where(counts > 0, own, escape[place] + lower[np.searchsorted(below, last_bytes(keys, max(order, 1)))])
        model.strings.append(Table(keys, np.minimum(bits, 65535).astype(np.uint16)))
        model.escapes.append(Table(contexts, escape.astype(np.uint16)))
        below, lower = keys, bits
    return model


def lengths(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code length in bits of each text under each language."""
    out = np.zeros((len(offs) - 1, len(model.languages)))
    if not len(data):
        return out
    x = strings(data, offs)
    place = model.strings[ORDER].find(x)
    rows = model.strings[ORDER].rows[place].astype(np.int32)
    todo = np.flatnonzero(place < 0)
    for order in range(ORDER, 0, -1):
        if not len(todo):
            break
        rest = x[todo]
        escapes, shorter = model.escapes[order], model.strings[order - 1]
        rows[todo] += escapes.rows[escapes.find(last_bytes(rest >> U64(8), order))]
        place = shorter.find(last_bytes(rest, order))
        rows[todo] += shorter.rows[place]
        todo = todo[place < 0]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    for k in range(rows.shape[1]):
        out[full, k] = np.add.reduceat(rows[:, k], offs[:-1][full], dtype=np.int64) / STEPS
    return out


def train(documents: DataFrame, keep: Column, per_language: int = PER_LANGUAGE, most_bytes: int = TRAIN_BYTES) -> list[Broadcast]:
    """Shared trees of all languages, in groups, from a bounded sample of the documents that pass ``keep`` and name a language.

    Of each language the ``per_language`` documents with the smallest hashes of their ids are taken, as long
    as they make up at most ``most_bytes``; of a text over an eighth of that only the beginning is learned from.
    """
    with scratch(documents.sparkSession):
        return _train(documents, keep, per_language, most_bytes)


def _train(documents: DataFrame, keep: Column, per_language: int, most_bytes: int) -> list[Broadcast]:
    known = documents.filter(keep & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # A threshold on the hash leaves about the wanted number of rows of each language, without a sort.
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), 1.3 * per_language / F.count(F.lit(1))).alias("share"))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    picked = known.join(F.broadcast(shares), "lang").filter(unit < F.col("share"))
    # A character has four bytes at most, so no text takes more than an eighth of the bound.
    picked = picked.withColumn("text", F.when(F.octet_length("text") > most_bytes // 8, F.substring("text", 1, most_bytes // 32)).otherwise(F.col("text")))
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    picked = picked.withColumn("place", F.row_number().over(place)).withColumn("upto", F.sum(F.octet_length("text")).over(place))
    picked = picked.filter((F.col("place") <= per_language) & ((F.col("place") == 1) | (F.col("upto") <= most_bytes))).select("lang", "doc_id", "text")
    picked = written(picked, "picked")
    languages = sorted(r["lang"] for r in picked.select("lang").distinct().collect())
    groups = [languages[k : k + LANGUAGES] for k in range(0, len(languages), LANGUAGES)]

    def texts(group: list[str]) -> list[tuple[str, str]]:
        got = picked.filter(F.col("lang").isin(group)).collect()
        return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"], r["text"]))]

    return [documents.sparkSession.sparkContext.broadcast(fit(texts(g))) for g in groups or [[]]]


def predict(documents: DataFrame, models: list[Broadcast]) -> DataFrame:
    """doc_id, ``lang_pred``, ``score`` and ``bits_per_byte`` of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if len(models) == 1:
        return rows.mapInArrow(_predictor(models[0], ("doc_id",)), f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    passes = [rows.mapInArrow(_predictor(m, ("doc_id", "row")), f"doc_id {kind}, row long, lang_pred string, score double, bits_per_byte double") for m in models]
    # The best of each pass; its score is the inverse of the pass's sum of probabilities over the best one.
    found = reduce(DataFrame.unionByName, passes).join(rows.select("row", F.octet_length("text").alias("size")), "row")
    bits = F.round(F.col("bits_per_byte") * F.greatest("size", F.lit(1)) * STEPS) / STEPS
    found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.collect_list(F.struct(F.coalesce(bits, F.lit(0.0)).alias("bits"), "lang_pred", "score", "bits_per_byte")).alias("x"))
    found = found.withColumn("best", F.array_min("x"))
    ratio = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.when(x["score"] > 0, F.pow(F.lit(2.0), F.col("best.bits") - x["bits"]) / x["score"]).otherwise(0.0))
    return found.select("doc_id", "best.lang_pred", F.when(ratio > 0, 1 / ratio).otherwise(0.0).alias("score"), "best.bits_per_byte")


def _predictor(shared: Broadcast, kept: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            lettered = column_of(batch, "lettered").to_numpy(zero_copy_only=False)
            ids = [column_of(batch, k) for k in kept]
            for lo, hi, b in blocks(column_of(batch, "text"), 1 << 20):
                known = lettered[lo:hi] & bool(model.languages)
                if model.languages:
                    bits = lengths(model, b.data, b.offs)
                    best = bits.argmin(1)
                    least = bits[np.arange(b.n), best]
                    # Posterior of the best language under equal priors.
                    sure = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
                    rate = least / np.maximum(np.diff(b.offs), 1)
                else:
                    best, sure, rate = np.zeros(b.n, int), np.zeros(b.n), np.zeros(b.n)
                pred = names[np.where(known, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in ids), pa.array(pred, pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(np.where(known, rate, 0.0))], names=[*kept, "lang_pred", "score", "bits_per_byte"])

    return run
