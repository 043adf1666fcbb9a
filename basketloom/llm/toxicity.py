"""Toxicity from a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits that stand for letters) and matched against the lexicon
with an Aho-Corasick automaton.  Entries are whole words or stems (a stem matches at the start of a word).
A hit inside an exception phrase does not count.  The summed weights, with and without normalisation by
length, go through a fitted logistic curve.

The lexicon is what a bounded sample of labelled documents teaches: every word (of any length up to ``LONGEST``) and
stem that stands in ``LEAST`` toxic documents or more, with the logarithm of how much more often it stands in toxic
documents than in clean ones, each counted as a share of its class, as its weight; weights of ``LIGHTEST`` or less are
left out.  Phrases of an entry and the word before or after it that are at home in clean documents become exceptions.
The curve is fitted to signals of documents under lexicons that were learned without them.

Nulls, empty tables and odd rows: a null text counts as empty, and an empty text has no hit; its score is
that of a text without hits.  Rows without id are scored, never learned from; ids may be of any type, and of
rows that share one a single row is learned from.  Without labelled rows the lexicon is empty and every score
that of a text without hits, with fixed curve parameters.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .holdout import attach, labelled_sample
from .store import scratch, written
from .textblocks import column_of

#: Labelled documents of each class that the lexicon and the curve are fitted on, at most.
PER_CLASS = 3000
#: Letters of the longest word that may be an entry, and of stems.
LONGEST, STEMS = 64, (5, 6)
#: Documents that an entry or exception must stand in, and the weight that an entry must exceed.
LEAST, LIGHTEST = 4, 1.2
#: A missed toxic document counts as so many false alarms when the curve is fitted.
MISSED = 2.0
#: Parts of the sample that are scored by a lexicon learned from the others.
FOLDS = 4

#: Phrases that take the sting away from words that may be entries, beside those learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "trash bag", "taking out the trash", "circus clown")

WORD = re.compile(r"[^\W_]+")


def fold_table() -> dict[int, str]:
    """Code points to the letters that they are read as, on top of lower-casing."""
    import unicodedata

    table = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:  # accents and full-width forms
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base.isascii() and base.isalnum():
            table[c] = base
    # Cyrillic and Greek letters that look like Latin ones.
    for shapes, letters in (("аеорсухіѕјԁһ", "aeopcyxisjdh"), ("АВЕКМНОРСТХ", "abekmhopctx"), ("αορντικευ", "aopvtikeu"), ("ΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "abehikmnoptxyz")):
        table |= {ord(a): b for a, b in zip(shapes, letters)}
    # Digits and signs read as letters.
    table |= {ord(a): b for a, b in zip("013457@$", "oieastas")}
    table |= {c: chr(c + 32) for c in range(65, 91)}
    return table


_FOLD = fold_table()


def fold(text: str) -> str:
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """Weights of entries; a stem ends in ``*``.  ``curve`` is (intercept, sum, largest, density)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float, float] = (-4.0, 1.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        found: dict[str, list[tuple[bool, float]]] = {}
        for entry, weight in self.weights.items():
            found.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), weight))
        for phrase in self.exceptions:
            found.setdefault(fold(phrase), []).append((False, 0.0))
        for text, kinds in found.items():
            made.add_word(text, (len(text), kinds))
        if found:
            made.make_automaton()
        return made


def signals(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """(summed weight, largest weight, summed weight over the square root of the distinct words) of one text."""
    if not text or not len(automaton):
        return 0.0, 0.0, 0.0
    text = fold(text)
    hits: list[tuple[int, int, float]] = []
    spared: list[tuple[int, int]] = []
    n = len(text)
    for last, (size, kinds) in automaton.iter(text):
        first = last - size + 1
        if first and text[first - 1].isalnum():
            continue
        whole = last + 1 == n or not text[last + 1].isalnum()
        for stem, weight in kinds:
            if stem or whole:
                if weight:
                    hits.append((first, last, weight))
                else:
                    spared.append((first, last))
    if spared:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
    if not hits:
        return 0.0, 0.0, 0.0
    at: dict[str, float] = {}
    for first, _, weight in hits:  # a word counts once, with its largest weight, however often it stands
        word = WORD.match(text, first).group()
        at[word] = max(weight, at.get(word, 0.0))
    total = sum(at.values())
    return total, max(at.values()), total / (1 + len(set(text.split()))) ** 0.5


def tokens(text: str) -> set[str]:
    """Folded words of a text and the stems of its words."""
    found = set(WORD.findall(fold(text)))
    words = {w for w in found if len(w) <= LONGEST}
    return words | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


def weight(n0: int, n1: int, clean: int, toxic: int) -> float:
    """log of how much more often than in clean documents a token stands in toxic ones, each as a share of its class."""
    return float(np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1)))


def phrases(text: str, entries: set[str]) -> set[str]:
    """Folded pairs of words, one space between them, of which one matches an entry."""
    text = fold(text)
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    hit = [w in entries or any(w[:k] + "*" in entries for k in STEMS if len(w) > k) for _, _, w in words]
    return {f"{a[2]} {b[2]}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if (x or y) and text[a[1] : b[0]] == " "}


def _counts(found: Callable[[str], set[str]]) -> Callable:
    """(token, fold, n0, n1): clean and toxic documents of a task that hold a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for y, k, text in zip(*(column_of(batch, c).to_pylist() for c in ("y", "fold", "text"))):
                for token in found(text or ""):
                    counts.setdefault((token, k), [0, 0])[y] += 1
        if counts:
            tokens_, folds = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(tokens_), pa.array(folds, pa.int32()), *(pa.array([c[y] for c in counts.values()], pa.int64()) for y in (0, 1))], names=["token", "fold", "n0", "n1"])

    return run


def learned(counts: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, float]:
    """Entries and weights from (clean, toxic) documents by token, and of all."""
    found = {t: weight(*n, *sizes) for t, n in counts.items() if n[1] >= LEAST}
    return {t: w for t, w in found.items() if w > LIGHTEST}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, missed: float = MISSED) -> tuple[float, float, float, float]:
    """Logistic regression by Newton steps; rows of class 1 count ``missed`` times."""
    a = np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), x[:, 1], x[:, 2]])
    w, keep, times = np.zeros(4), np.diag([1e-3, ridge, ridge, ridge]), np.where(y > 0, missed, 1.0)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (times * p * (1 - p))[:, None]) + keep, a.T @ (times * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _signals(automata_of: Callable[[], list[ahocorasick.Automaton]], kept: list[str], by: str | None = None) -> Callable:
    """The signals of each text under the only automaton, or under that which column ``by`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automata_of()
        for batch in batches:
            texts = map(str, column_of(batch, "text").fill_null("").to_pylist())
            which = column_of(batch, by).to_pylist() if by else [0] * batch.num_rows
            found = np.array([signals(t, made[k]) for t, k in zip(texts, which)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, k) for k in kept), *map(pa.array, found.T)], names=[*kept, "total", "largest", "density"])

    return run


def train(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS) -> Lexicon:
    """A lexicon from the labelled rows that pass ``keep`` (a bounded sample of them)."""
    with scratch(documents.sparkSession):
        return _train(documents, labels, keep, per_class)


def _train(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int) -> Lexicon:
    rows = attach(documents, labelled_sample(labels, "toxic", keep, per_class), "text")
    sample = written(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")).select("y", "fold", "text"), "sample")
    # What is collected is bounded, as the sample is.
    sizes = np.zeros((FOLDS, 2), int)
    for r in sample.groupBy("fold", "y").count().collect():
        sizes[r["fold"], r["y"]] = r["count"]

    def counted(found: Callable[[str], set[str]], side: str) -> dict[str, np.ndarray]:
        """Documents by fold and class of the tokens that ``LEAST`` documents of a class hold."""
        rows = sample.mapInArrow(_counts(found), "token string, fold int, n0 long, n1 long").groupBy("token", "fold").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        rows = rows.groupBy("token").agg(F.sum(side).alias("n"), F.collect_list(F.struct("fold", "n0", "n1")).alias("x")).filter(F.col("n") >= LEAST)
        out: dict[str, np.ndarray] = {}
        for r in rows.orderBy("token").collect():
            out[r["token"]] = np.zeros((FOLDS, 2), int)
            for x in r["x"]:
                out[r["token"]][x["fold"]] = x["n0"], x["n1"]
        return out

    def lexicon(used: list[int]) -> Lexicon:
        of = lambda counts: {t: n[used].sum(0) for t, n in counts.items()}
        clean, toxic = sizes[used].sum(0)
        at_home = [p for p, n in of(around).items() if n[0] >= LEAST and weight(*n, clean, toxic) <= 0]
        return Lexicon(learned(of(counts), (clean, toxic)), EXCEPTIONS + tuple(at_home))

    counts, folds = counted(tokens, "n1"), list(range(FOLDS))
    entries = {t for used in (folds, *([j for j in folds if j != k] for k in folds)) for t in learned({t: n[used].sum(0) for t, n in counts.items()}, sizes[used].sum(0))}
    around = counted(lambda text: phrases(text, entries), "n0") if entries else {}
    made, parts = lexicon(folds), [lexicon([j for j in folds if j != k]) for k in folds]
    automata = lambda: [p.automaton() for p in parts]
    seen = sample.mapInArrow(_signals(automata, ["y"], "fold"), "y int, total double, largest double, density double").toPandas()
    if seen["y"].nunique() == 2:
        seen = seen.sort_values(list(seen.columns), kind="stable")
        made.curve = fit_curve(seen[["total", "largest", "density"]].to_numpy(), seen["y"].to_numpy(float))
    return made


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, the three signals and ``score`` of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    out = documents.select("doc_id", "text").mapInArrow(_signals(lambda: [shared.value.automaton()], ["doc_id"]), f"doc_id {kind}, total double, largest double, density double")
    c = lexicon.curve
    margin = c[0] + c[1] * F.log1p("total") + c[2] * F.col("largest") + c[3] * F.col("density")
    return out.withColumn("score", 1 / (1 + F.exp(-margin)))
