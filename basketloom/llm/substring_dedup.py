"""Substring deduplication by phrases looked up in indexed reference blocks.

This stands in for a greedy relative Lempel-Ziv parse of every document against every reference block, whose cost
grows with the square of the corpus (README has figures); the repeated windows found are the same.

A window is ``WINDOW`` consecutive words of one document.  Every word covered by a window whose word sequence
also starts anywhere else goes.

Reference.  Each window has an anchor: of its ``SEED``-word grams the one with the smallest hash.  Consecutive
windows with the same anchor form a phrase: the words that they cover.  Equal windows have equal anchors at
equal places, so two texts share a window only through phrases with the same anchor gram.  All phrases of the
corpus, dealt by the hash of their anchors, are the indexed reference blocks.

Parsing.  A text is cut at its phrases and each is looked up in its block.  A phrase that occurs there again as
a whole is a factor: all its windows are duplicates.  Where the anchor occurs again but the phrase does not
(the factor ends inside it), the windows of the phrases of that anchor are compared one by one: the check at
factor boundaries.  Together the two find exactly the repeated windows.

Two passes over the texts.  The first counts anchors and phrases; the second sends on only what the bounded
sieve of repeated anchors lets through.  Words, grams and phrases are told apart by 64-bit hashes; texts by md5.

Nulls, empty tables and odd rows: null and short texts have no window and lose nothing.  All work is by text,
so ids may be null or repeat; a text that stands in two rows is a duplicate of itself.  Equal grams within a
text are told apart by position (leftmost smallest).  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sieve
from .sieve import Sieve
from .store import numbered, scratch, written
from .textblocks import Block, U64, blocks, column_of, gram_fits, gram_hashes, mix, powers

WINDOW, SEED = 35, 8
PLACES = WINDOW - SEED + 1  # grams in a window


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


class Phrases:
    """Phrases of a block: text, first window, number of windows, anchor and phrase hashes."""

    def __init__(self, b: Block):
        words = b.word_hashes()
        self.words = words
        at = np.flatnonzero(gram_fits(b, WINDOW))
        if not len(at):
            self.first = self.count = np.zeros(0, np.int64)
            self.anchor = self.phrase = np.zeros(0, np.uint64)
            self.doc = np.zeros(0, np.int64)
            return
        grams = gram_hashes(words, SEED)
        ranked = (grams >> U64(31) << U64(31)) | np.arange(len(grams), dtype=np.uint64)
        owner = (_sliding_min(ranked, PLACES)[at] & U64((1 << 31) - 1)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        self.first = at[start]
        self.count = np.diff(np.append(start, len(at)))
        self.anchor = grams[owner[start]]
        up, down = powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        end = self.first + self.count + WINDOW - 1
        shape = (self.count * 64 + (owner[start] - self.first)).astype(np.uint64)
        self.phrase = mix((sums[end] - sums[self.first]) * down[self.first] + mix(shape))
        self.doc = np.searchsorted(b.wo, self.first, side="right") - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, phrase, n) of a batch."""
    for batch in batches:
        for _, _, b in blocks(column_of(batch, "text")):
            p = Phrases(b)
            order = np.lexsort((p.phrase, p.anchor))
            a, f = p.anchor[order], p.phrase[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (f[1:] != f[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([_signed(a[at]), _signed(f[at]), pa.array(np.diff(np.append(at, len(a))))], names=["anchor", "phrase", "n"])


def _listed(sieves: tuple[Sieve, Sieve]) -> Callable:
    """Phrases that the sieves let through; with their windows where the anchor has several phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, several = (s.load() for s in sieves)
        for batch in batches:
            keys = column_of(batch, "text_key")
            for lo, _, b in blocks(column_of(batch, "text")):
                p = Phrases(b)
                at = np.flatnonzero(sieve.may_hold(repeated, p.anchor))
                if not len(at):
                    continue
                first, count, doc = p.first[at], p.count[at], p.doc[at]
                many = sieve.may_hold(several, p.anchor[at])
                windows = gram_hashes(p.words, WINDOW)
                size = np.where(many, count, 0)
                inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), _signed(windows[inside]))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + lo)), pa.array((first - b.wo[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), _signed(p.anchor[at]), _signed(p.phrase[at]), lists],
                    names=["text_key", "first", "n_windows", "anchor", "phrase", "windows"],
                )

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeats(documents: DataFrame) -> DataFrame:
    """(text_key, cuts) of the texts that hold repeated windows.

    ``cuts`` lists structs (first, n_windows, mask): bit ``i`` of the mask says that the window at word
    ``first + i`` is repeated.
    """
    with scratch(documents.sparkSession) as keep:
        return keep(_repeats(documents))


def _repeats(documents: DataFrame) -> DataFrame:
    texts = documents.select("text").filter(F.octet_length("text") >= 2 * WINDOW - 1)
    counted = texts.mapInArrow(_counted, "anchor long, phrase long, n long")
    seen = counted.groupBy("anchor").agg(F.sum("n").alias("n"), (F.min("phrase") != F.max("phrase")).alias("several"))
    anchors = written(seen.filter("n > 1").select("anchor", "several"), "anchors")
    sizes = anchors.agg(F.count(F.lit(1)), F.count_if("several")).first()
    sieves = sieve.build(anchors, "anchor", sizes[0]), sieve.build(anchors.filter("several"), "anchor", sizes[1])
    # Texts alike give phrases alike: a phrase stands once for each text here, with the number of its rows.
    keyed = texts.withColumn("text_key", text_key(F.col("text")))
    listed = written(
        keyed.mapInArrow(_listed(sieves), "text_key binary, first int, n_windows int, anchor long, phrase long, windows array<long>"),
        "phrases",
    )
    totals = written(listed.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")), "totals")
    # Check at the factor boundaries: windows of one example of each phrase of anchors with several phrases.
    examples = listed.filter(F.size("windows") > 0).dropDuplicates(["phrase"]).select("phrase", F.posexplode("windows").alias("place", "window"))
    weighed = written(examples.join(totals, "phrase"), "windows")
    again = written(weighed.groupBy("window").agg(F.sum("n").alias("times")).filter("times > 1").select("window"), "again")
    bit = F.expr("shiftleft(1L, place)")
    partial = weighed.join(again, "window").groupBy("phrase").agg(F.bit_or(bit).alias("mask"))
    whole = F.lit((1 << 62) - 1)
    masks = totals.join(partial, "phrase", "left").select("phrase", F.when(F.col("n") > 1, whole).otherwise(F.col("mask")).alias("mask")).filter("mask is not null")
    masks = written(masks, "masks")
    cuts = listed.select("text_key", "first", "n_windows", "phrase").join(masks, "phrase").select("text_key", F.struct("first", "n_windows", "mask").alias("cut"))
    return written(cuts.groupBy("text_key").agg(F.collect_set("cut").alias("cuts")), "cuts")


def covered(n_words: int, cuts: list[dict]) -> np.ndarray:
    """Which of a text's words its repeated windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for c in cuts:
        for i in range(c["n_windows"]):
            if c["mask"] >> i & 1:
                edge[c["first"] + i] += 1
                edge[min(n_words, c["first"] + i + WINDOW)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept_words(b: Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by one space (the last one of a text only if one was there), and offsets."""
    kept = ~gone
    data = b.data.copy()
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, b.ws[kept], 1)
    np.add.at(mark, b.we[kept], -1)
    take = np.cumsum(mark[:-1]).astype(bool)
    after = b.we[kept]
    ends = b.offs[1:][b.word_doc()[kept]]
    after = after[after < ends]
    data[after] = 0x20
    take[after] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(take, out=sums[1:])
    return data[take], sums[b.offs]


def _finisher(kept: list[str], with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = column_of(batch, "cuts")
            yield from _finished(batch, cuts, kept, with_text)

    return run


def _uncut(cut: Sieve, kept: list[str], with_text: bool) -> Callable:
    """Finishes the texts that certainly hold no repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = cut.load()
        for batch in batches:
            sure = ~sieve.may_hold(keys, column_of(batch, "key").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(sure))
            yield from _finished(batch, pa.nulls(batch.num_rows), kept, with_text)

    return run


def _perhaps_cut(cut: Sieve) -> Callable:
    """The rows of all other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = cut.load()
        for batch in batches:
            yield batch.filter(pa.array(sieve.may_hold(keys, column_of(batch, "key").to_numpy(zero_copy_only=False))))

    return run


def _finished(batch: pa.RecordBatch, cuts: pa.Array, kept: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for lo, hi, b in blocks(column_of(batch, "text")):
        gone = np.zeros(len(b.ws), bool)
        for i in np.flatnonzero(np.asarray(cuts.slice(lo, hi - lo).is_valid())):
            gone[b.wo[i] : b.wo[i + 1]] = covered(int(b.wo[i + 1] - b.wo[i]), cuts[lo + int(i)].as_py())
        removed = b.per_text_words(gone)
        out = [column_of(batch, k).slice(lo, hi - lo) for k in kept]
        names = [*kept, "n_words", "n_removed"]
        out += [pa.array(b.n_words.astype(np.int64)), pa.array(removed)]
        if with_text:
            originals = column_of(batch, "text").slice(lo, hi - lo)
            if removed.any():
                originals = pa.array([t if not r else _cut(b, i, gone) for i, (t, r) in enumerate(zip(originals.to_pylist(), removed))], pa.string())
            out.append(originals)
            names.append("kept_text")
        else:
            data, offs = _kept_words(b, gone)
            raw = data.tobytes()
            out.append(pa.array([hashlib.sha256(raw[x:y].removesuffix(b" ")).hexdigest() for x, y in zip(offs[:-1], offs[1:])], pa.string()))
            names.append("kept_sha256")
        yield pa.RecordBatch.from_arrays(out, names=names)


def _cut(b: Block, i: int, gone: np.ndarray) -> str:
    """Text ``i`` without its removed words and the white space after each of them."""
    words = np.arange(b.wo[i], b.wo[i + 1])
    out, at = [], b.offs[i]
    for k in words[gone[words]]:
        out.append(b.data[at : b.ws[k]])
        at = b.ws[k + 1] if k + 1 < b.wo[i + 1] else b.offs[i + 1]
    out.append(b.data[at : b.offs[i + 1]])
    return np.concatenate(out).tobytes().decode()


def _applied(rows: DataFrame, kept: list[str], result: str) -> DataFrame:
    """``kept`` columns and results of all ``rows`` (with ``text``).

    Only the texts that a bounded sieve of those with repeated windows lets through are shuffled to meet their cuts.
    """
    with scratch(rows.sparkSession) as keep:
        found = keep(written(_repeats(rows.select("text")).withColumn("key", F.xxhash64("text_key")), "found"))
        cut = sieve.build(found, "key", found.count())
        keep(found, cut.path)
    rows = rows.select(*dict.fromkeys([*kept, "text"]), F.xxhash64(text_key(F.col("text"))).alias("key"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept)
    schema = ", ".join([fields, "n_words long, n_removed long", result])
    with_text = result.startswith("kept_text")
    through = rows.mapInArrow(_perhaps_cut(cut), rows.schema).withColumn("text_key", text_key(F.col("text")))
    met = through.join(found.drop("key"), "text_key", "left").mapInArrow(_finisher(kept, with_text), schema)
    return rows.mapInArrow(_uncut(cut, kept, with_text), schema).unionByName(met)


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    return _applied(documents.select("doc_id", "text"), ["doc_id"], "kept_sha256 string")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they were but for ``text`` and (where there is one) ``n_chars``, its length.

    A text loses its repeated words and the white space after each; a document that loses all its words goes.
    Columns may bear any name.
    """
    place = [c.lower() for c in documents.columns].index("text")
    kept = [f"c{k}" for k in range(len(documents.columns)) if k != place]
    rows = _applied(numbered(documents).withColumnRenamed(f"c{place}", "text"), kept, "kept_text string").filter("n_removed = 0 OR n_removed < n_words")
    out = []
    for k, name in enumerate(documents.columns):
        value = F.col("kept_text" if k == place else f"c{k}")
        if name.lower() == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(documents.schema[name].dataType)).otherwise(value)
        out.append(value.alias(name))
    return rows.select(out)
