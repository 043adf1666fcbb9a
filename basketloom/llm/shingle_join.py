"""N-gram Jaccard self-join: documents whose sets of word 5-grams overlap by 75 % or more, and their groups.

The overlap of all pairs is the product of the document by n-gram incidence matrix with its transpose.  It is
taken in blocks of n-gram columns, and size-derived bounds rule pairs out before their overlap is complete:

*   Equal sets are one row of the matrix (a class); only one of its documents takes part.
*   Columns are put in one order (frequent n-grams last, by two levels of frequency).  A pair that reaches the threshold shares an n-gram
    among the first ``n - ceil(0.75 n) + 1`` of each of its documents, and from the first shared one on both
    have enough n-grams left.  Pairs without such an entry, or too different in size, are dropped.
*   Products are summed to full overlap counts only for the pairs left, and compared exactly.

What is wanted are groups, so a column does not give all its pairs at once.  It first gives those of its most
central document with the others; once their links are joined to components, only columns that still hold
several components give pairs, and only pairs across components.  No pair of documents in different components
stays untested, so no link between groups is lost, and a group of copies costs in proportion to its size.

Products across components are taken block by block.  Columns that share their largest component lie in the same
block, so that the n-grams which two documents share are summed where they are found, and pairs that cannot reach
the threshold even if they share all that they have elsewhere are dropped there.  Where such columns have more than
``BLOCK_ENTRIES`` entries, their documents are cut, each two cuts in a block.

All n-grams of all classes are counted once, sent as differences of sorted 40-bit hashes.  Bounded sieves of
those found at least 2, ``OFTEN`` and ``VERY_OFTEN`` times keep entries that no other document has from being
shuffled, and set the order.  They only save work: any content of theirs gives the same result.  Beyond some ten
million shared n-grams they let more and more through, and every entry of a prefix (a quarter of the n-grams) is
shuffled: linear in the input still.  N-grams and classes are told apart by 64-bit hashes.

Nulls, empty tables and odd rows: texts that are null or wordless have no n-grams and link with nothing; fewer
than five words form one n-gram.  Rows without id, or with repeated ids, take part like others; the smallest
non-null id names a group (null if there is none).  Rows alike are in one class.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sieve
from .components import components
from .sieve import Sieve
from .store import free_name, scratch, written
from .textblocks import Block, U64, blocks, column_of, gram_fits, gram_hashes, mix, powers

N = 5
#: N-grams of so many classes come later in the order, and last.
OFTEN, VERY_OFTEN = 4, 32
#: About so many entries meet in one task that counts them.
PART_ENTRIES = 2_000_000


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts of a block, sorted within each, and their offsets."""
    words = b.word_hashes(lower=True)
    at = np.flatnonzero(gram_fits(b, N))
    doc = b.word_doc()
    hashes, owner = (gram_hashes(words, N)[at], doc[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < N))
    if len(short):
        up, down = powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        whole = mix((sums[b.wo[short + 1]] - sums[b.wo[short]]) * down[b.wo[short]] + b.n_words[short].astype(np.uint64))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.argsort(hashes)
    # Then stably by text: a radix sort as long as the texts of a block number at most 65536.
    order = order[np.argsort(owner[order].astype(np.uint16 if b.n <= 1 << 16 else np.int64), kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(b.n + 1))


def class_ids(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ U64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[offs[1:]] - sums[offs[:-1]] + np.diff(offs).astype(np.uint64))


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def levels(hashes: np.ndarray, sieves: list[np.ndarray]) -> np.ndarray:
    """How many of the sieves of frequent n-grams hold each."""
    out = np.zeros(len(hashes), np.uint8)
    for s in sieves:
        out += sieve.may_hold(s, hashes >> U64(24))
    return out


def prefixes(hashes: np.ndarray, offs: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, n-gram) of the prefix of each set, in the order (level, hash); and where each prefix ends in that order."""
    n = np.diff(offs)
    row = np.repeat(np.arange(len(n)), n)
    if level.any():
        order = np.argsort(row * 4 + level, kind="stable")
        hashes, level = hashes[order], level[order]
    place = np.arange(len(hashes)) - offs[row]
    take = place < prefix_size(n)[row]
    ends = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    at = offs[full] + prefix_size(n[full]) - 1
    ends[full] = hashes[at] >> U64(3) | level[at].astype(np.uint64) << U64(61)
    return row[take], place[take], hashes[take], ends


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signatures(kept: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in blocks(column_of(batch, "text")):
                hashes, offs = shingles(b)
                n = np.diff(offs)
                cid = pa.array(class_ids(hashes, offs).view(np.int64), mask=n == 0)
                yield pa.RecordBatch.from_arrays([*(column_of(batch, k).slice(lo, hi - lo) for k in kept), cid, pa.array(n.astype(np.int64))], names=[*kept, "cid", "n"])

    return run


class _Once:
    """Texts of a task that speak for their class: may be its example, and the first of it here."""

    def __init__(self, examples: Sieve):
        self.examples, self.seen = examples.load(), set()

    def __call__(self, tags: pa.Array, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        take = sieve.may_hold(self.examples, tags.to_numpy(zero_copy_only=False).astype(np.int64)) & (n > 0)
        for k in np.flatnonzero(take):
            cid = int(ids[k])
            if cid in self.seen:
                take[k] = False
            self.seen.add(cid)
        return take


def _subset(hashes: np.ndarray, offs: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offs)
    return hashes[np.repeat(take, n)], np.append(0, np.cumsum(n[take]))


def _coded(tokens: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte position: the high bytes are nearly all zero and compress away."""
    return np.diff(tokens, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T[:6].tobytes()


def _decoded(raw: memoryview) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.reshape(-1).view(np.uint64))


def _entries(examples: Sieve, parts: int) -> Callable:
    """N-grams of a task, by part of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, held, size = _Once(examples), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.sort(np.concatenate(held) >> U64(24))
            cuts = np.searchsorted(tokens, np.arange(parts + 1, dtype=np.uint64) * U64(-(-(1 << 40) // parts)))
            for p in range(parts):
                if cuts[p] < cuts[p + 1]:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_coded(tokens[cuts[p] : cuts[p + 1]])], pa.binary())], names=["part", "tokens"])

        for batch in batches:
            for lo, hi, b in blocks(column_of(batch, "text")):
                hashes, offs = shingles(b)
                take = once(column_of(batch, "tag").slice(lo, hi - lo), class_ids(hashes, offs), np.diff(offs))
                held.append(_subset(hashes, offs, take)[0])
                size += len(held[-1])
                if size > 2_500_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams that stand in several entries, and how often.  A task has all entries of its parts, part by part."""

    def found(tokens: list[np.ndarray]) -> pa.RecordBatch:
        kinds, counts = np.unique(np.concatenate(tokens), return_counts=True)
        again = counts > 1
        return pa.RecordBatch.from_arrays([_signed(kinds[again]), pa.array(counts[again].astype(np.int32))], names=["token", "n"])

    part, held = None, []
    for batch in batches:
        for p, raw in zip(column_of(batch, "part").to_pylist(), column_of(batch, "tokens")):
            if p != part and held:
                yield found(held)
                held = []
            part = p
            held.append(_decoded(raw.as_buffer()))
    if held:
        yield found(held)


def _postings(examples: Sieve, counted: list[Sieve]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once(examples)
        repeated, *frequent = (s.load() for s in counted)
        for batch in batches:
            for lo, hi, b in blocks(column_of(batch, "text")):
                hashes, offs = shingles(b)
                ids = class_ids(hashes, offs)
                take = once(column_of(batch, "tag").slice(lo, hi - lo), ids, np.diff(offs))
                ids = ids[take]
                hashes, offs = _subset(hashes, offs, take)
                row, place, token, ends = prefixes(hashes, offs, levels(hashes, frequent))
                live = sieve.may_hold(repeated, token >> U64(24))
                row, place, token = row[live], place[live], token[live]
                n = np.diff(offs)
                count = np.bincount(row, minlength=len(n))
                central = count * 1000 // np.maximum(prefix_size(n), 1)
                reach = np.zeros(len(n), np.int64)
                np.maximum.at(reach, row, n[row] - place)
                numbers = (pa.array(x.astype(np.int32)) for x in (n[row], n[row] - place, central[row], count[row], reach[row]))
                yield pa.RecordBatch.from_arrays([_signed(token), _signed(ids[row]), *numbers, _signed(ends[row])], names=["token", "cid", "n", "left", "central", "live", "reach", "ends"])

    return run


def _packed(chosen: Sieve, classes: Sieve) -> Callable:
    """Whole sets of the wanted classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, wanted = chosen.load(), classes.load()
        for batch in batches:
            for lo, hi, b in blocks(column_of(batch, "text")):
                hashes, offs = shingles(b)
                ids = class_ids(hashes, offs)
                tags = column_of(batch, "tag").slice(lo, hi - lo)
                at = np.flatnonzero(sieve.may_hold(wanted, ids) & (np.diff(offs) > 0) & sieve.may_hold(examples, tags.to_numpy(zero_copy_only=False).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([_signed(ids[at]), tags.take(pa.array(at)), pa.array([hashes[offs[k] : offs[k + 1]].tobytes() for k in at], pa.binary())], names=["cid", "tag", "grams"])

    return run


#: About so many entries make a cut of the columns that share their largest component.
BLOCK_ENTRIES = 100_000
#: Entries of a block that are held at once; a longer one is taken in stretches.
BLOCK_HELD = 300_000
#: Products of entries that are worked out at once, and pairs that a task holds before it passes them on.
_AT_ONCE, _HELD = 1 << 18, 1 << 20


class _Pairs:
    """Pairs of classes and how many columns of a block they share; ``more`` is how many others they may share elsewhere."""

    names = ("a", "b", "a_n", "b_n", "a_ends", "b_ends", "shared", "near")
    schema = "a long, b long, a_n int, b_n int, a_ends long, b_ends long, shared long, near boolean"

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, block: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray, *columns: np.ndarray) -> None:
        self.parts.append((block, a, b, more, *columns))
        self.size += len(a)

    def merge(self) -> None:
        if not self.parts:
            return
        block, a, b, *rest, shared, near = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(mix(mix(a.view(np.uint64)) + b.view(np.uint64)) + block.view(np.uint64))
        block, a, b, shared, near = block[order], a[order], b[order], shared[order], near[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (block[1:] != block[:-1]))) if len(a) else np.zeros(0, np.int64)
        sums = (np.add.reduceat(shared, first), np.logical_or.reduceat(near, first)) if len(first) else (shared, near)
        self.parts = [(block[first], a[first], b[first], *(c[order[first]] for c in rest), *sums)]
        self.size = len(first)

    def finished(self) -> None:
        """Drops pairs that fall short even if they share all that is left elsewhere, and forgets the blocks."""
        self.merge()
        if self.parts:
            block, a, b, more, n, m, ends, other, shared, near = self.parts[0]
            keep = 7 * (shared + more + _rest(n, m, ends, other)) >= 3 * (n + m)
            self.parts = [tuple(c[keep] for c in (np.zeros_like(block), a, b, np.zeros_like(more), n, m, ends, other, shared, near))]
            self.size = int(keep.sum())

    def taken(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not last and self.size <= _HELD:
            return
        self.merge()
        if self.parts and (last or self.size > _HELD // 2):
            _, a, b, _, *columns = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, *columns)], names=list(self.names))
            self.parts, self.size = [], 0


def _rest(n: np.ndarray, m: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """At most so many n-grams that two sets share are not in both prefixes: those past the prefix that ends first."""
    past, beyond = n - prefix_size(n), m - prefix_size(m)
    return np.where(ends < other, past, np.where(ends > other, beyond, np.maximum(past, beyond)))


def _possible(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size-derived bounds that hold of a pair in every column alike.

    Sizes must be near enough; from the first n-gram that others may have, both must have enough left; and the most
    that the prefixes can share, with what the one that ends first has past its prefix, must be enough.
    """
    n, m = x["n"][i], x["n"][j]
    rest = _rest(n, m, x["ends"][i], x["ends"][j])
    most = np.minimum(np.minimum(x["live"][i], x["live"][j]) + rest, np.minimum(x["reach"][i], x["reach"][j]))
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (7 * most >= 3 * (n + m))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components within the columns of each block; rows come sorted by (block, token)."""
    names = ("block", "token", "own", "within", "cid", "n", "left", "live", "reach", "ends", "comp")
    held, done, rest = _Pairs(), _Pairs(), None

    def products(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Of whole columns, best of whole blocks."""
        count = len(x["cid"])
        if not count:
            return
        order = np.argsort(mix(x["cid"].view(np.uint64)) + x["block"].view(np.uint64))
        new = np.append(True, (x["cid"][order[1:]] != x["cid"][order[:-1]]) | (x["block"][order[1:]] != x["block"][order[:-1]]))
        here = np.empty(count, np.int64)
        sizes = np.diff(np.append(np.flatnonzero(new), count))
        here[order] = np.repeat(sizes, sizes)
        left = x["live"] - here  # entries of the class in other blocks, at most
        # A column's entries by component: each meets those of the components after its own, and none of its own.
        new = np.append(True, (x["token"][1:] != x["token"][:-1]) | (x["block"][1:] != x["block"][:-1]))
        column = np.cumsum(new)
        order = np.lexsort((x["comp"], column))
        x, left = {c: v[order] for c, v in x.items()}, left[order]
        stop = np.searchsorted(column, column, side="right")
        run = np.flatnonzero(np.append(True, (column[1:] != column[:-1]) | (x["comp"][1:] != x["comp"][:-1])))
        past = np.repeat(np.append(run[1:], count), np.diff(np.append(run, count)))
        others = stop - past
        upto = np.cumsum(others)
        lo = 0
        while lo < count:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - others[lo] + _AT_ONCE, side="right")))
            n = others[lo:hi]
            i = np.repeat(np.arange(lo, hi), n)
            j = past[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            lo = hi
            take = np.flatnonzero(x["within"][i] | (x["own"][i] != x["own"][j]))
            i, j = i[take], j[take]
            take = _possible(x, i, j)
            i, j = i[take], j[take]
            i, j = np.where(x["cid"][i] < x["cid"][j], i, j), np.where(x["cid"][i] < x["cid"][j], j, i)
            near = 7 * np.minimum(x["left"][i], x["left"][j]) >= 3 * (x["n"][i] + x["n"][j])
            held.add(x["block"][i], x["cid"][i], x["cid"][j], np.minimum(left[i], left[j]), x["n"][i], x["n"][j], x["ends"][i], x["ends"][j], np.ones(len(i), np.int64), near)
            yield from held.taken(False)
        held.finished()
        for part in held.parts:
            done.add(*part)
        held.parts, held.size = [], 0
        yield from done.taken(False)

    for batch in batches:
        x = {c: column_of(batch, c).to_numpy(zero_copy_only=False) for c in names}
        if rest is not None:
            x = {c: np.concatenate([rest[c], x[c]]) for c in names}
        ends = np.flatnonzero(x["block"][1:] != x["block"][:-1])
        whole = int(ends[-1]) + 1 if len(ends) else 0  # the last block may go on in the next batch
        if len(x["cid"]) - whole > BLOCK_HELD:  # any whole columns will do, only fewer pairs are dropped here
            ends = np.flatnonzero(x["token"][1:] != x["token"][:-1])
            whole = int(ends[-1]) + 1 if len(ends) else 0
        yield from products({c: v[:whole] for c, v in x.items()})
        rest = {c: v[whole:] for c, v in x.items()}
    if rest is not None:
        yield from products(rest)
    yield from done.taken(True)


def reaches(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets overlap by 75 % of their union or more."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = column_of(batch, "grams_a"), column_of(batch, "grams_b")
        ok = [reaches(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([column_of(batch, "a"), column_of(batch, "b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def _within_bounds(x: str, y: str) -> Column:
    """Size-derived bounds: sizes near enough, and enough n-grams left from the shared one on."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)) & (7 * F.least(F.col(f"{x}.left"), F.col(f"{y}.left")) >= 3 * (nx + ny))


def _ordered(x: str, y: str) -> list[Column]:
    """a and b, the classes in order, with their sizes and prefix ends."""
    side = lambda k: F.struct(*(F.col(f"{k}.{c}").alias(c) for c in ("cid", "n", "ends")))
    a, b = F.least(side(x), side(y)), F.greatest(side(x), side(y))
    return [q[c].alias(name + tail) for q, name in ((a, "a"), (b, "b")) for c, tail in (("cid", ""), ("n", "_n"), ("ends", "_ends"))]


def _may_reach(shared: str) -> Column:
    """Size-derived bound on pairs whose prefixes share so many n-grams.

    An n-gram that both sets have but not both prefixes lies past the prefix that ends first, so the overlap is at
    most the shared ones plus what that set has past its prefix.
    """
    past = lambda n: F.floor((3 * F.col(n) + 3) / 4) - 1
    rest = F.when(F.col("a_ends") < F.col("b_ends"), past("a_n")).when(F.col("a_ends") > F.col("b_ends"), past("b_n")).otherwise(F.greatest(past("a_n"), past("b_n")))
    return 7 * (F.col(shared) + rest) >= 3 * (F.col("a_n") + F.col("b_n"))


class Join:
    """The steps of the join over one table; ``signatures`` has a row for each document."""

    def __init__(self, documents: DataFrame, *extra: str):
        self.spark = documents.sparkSession
        text = F.coalesce(F.col("text"), F.lit(""))
        columns = list(dict.fromkeys(["doc_id", *extra]))
        tag = F.xxhash64(F.col("doc_id"), text).alias("tag")
        self.texts = documents.select(text.alias("text"), tag).filter("text != ''")
        fields = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in columns)
        self.signatures = written(
            documents.select(*columns, tag, text.alias("text")).mapInArrow(_signatures([*columns, "tag"]), f"{fields}, tag long, cid long, n long"),
            "signatures",
        )
        examples = self.signatures.filter("cid is not null").groupBy("cid").agg(F.min("tag").alias("tag"), F.max("n").alias("n"))
        self.examples = written(examples, "examples")
        totals = self.examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.classes, self.entries = totals
        self.example_sieve = sieve.build(self.examples, "tag", self.classes)

    def postings(self) -> DataFrame:
        """Prefix entries that some other document may have too: (token, cid, n, left, central, live, reach, ends).

        ``n`` is the set's size, ``left`` how many n-grams it has from this one on, ``live`` how many of its prefix
        others may have, ``central`` their share, ``reach`` the ``left`` of the first of them, ``ends`` where its
        prefix ends in the order of columns.
        """
        parts = max(16, int(self.entries) // PART_ENTRIES)
        entries = self.texts.mapInArrow(_entries(self.example_sieve, parts), "part int, tokens binary")
        again = written(entries.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_repeated, "token long, n int"), "repeated")
        sieves = []
        for least in (2, OFTEN, VERY_OFTEN):
            rows = again.filter(F.col("n") >= least)
            sieves.append(sieve.build(rows, "token", rows.count()))
        return written(self.texts.mapInArrow(_postings(self.example_sieve, sieves), "token long, cid long, n int, left int, central int, live int, reach int, ends long"), "postings")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of pairs (a, b) of classes, by their full overlap."""
        pairs = written(pairs.select("a", "b"), "pairs")
        both = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
        both = written(both.join(self.examples, "cid").select("cid", "tag"), "wanted")
        wanted = sieve.build(both, "cid", both.count())
        # Rows alike may give a class more than once here; then its pairs repeat, which does no harm.
        sets = self.texts.mapInArrow(_packed(self.example_sieve, wanted), "cid long, tag long, grams binary")
        sets = written(sets.join(both, ["cid", "tag"], "left_semi").drop("tag"), "sets")
        one = pairs.join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("grams_b")), "b")
        two = one.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("grams_a")), "a")
        return written(two.mapInArrow(_verify, "a long, b long, linked boolean"), "verified")

    def labels(self) -> DataFrame:
        """(node, comp) of the classes that have links."""
        rows = self.postings()
        # Each column's most central document against the others; overlaps within the prefixes are then summed for these pairs.
        heads = rows.groupBy("token").agg(F.max(F.struct("central", "n", "cid", "left", "ends")).alias("head"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo != hi").select("token", "head.*")
        heads = written(heads, "heads")
        pairs = rows.alias("x").join(heads.alias("y"), "token").filter((F.col("x.cid") != F.col("y.cid")) & _within_bounds("x", "y")).select(*_ordered("x", "y")).distinct()
        pairs = written(pairs, "candidates")
        entries = rows.select("cid", "token")
        met = pairs.select("a", "b").join(entries.withColumnRenamed("cid", "b"), "b").join(entries.withColumnRenamed("cid", "a"), ["a", "token"])
        shared = written(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "shared")
        first = self.verified(pairs.join(shared, ["a", "b"]).filter(_may_reach("shared")))
        rest = self._across(self._open(rows, components(first.filter("linked")))).join(first.select("a", "b"), ["a", "b"], "left_anti")
        return components(first.unionByName(self.verified(rest)).filter("linked"))

    def _across(self, rows: DataFrame) -> DataFrame:
        """(a, b) of classes in different components whose overlap within their prefixes lets them reach the threshold."""
        cuts = (1 + F.floor(F.col("entries") / BLOCK_ENTRIES)).cast("int")
        rows = rows.withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("cid"), "cuts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        block = F.xxhash64("lead", F.least("own", "other"), F.greatest("own", "other"))
        met = rows.select(block.alias("block"), "token", "own", (F.col("own") == F.col("other")).alias("within"), "cid", "n", "left", "live", "reach", "ends", "comp")
        found = met.repartition("block").sortWithinPartitions("block", "token").mapInArrow(_met, _Pairs.schema)
        sums = found.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("a_n", "b_n", "a_ends", "b_ends", "near")), F.sum("shared").alias("shared"))
        return written(sums.filter("near").filter(_may_reach("shared")).select("a", "b"), "rest")

    def _open(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Entries of the columns that still hold several components: with the component of each, the column's largest one, and the entries of all columns that share it."""
        sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        labels = labels.join(sizes, "comp").withColumnRenamed("node", "cid")
        named = rows.select("token", "cid", "n", "left", "live", "reach", "ends").join(labels, "cid", "left").withColumns({"comp": F.coalesce("comp", "cid"), "size": F.coalesce("size", F.lit(1))})
        named = written(named, "named")
        several = named.groupBy("token").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.max(F.struct("size", "comp"))["comp"].alias("lead"), F.min("n").alias("least"), F.max("n").alias("most")
        )
        # Two entries of sizes too far apart have no product.
        several = written(several.filter("lo != hi AND (m > 2 OR 4 * least >= 3 * most)").select("token", "m", "lead"), "several")
        several = several.join(several.groupBy("lead").agg(F.sum("m").alias("entries")), "lead").select("token", "lead", "entries")
        return written(named.drop("size").join(several, "token"), "open")

    def groups(self) -> DataFrame:
        """The signatures with ``comp``, a label of the group (null without n-grams)."""
        labels = self.labels()
        rows = self.signatures.filter("cid is not null").join(labels.select(F.col("node").alias("cid"), "comp"), "cid", "left")
        none = self.signatures.filter("cid is null").withColumn("comp", F.lit(None).cast("long"))  # not to one task of the join
        return written(rows.withColumn("comp", F.coalesce("comp", "cid")).unionByName(none), "groups")


def _groups(documents: DataFrame) -> DataFrame:
    with scratch(documents.sparkSession) as keep:
        return keep(Join(documents).groups())


def component_ids(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = _groups(documents)
    least = written(rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    out = rows.filter("comp is not null").join(least, "comp").unionByName(rows.filter("comp is null").withColumn("least", F.lit(None).cast(rows.schema["doc_id"].dataType)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they were, with one of each group: that with the smallest id.

    Of rows alike in id and text one stays; documents without n-grams all stay.  Columns may bear any name.
    """
    rows = _groups(documents)
    tag, empty = (free_name(documents.columns, c) for c in ("tag", "wordless"))
    chosen = rows.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("first"))
    chosen = written(chosen.select(F.col("first.tag").alias(tag)), "chosen")
    text = F.coalesce(F.col("text"), F.lit(""))
    tagged = documents.withColumn(tag, F.xxhash64(F.col("doc_id"), text)).withColumn(empty, ~text.rlike(r"[^\x20\x09-\x0D]"))
    stay = tagged.filter(~F.col(empty)).join(chosen, tag, "left_semi").dropDuplicates([tag])
    return stay.unionByName(tagged.filter(F.col(empty))).drop(tag, empty)
