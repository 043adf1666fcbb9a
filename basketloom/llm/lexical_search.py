"""Ranked lexical search with block-max pruning.

``build`` writes a forward index in blocks, each of a range of consecutive documents (a bounded number of bytes, or
one text): every document's terms and their counts, and for each term of the block the largest impact that it has in
any of the block's documents.  ``search`` takes a set of queries against all blocks.  A query's bound for a block is
the sum of its terms' weights times their largest impacts: no document of the block scores more.

1. The documents that hold each query term are counted, which gives the terms' weights.
2. Every task works out the bounds of its blocks and names the best few for each query; the best of all tasks are
   scored, and a query's tenth score so far becomes its threshold.
3. Every task takes the blocks it is handed in the order of their bounds for each query and scores whole blocks until
   the bound drops below the threshold, which rises as better documents turn up.  Blocks whose bound just equals it
   are scored, as a document with a smaller id may stand in them.

Queries are broadcast in passes of bounded size, each over all blocks.  Nothing is left out: the result is exact.

Terms are told apart by 64-bit hashes.  Nulls, empty tables and odd rows: a null text has no terms, and a document
without terms is neither counted nor found.  Item rows that share an id (null is one) are one query with the terms of
all; one without terms finds nothing.  Each document row counts by itself, whether ids repeat or not; a null doc_id
comes last among equal scores.  Ids may be of any type that orders.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import scratch, written
from .textblocks import Block, blocks, column_of

#: Bytes of text in a block (or one text).
BLOCK_TEXT = 1 << 18
#: Blocks scored for each query to get a threshold.
FIRST = 8
#: Queries, and their distinct terms in all, of one pass (or one query).
QUERIES_PER_PASS, TERMS_PER_PASS = 20_000, 500_000
#: Bounds (blocks times queries) held at once.
CELLS = 1 << 21

#: Bytes to what terms are made of: letters A-Z lower-cased, all that is in no term a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _FOLD[_lo : _hi + 1] = 0x20


def terms_only(column: pa.Array) -> pa.Array:
    """The texts with spaces for all bytes outside terms, so that words are terms."""
    column = column.fill_null("").cast(pa.large_string())
    _, offs, data = column.buffers()
    data = _FOLD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(column), offs, pa.py_buffer(data), offset=column.offset)


@dataclass(frozen=True)
class Index:
    """Blocks as a table, the number of documents with terms, and of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def lengths_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length adds: less than average counts for more."""
    return 25 + (75 * n * documents) // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


_TABLE = "block long, sizes binary, vocabulary binary, largest binary, holders binary, starts binary, terms binary, counts binary"


def pack_block(b: Block, documents: int, terms: int) -> dict[str, np.ndarray]:
    """The arrays of one block; ``terms`` and ``counts`` are of each document in turn, from ``starts`` on."""
    vocabulary, local = np.unique(b.word_hashes(), return_inverse=True)
    v = max(len(vocabulary), 1)
    keys, counts = np.unique(b.word_doc() * v + local, return_counts=True)
    doc, term = keys // v, keys % v
    sizes = b.n_words.astype(np.int64)
    held = impact(counts.astype(np.int64), lengths_factor(sizes, documents, terms)[doc])
    largest = np.zeros(len(vocabulary), np.int64)
    np.maximum.at(largest, term, held)
    return {
        "sizes": sizes, "vocabulary": vocabulary, "largest": largest.astype(np.int32), "holders": np.bincount(term, minlength=len(vocabulary)).astype(np.int32),
        "starts": np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int64), "terms": term.astype(np.uint32), "counts": counts.astype(np.uint32),
    }


def _builder(documents: int, terms: int, block_text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for lo, hi, b in blocks(terms_only(column_of(batch, "text")), block_text):
                arrays = pack_block(b, documents, terms)
                docs = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([ids.slice(lo, hi - lo)]))
                yield pa.RecordBatch.from_arrays([docs, pa.array([number], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays.values())], names=["docs", "block", *arrays])
                number += 1

    return run


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents with terms, their terms) of a task."""
    documents = terms = 0
    for batch in batches:
        column = terms_only(column_of(batch, "text"))
        _, offs, data = column.buffers()
        offs, solid = np.frombuffer(offs, np.int64)[column.offset :][: len(column) + 1], np.frombuffer(data, np.uint8) != 0x20
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        starts = offs[:-1][np.diff(offs) > 0]
        first[starts] = solid[starts]  # a term at the start of a text follows nothing
        held = np.diff(np.searchsorted(np.flatnonzero(first), offs))
        documents, terms = documents + int((held > 0).sum()), terms + int(held.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], names=["documents", "terms"])


def build(documents: DataFrame, block_text: int = BLOCK_TEXT) -> Index:
    """The index of all documents; its table belongs to the ``scratch`` around the call."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sizes = documents.select("text").mapInArrow(_count_terms, "documents long, terms long")
    n, total = sizes.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    made = documents.select("doc_id", "text").mapInArrow(_builder(n, total, block_text), f"docs array<{kind}>, {_TABLE}")
    return Index(written(made, "blocks"), n, total)


@dataclass
class Queries:
    """Queries of one pass.  The terms of query q are ``term[start[q] : start[q + 1]]``, places in ``vocabulary``."""

    ids: list
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: np.ndarray
    weight: np.ndarray | None = None  # of each entry: the term's weight times its repeats
    least: np.ndarray | None = None  # score below which no document is wanted

    def place(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of our terms: its place in a block's sorted vocabulary, and whether it is there."""
        at = np.searchsorted(vocabulary, self.vocabulary)
        at[at == len(vocabulary)] = 0
        return at, (vocabulary[at] == self.vocabulary) if len(vocabulary) else np.zeros(len(at), bool)

    def bounds(self, vocabulary: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """Of each query: what no document of the block can exceed."""
        at, there = self.place(vocabulary)
        most = np.where(there, largest[at] if len(largest) else 0, 0).astype(np.int64)
        return np.add.reduceat(self.weight * most[self.term], self.start[:-1])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column_of(batch, "item_id")
        for lo, _, b in blocks(terms_only(column_of(batch, "text"))):
            term, local = np.unique(b.word_hashes(), return_inverse=True)
            v = max(len(term), 1)
            keys, times = np.unique(b.word_doc() * v + local, return_counts=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + keys // v)), pa.array(term[keys % v].view(np.int64)), pa.array(times.astype(np.int64))], names=["item_id", "term", "times"])


def passes(items: DataFrame) -> Iterator[Queries]:
    """All queries in passes; items without terms are in none."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term long, times long")
    rows = written(rows.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "items")
    n, entries = rows.agg(F.count_distinct(F.struct("item_id")), F.count(F.lit(1))).first()
    number = max(1, -(-n // QUERIES_PER_PASS), -(-entries // TERMS_PER_PASS))
    for k in range(number):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(number)) == k) if number > 1 else rows
        found = part.orderBy("item_id", "term").collect()
        if found:
            item = [r["item_id"] for r in found]
            start = [k for k in range(len(item)) if k == 0 or item[k] != item[k - 1]]
            vocabulary, term = np.unique(np.array([r["term"] for r in found], np.int64).view(np.uint64), return_inverse=True)
            yield Queries([item[k] for k in start], np.array([*start, len(item)]), term, np.array([r["times"] for r in found], np.int64), vocabulary)


def _array(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column_of(batch, name)[row].as_buffer(), kind)


def _count_holders(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        total = np.zeros(len(queries.vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                vocabulary, holders = _array(batch, "vocabulary", row, np.uint64), _array(batch, "holders", row, np.int32)
                at, there = queries.place(vocabulary)
                total[there] += holders[at[there]]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    return run


def _best_blocks(shared) -> Callable:
    """(query, block, bound) of the ``FIRST`` best blocks of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        height = max(1, CELLS // len(queries.ids))
        best_bound, best_block = np.zeros((0, len(queries.ids)), np.int64), np.zeros((0, len(queries.ids)), np.int64)
        fresh: list[tuple[int, np.ndarray]] = []

        def settle():
            nonlocal best_bound, best_block
            bound = np.vstack([best_bound, *(b for _, b in fresh)])
            block = np.vstack([best_block, *(np.full(len(queries.ids), k) for k, _ in fresh)])
            if len(bound) > FIRST:
                top = np.argpartition(-bound, FIRST - 1, axis=0)[:FIRST]
                bound, block = np.take_along_axis(bound, top, 0), np.take_along_axis(block, top, 0)
            best_bound, best_block = bound, block
            fresh.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                fresh.append((column_of(batch, "block")[row].as_py(), queries.bounds(_array(batch, "vocabulary", row, np.uint64), _array(batch, "largest", row, np.int32))))
                if len(fresh) >= height:
                    settle()
        if fresh:
            settle()
        at, query = np.nonzero(best_bound)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best_block[at, query]), pa.array(best_bound[at, query])], names=["query", "block", "bound"])

    return run


class _Opened:
    """One block with the entries of all query terms, ready to be scored for any query."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries, documents: int, terms: int):
        self.queries = queries
        vocabulary, sizes = _array(batch, "vocabulary", row, np.uint64), _array(batch, "sizes", row, np.int64)
        at, there = queries.place(vocabulary)
        ours = np.full(len(vocabulary), -1, np.int64)
        ours[at[there]] = np.flatnonzero(there)
        starts, term = _array(batch, "starts", row, np.int64), ours[_array(batch, "terms", row, np.uint32)]
        held = np.flatnonzero(term >= 0)
        self.doc = np.repeat(np.arange(len(sizes)), np.diff(starts))[held]
        self.term, self.n = term[held], len(sizes)
        self.impact = impact(_array(batch, "counts", row, np.uint32)[held].astype(np.int64), lengths_factor(sizes, documents, terms)[self.doc])
        self.first = np.flatnonzero(np.diff(self.doc, prepend=-1))  # each document's first entry

    def score(self, q: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, their scores); ``weight`` is scratch space of zeros, one for each query term."""
        if not len(self.first):
            return self.first, self.first
        span = slice(self.queries.start[q], self.queries.start[q + 1])
        weight[self.queries.term[span]] = self.queries.weight[span]
        scores = np.add.reduceat(weight[self.term] * self.impact, self.first)
        weight[self.queries.term[span]] = 0
        return self.doc[self.first], scores


def _order(entry: tuple) -> tuple:
    return -entry[0], entry[1] is None, entry[1]


def _scorer(shared, documents: int, terms: int, k: int, id_type: pa.DataType, doc_type: pa.DataType) -> Callable:
    """(item_id, query, doc_id, score) of a task's best documents for each query.

    Rows may bring ``wanted``, the only queries to score; otherwise bounds decide, blocks of a batch in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        least, weight = queries.least.copy(), np.zeros(len(queries.vocabulary), np.int64)
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            given = "wanted" in batch.schema.names
            height = max(1, CELLS // len(queries.ids))
            for lo in range(0, batch.num_rows, height):
                rows = range(lo, min(batch.num_rows, lo + height))
                bound = np.stack([queries.bounds(_array(batch, "vocabulary", r, np.uint64), _array(batch, "largest", r, np.int32)) for r in rows])
                if given:
                    only = np.zeros(bound.shape, bool)
                    for r in rows:
                        only[r - lo, column_of(batch, "wanted")[r].as_py()] = True
                    bound[~only] = 0
                opened: dict[int, _Opened] = {}
                # The best block of every query first, then the second best, and so on, so that thresholds rise early.
                order = np.argsort(-bound, axis=0, kind="stable")
                alive = np.arange(len(queries.ids))
                for turn in order:
                    alive = alive[bound[turn[alive], alive] >= np.maximum(least[alive], 1)]
                    if not len(alive):
                        break
                    for q in alive:
                        r = int(turn[q])
                        if r not in opened:
                            opened[r] = _Opened(batch, lo + r, queries, documents, terms)
                        place, scores = opened[r].score(q, weight)
                        good = np.flatnonzero(scores >= max(least[q], 1))
                        if len(good) > k:
                            good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
                        if len(good):
                            docs = column_of(batch, "docs")[lo + r].values
                            held = best.get(q, []) + [(int(scores[g]), docs[int(place[g])].as_py()) for g in good]
                            best[q] = sorted(held, key=_order)[:k]
                            if len(best[q]) == k:
                                least[q] = max(least[q], best[q][-1][0])
        rows = [(queries.ids[q], q, doc, score) for q, found in best.items() for score, doc in found]
        kinds = (id_type, pa.int64(), doc_type, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], names=["item_id", "query", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, equal scores by ascending doc_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = items.sparkSession
    id_type, doc_type = items.schema["item_id"].dataType, index.blocks.schema["docs"].dataType.elementType
    shape = f"item_id {id_type.simpleString()}, query long, doc_id {doc_type.simpleString()}, score long"
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = []
    for queries in passes(items):
        shared = spark.sparkContext.broadcast(queries)
        counts = index.blocks.select("vocabulary", "holders").mapInArrow(_count_holders(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        shared.destroy()
        weight = np.zeros(len(queries.vocabulary), np.int64)
        for r in counts:
            weight[r["term"]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1)))
        queries.weight, queries.least = weight[queries.term] * queries.times, np.zeros(len(queries.ids), np.int64)
        shared = spark.sparkContext.broadcast(queries)
        bounds = index.blocks.select("block", "vocabulary", "largest").mapInArrow(_best_blocks(shared), "query long, block long, bound long")
        top = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        wanted = bounds.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= FIRST).groupBy("block").agg(F.collect_list("query").alias("wanted"))
        scorer = _scorer(shared, index.documents, index.terms, k, to_arrow_type(id_type), to_arrow_type(doc_type))
        scored = index.blocks.join(F.broadcast(written(wanted, "wanted")), "block").mapInArrow(scorer, shape)  # at most FIRST rows for each query of the pass
        kth = scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("r") == k).select("query", "score").collect()
        shared.destroy()
        for r in kth:
            queries.least[r["query"]] = r["score"]
        shared = spark.sparkContext.broadcast(queries)
        scorer = _scorer(shared, index.documents, index.terms, k, to_arrow_type(id_type), to_arrow_type(doc_type))
        scored = index.blocks.mapInArrow(scorer, shape)
        found.append(written(scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id {doc_type.simpleString()}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, block_text: int = BLOCK_TEXT) -> DataFrame:
    """``search`` on an index that is built for it and deleted afterwards."""
    with scratch(documents.sparkSession) as keep:
        return keep(written(search(build(documents, block_text), items, k), "ranks"))
