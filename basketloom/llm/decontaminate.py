"""Benchmark decontamination by edit distance.

Texts and benchmark items are sequences of normalised words (ASCII lower-cased, punctuation at the edges
dropped).  An item contaminates a document if some window of the item's number of words lies within
``max_edits(words)`` word edits of it.

0.  Parts.  An item of more than ``PART_WORDS`` words is cut into parts of about equal length.  However its edits
    fall, some part has no more than its share of them, so the search is for parts within their share.
1.  Windows.  Cut into ``edits + 1`` pieces, a part within reach leaves one piece unchanged, so only windows
    that hold a run of ``q`` of its words (the piece length) at its place can qualify; all others are ruled out
    by that bound.  A window as long as the part is laid around each such run, once however many parts hold it.
2.  CGK embedding.  A random walk over the window, its steps decided by hashes of (walk position, word), maps
    edit distance to Hamming distance.
3.  Bit-sampling LSH.  In each of ``REPEATS`` independent embeddings, ``SAMPLED`` positions form a key;
    a window and a part of its length that share a key are a candidate pair.  ``REPEATS`` is set for a recall
    of ``RECALL`` at the largest distance counted in a part of ``PART_WORDS`` (see ``expected_recall``).
4.  Pairs are dropped where more words of the part are missing from the window and its surroundings than edits
    could take away.  The others are verified exactly: the word edit distance of the whole item, over the stretch of
    the text where its candidate windows place it, free to start or end ``edits`` words off.

Nulls, empty tables and odd rows: null or empty texts match nothing; null or wordless items are ignored; items
of fewer than ``LEAST_WORDS`` words must appear unchanged.  Rows without doc_id are searched too, their matches
carry a null id.  Items alike in text match alike.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, written
from .textblocks import LOWER, Block, blocks, column_of, gram_fits, gram_hashes, mix

EDIT_SHARE = 0.2
LEAST_WORDS = 8
REPEATS, SAMPLED, RECALL = 24, 3, 0.95
#: Items that are searched for in one pass over the documents, at most; further ones take further passes.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 8 << 20
#: Words of a part, at most; windows that are walked at once, candidate pairs that are looked at at once, and words of those compared.
PART_WORDS, WINDOWS, PAIRS, COMPARED = 60, 4096, 1 << 20, 1 << 24

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
U64 = np.uint64


def max_edits(words: int) -> int:
    return int(EDIT_SHARE * words) if words >= LEAST_WORDS else 0


def words_of(b: Block) -> np.ndarray:
    """Hashes of the normalised words of a block."""
    solid = np.append(np.flatnonzero(~_PUNCT[b.data]), len(b.data) + 1)
    start = np.minimum(solid[np.searchsorted(solid, b.ws)], b.we)  # a word of nothing else ends where it starts
    end = np.maximum(np.append(-1, solid)[np.searchsorted(solid, b.we)] + 1, start)
    return b.span_hash(start, end, data=LOWER[b.data])


def walk(windows: np.ndarray, steps: int) -> np.ndarray:
    """First ``steps`` symbols of REPEATS CGK embeddings of equally long windows: windows x embeddings x steps."""
    n, size = windows.shape
    at = np.zeros((n, REPEATS), np.int64)
    base = (np.arange(n) * (size + 1))[:, None]
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1).ravel()
    seeds = mix(np.arange(1, REPEATS + 1, dtype=np.uint64))
    out = np.empty((steps, n, REPEATS), np.uint64)
    for j in range(steps):
        out[j] = w = padded[base + at]
        # One bit of a keyed hash of (embedding, walk position, word) decides whether the walk goes on.
        h = (w ^ (seeds + U64(j * 0xC2B2AE3D27D4EB4F & (2**64 - 1)))) * U64(0x9E3779B97F4A7C15)
        at += (h >> U64(61) & U64(1)).astype(np.int64) & (at < size)
    return out


def keys(windows: np.ndarray) -> np.ndarray:
    """REPEATS keys of each window: hashes of the embedding at sampled positions, one embedding for each."""
    n, size = windows.shape
    steps = max(1, int(1.5 * size))  # by then an average walk is three quarters through; later symbols are padding too often
    picks = np.stack([np.random.Generator(np.random.PCG64([t, size])).choice(steps, SAMPLED, replace=True) for t in range(REPEATS)])
    e, t = walk(windows, steps), np.arange(REPEATS)
    h = np.broadcast_to(t.astype(np.uint64), (n, REPEATS))
    for k in range(SAMPLED):
        h = mix(h * U64(31) + e[picks[:, k], :, t].T)
    return h


def expected_recall(size: int, edits: int, trials: int = 400, seed: int = 5) -> float:
    """Share of random items that meet a copy of theirs with ``edits`` random edits in some key."""
    rng = np.random.Generator(np.random.PCG64(seed))
    items = rng.integers(1, 1 << 62, (trials, size)).astype(np.uint64)
    copies = np.zeros_like(items)
    for r in range(trials):
        w = list(items[r])
        for _ in range(edits):
            k, kind = rng.integers(0, len(w)), rng.integers(0, 3)
            new = U64(rng.integers(1, 1 << 62))
            if kind == 0:
                w[k] = new
            elif kind == 1:
                w.insert(k, new)
            else:
                del w[k]
        copies[r] = np.array((w + [U64(7)] * size)[:size], np.uint64)
    return float((keys(items) == keys(copies)).any(1).mean())


def distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``; edits is most + 1 beyond ``most``.

    Any stretch may be taken, so the first row is free and the best cell of the last row counts.
    """
    m = len(text)
    place = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, w in enumerate(item, 1):
        new, start = np.empty_like(cost), np.empty_like(begin)
        new[0], start[0] = i, 0
        swap, drop = cost[:-1] + (text != w), cost[1:] + 1
        use = swap <= drop
        new[1:], start[1:] = np.where(use, swap, drop), np.where(use, begin[:-1], begin[1:])
        # Insertions run along the row: each cell takes the cheapest one to its left, of equals the nearest.
        run = new - place
        least = np.minimum.accumulate(run)
        origin = np.maximum.accumulate(np.where(run == least, place, 0))
        cost, begin = least + place, start[origin]
        if cost.min() > most:
            return most + 1, 0, 0
    # Of equal distances the stretch nearest to the item's length counts, then the first.
    size = np.arange(m + 1) - begin
    best = min(range(m + 1), key=lambda j: (cost[j], abs(int(size[j]) - len(item)), j))
    return int(cost[best]), int(begin[best]), best


def cut(words: int) -> list[tuple[int, int]]:
    """(offset, length) of the parts of an item."""
    n = max(1, -(-words // PART_WORDS))
    edges = [words * k // n for k in range(n + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


@dataclass
class Index:
    """Items and their parts by number; runs by length; LSH keys by part length."""

    ids: list[int]
    words: list[np.ndarray]
    item: np.ndarray  # of each part
    offset: np.ndarray
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # q -> hashes, places in the part, part lengths
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # part length -> keys, rows of ``texts``
    texts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # part length -> parts, their words, their edits
    sieve: dict[int, np.ndarray] = field(default_factory=dict)  # q -> bitmap over the last 20 bits of a run hash


def build(items: list[tuple[int, str]]) -> Index:
    ids, words = [], []
    for item_id, text in items:
        for _, _, b in blocks(pa.array([text], pa.string())):
            w = words_of(b)
            if len(w):
                ids.append(item_id)
                words.append(w)
    parts = [(k, offset, size) for k, w in enumerate(words) for offset, size in cut(len(w))]
    out = Index(ids, words, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))
    runs: dict[int, list] = {}
    lengths: dict[int, list[int]] = {}
    for number, (k, offset, size) in enumerate(parts):
        whole = len(words[k])
        q = max(1, size // (max_edits(whole) // len(cut(whole)) + 1))
        g = gram_hashes(words[k][offset : offset + size], q)
        runs.setdefault(q, []).append((g, np.arange(len(g)), np.full(len(g), size)))
        lengths.setdefault(size, []).append(number)
    for q, group in runs.items():
        g, off, size = (np.concatenate(p) for p in zip(*group))
        order = np.lexsort((size, off, g))
        g, off, size = g[order], off[order], size[order]
        new = np.append(True, (g[1:] != g[:-1]) | (off[1:] != off[:-1]) | (size[1:] != size[:-1]))
        out.runs[q] = g[new], off[new], size[new]
        out.sieve[q] = np.zeros(1 << 20, bool)
        out.sieve[q][(g & U64((1 << 20) - 1)).astype(np.int64)] = True
    for size, group in lengths.items():
        texts = np.stack([words[k][offset : offset + size] for k, offset, _ in (parts[n] for n in group)])
        h = np.concatenate([keys(texts[lo : lo + WINDOWS]) for lo in range(0, len(texts), WINDOWS)]).ravel()
        order = np.argsort(h, kind="stable")
        out.tables[size] = h[order], np.repeat(np.arange(len(group)), REPEATS)[order]
        whole = np.array([len(words[parts[n][0]]) for n in group])
        out.texts[size] = np.array(group), texts, np.array([max_edits(m) // len(cut(m)) for m in whole.tolist()])
    return out


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, position) with position in [lo[row], hi[row])."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _windows(b: Block, w: np.ndarray, index: Index) -> dict[int, np.ndarray]:
    """First words of the windows of each length that hold a run of some part."""
    starts: dict[int, list[np.ndarray]] = {}
    for q, (h, off, size) in index.runs.items():
        g = gram_hashes(w, q)
        at = np.flatnonzero(index.sieve[q][(g & U64((1 << 20) - 1)).astype(np.int64)])
        at = at[gram_fits(b, q)[at]]
        row, pos = _expand(np.searchsorted(h, g[at], "left"), np.searchsorted(h, g[at], "right"))
        doc = np.searchsorted(b.wo, at[row], side="right") - 1
        first = np.minimum(np.maximum(at[row] - off[pos], b.wo[doc]), np.maximum(b.wo[doc + 1] - size[pos], b.wo[doc]))
        for s in np.unique(size[pos]):
            starts.setdefault(int(s), []).append(np.unique(first[size[pos] == s]))
    return {s: np.unique(np.concatenate(p)) for s, p in starts.items()}


def search(b: Block, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item number, edits, first word, word after the last) of all matches in a block."""
    if not len(b.ws) or not index.words:
        return []
    w = words_of(b)
    #: Of each text and item the stretches where candidate windows place it.
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for size, first in _windows(b, w, index).items():
        doc = np.searchsorted(b.wo, first, side="right") - 1
        for lo in range(0, len(first), WINDOWS):
            own, at = doc[lo : lo + WINDOWS], first[lo : lo + WINDOWS]
            for r, p in _candidates(b, w, index, size, own, at):
                k, d = int(index.item[p]), int(own[r])
                start, most = int(at[r] - index.offset[p]), max_edits(len(index.words[k]))
                places.setdefault((d, k), []).append((max(int(b.wo[d]), start - most), min(int(b.wo[d + 1]), start + len(index.words[k]) + most)))
    out = []
    for (d, k), stretches in sorted(places.items()):
        item, best = index.words[k], None
        most = max_edits(len(item))
        for a, z in joined(stretches):
            if int(np.isin(item, w[a:z]).sum()) < len(item) - most:
                continue  # more words than that are missing
            edits, x, y = distance(item, w[a:z], most)
            if edits <= most:
                new = (edits, a + x - int(b.wo[d]), a + y - int(b.wo[d]))
                best = new if best is None else min(best, new)
        if best is not None:
            out.append((d, k, *best))
    return out


def _around(b: Block, w: np.ndarray, doc: np.ndarray, first: np.ndarray, size: int, off: int) -> np.ndarray:
    """Words of each window and ``off`` words on both sides, 0 where its text has none."""
    at = first[:, None] + np.arange(-off, size + off)
    inside = (at >= b.wo[doc][:, None]) & (at < b.wo[doc + 1][:, None])
    return np.where(inside, w[np.where(inside, at, 0)], U64(0))


def _candidates(b: Block, w: np.ndarray, index: Index, size: int, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """(window, part) of the windows and parts of ``size`` words that share a key and words enough."""
    table, rows = index.tables[size]
    parts, texts, edits = index.texts[size]
    h = keys(_around(b, w, doc, first, size, 0))
    left, right = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
    upto = np.cumsum((right - left).sum(1))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        row, pos = _expand(left[lo:hi].ravel(), right[lo:hi].ravel())
        pair = np.unique((row // REPEATS + lo) * len(parts) + rows[pos])
        lo = hi
        r, p = pair // len(parts), pair % len(parts)
        off = int(edits.max())
        step = max(1, COMPARED // (size * (size + 2 * off)))
        for k in range(0, len(pair), step):
            i, j = r[k : k + step], p[k : k + step]
            there = (texts[j][:, :, None] == _around(b, w, doc[i], first[i], size, off)[:, None, :]).any(2).sum(1)
            near = np.flatnonzero(there >= size - edits[j])
            yield from zip(i[near].tolist(), parts[j[near]].tolist())


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches as one each."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(set(stretches)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


SCHEMA = "item_id long, edits int, item_words int, first_word int, n_window int"


def _searcher(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = column_of(batch, "doc_id")
            for lo, hi, b in blocks(column_of(batch, "text")):
                hits = search(b, index)
                if hits:
                    doc, item, edits, first, last = (np.array(c) for c in zip(*hits))
                    sizes = [len(index.words[k]) for k in item]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(doc + lo)), pa.array([index.ids[k] for k in item], pa.int64()), *(pa.array(c, pa.int32()) for c in (edits, sizes, first, last - first))],
                        names=["doc_id", "item_id", "edits", "item_words", "first_word", "n_window"],
                    )

    return run


def matches(documents: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, n_window) of every document and item that contaminates it.

    Items are broadcast in passes of about ``per_pass`` items or ``BYTES_PER_PASS`` of text at most, each over all
    documents, so what is held at once is bounded however long the benchmark.  With several passes the matches of each
    are written (the tables stay until the scratch around the call ends, or the user removes them).
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-count // per_pass), -(-size // BYTES_PER_PASS))
    out = None
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        index = build(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        shared = spark.sparkContext.broadcast(index)
        found = documents.select("doc_id", "text").mapInArrow(_searcher(shared), f"doc_id {kind}, {SCHEMA}")
        if passes > 1:  # no two passes' items are held at once
            found = written(found, f"matches{k}")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, all columns as they were.  Works by text, so ids may repeat or be null.

    Columns may bear any name.
    """
    key = free_name(documents.columns, "text_key")
    keyed = documents.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    hits = matches(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark)
    return keyed.join(hits.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").drop(key)
