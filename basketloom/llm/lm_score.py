"""Language-model scores by a weighted backoff automaton.

Model.  All training texts are counted: every word, the end of every text, and every two and three tokens in a row.
The base model gives a token ``(c + 1) / (N + V + 1)``.  Estimates after a history are smoothed towards those after
the shorter history as if ``STRENGTH`` further tokens had been seen there (a Dirichlet prior):
``p(w | u v) = (c(u v w) + STRENGTH p(w | v)) / (c(u v) + STRENGTH)``, likewise ``p(w | v)`` from the base model.

Automaton.  A state is a history: two tokens, one token, or none.  A state has an arc for each token that was seen
after it, with the smoothed estimate, leading to the longest history that is a state; and a failure arc to the
history without its older token, whose weight hands on what the arcs leave: ``STRENGTH / (c + STRENGTH)``.  Reading
a text from left to right, each token takes its arc or follows failure arcs until there is one, and log10
probabilities add up.  The end of a text is the history of its first word.

Scale.  The automaton of the whole corpus is never held in one place.  Documents are encoded in blocks of about
``BLOCK_TOKENS`` tokens.  Each block sends every n-gram that its texts hold, once, with its training count, to the
part of the key range that the n-gram's hash falls in; parts add up the counts of all blocks and answer each block.
A block then has all counts that its texts can touch: its slice of the automaton.  It is built as sorted arrays and
the block's texts are read through it, in pieces side by side, each piece starting in the state where the one
before it ends.  Every count of every n-gram is used whatever the size of the corpus; a frequent word or pair
costs one entry for each block; nothing is broadcast but two numbers.

Nulls, empty tables and odd rows: a null text counts as empty, which is scored as its end alone.  Rows without
id are scored, never learned from.  Without training texts N and V are 0 and every token has log10 probability
0.  Repeated rows are counted and scored each.  Words are told apart by 63-bit hashes, longer n-grams by hashes of
``SPARE`` bits more than the number of tokens has (a chance below one in a million for each to share another's
count).  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import scratch, written
from .textblocks import Block, U64, blocks, column_of, mix

#: Tokens whose weight the estimate after the shorter history has.
STRENGTH = 16.0
#: Tokens of a block (a longer text is a block of its own), and tokens for each part of the key range.
BLOCK_TOKENS, PART_TOKENS = 700_000, 2_000_000
#: Tokens that are read one after the other; a text is cut into pieces of so many.
PIECE = 192
#: Bits of the keys of two and three tokens beyond those of the number of tokens; keys of one token have ``WORD`` bits.
SPARE, WORD = 20, 63
END = mix(np.array([0xE0F], np.uint64))[0]

_ZSTD = pa.Codec("zstd", 1)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on: first all lowest bytes, then all next (small numbers compress well so), compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(planes).to_bytes(8, "little") + bytes([width]) + _ZSTD.compress(planes, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[8]
    planes = np.frombuffer(_ZSTD.decompress(raw[9:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)


def tokens(b: Block) -> np.ndarray:
    """63-bit hashes of the lower-cased words of each text, each text followed by its end."""
    out = np.full(len(b.ws) + b.n, END, np.uint64)
    out[np.arange(len(b.ws)) + b.word_doc()] = b.word_hashes(lower=True)
    return out >> U64(1)


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (of 63 bits at most), and how often each stands where ``train`` holds."""
    ranked = np.sort(keys << U64(1) | train.astype(np.uint64))
    kinds = ranked >> U64(1)
    first = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(kinds) else np.zeros(0, np.int64)
    return kinds[first], np.add.reduceat(ranked & U64(1), first) if len(first) else kinds


def ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted distinct ones."""
    order = np.argsort(keys)
    ranked = keys[order]
    out = np.zeros(len(keys), np.int64)
    out[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
    return out


class Encoded:
    """Texts of a block as places of their tokens in ``words``; ``sizes`` counts each text's tokens."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, sizes: np.ndarray, bits: int = WORD):
        self.words, self.codes, self.sizes = words, codes, sizes
        self.offs = np.append(0, np.cumsum(sizes))
        self.first = self.offs[:-1]
        self.end = int(np.searchsorted(words, END >> U64(1)))
        self.before = np.empty_like(codes)
        self.before[1:] = codes[:-1]
        self.before[self.first] = self.end
        inner = np.ones(len(codes), bool)
        inner[self.first] = False
        #: Tokens with two tokens before them, the end of the text before counted as one.
        self.inner = np.flatnonzero(inner)
        one = words[codes]
        two = mix(mix(words[self.before] + U64(1)) * U64(0x9E3779B97F4A7C15) + one)
        three = mix(mix(two[self.inner - 1] + U64(2)) * U64(0xC2B2AE3D27D4EB4F) + one[self.inner])
        #: Keys of the n-grams that end at each token (the longest: at each of ``inner``).
        self.keys = [one, two >> U64(64 - bits), three >> U64(64 - bits)]

    def grams(self, train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and training counts of the n-grams of ``order + 1`` tokens; ``train`` marks the texts to learn from."""
        learn = np.repeat(train, self.sizes)
        return distinct(self.keys[order], learn[self.inner] if order == 2 else learn)


def bounds(bits: int, parts: int) -> np.ndarray:
    return np.array([(p << bits) // parts for p in range(parts + 1)], np.uint64)


_BLOCK = "block long, train binary, sizes binary, words binary, codes binary, n_train long, n_tokens long"


def _encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def taken() -> pa.RecordBatch:
        ids, train, sizes, hashes = zip(*held)
        train, sizes = np.concatenate(train), np.concatenate(sizes)
        hashes = np.concatenate(hashes)
        codes = ranks(hashes)
        words = np.zeros(int(codes.max()) + 1, np.uint64)
        words[codes] = hashes
        ids = pa.concat_arrays(ids)
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        binary = [pa.array([x], pa.binary()) for x in (packed(train), packed(sizes), packed(np.diff(words, prepend=U64(0))), packed(codes))]
        counts = [pa.array([int(x)], pa.int64()) for x in (sizes[train].sum(), sizes.sum())]
        return pa.RecordBatch.from_arrays([ids, pa.array([number], pa.int64()), *binary, *counts], names=["ids", "block", "train", "sizes", "words", "codes", "n_train", "n_tokens"])

    for batch in batches:
        ids, train = column_of(batch, "doc_id"), column_of(batch, "train").to_numpy(zero_copy_only=False)
        for lo, hi, b in blocks(column_of(batch, "text")):
            new = len(b.ws) + b.n
            if held and size + new > BLOCK_TOKENS:
                yield taken()
                held, size, number = [], 0, number + 1
            held.append((ids.slice(lo, hi - lo), train[lo:hi], b.n_words + 1, tokens(b)))
            size += new
    if held:
        yield taken()


def _read(row: dict, bits: int) -> Encoded:
    words = np.cumsum(unpacked(row["words"]), dtype=np.uint64)
    return Encoded(words, unpacked(row["codes"]).astype(np.int64), unpacked(row["sizes"]).astype(np.int64), bits)


def _asker(parts: int, bits: int, orders: tuple[int, ...]) -> Callable:
    """Of each block the n-grams of each part, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [bounds(k, parts) for k in (WORD, bits, bits)]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: column_of(batch, c)[k].as_py() for c in ("block", "train", "sizes", "words", "codes")}
                out, texts, train = [], _read(row, bits), unpacked(row["train"]).astype(bool)
                for order in orders:
                    keys, counts = texts.grams(train, order)
                    cuts = np.searchsorted(keys, edges[order])
                    for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
                        mine = slice(cuts[p], cuts[p + 1])
                        out.append((order * parts + int(p), packed(np.diff(keys[mine], prepend=edges[order][p])), packed(counts[mine])))
                part, keys, counts = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([row["block"]] * len(out), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["part", "block", "keys", "counts"])

    return run


def _answerer(parts: int, bits: int) -> Callable:
    """Of each part the summed counts that each block asks for, in its order; ``kinds`` counts the words that were learned."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        order, p = divmod(part, parts)
        low = (p << (bits if order else WORD)) // parts
        keys = [U64(low) + np.cumsum(unpacked(x), dtype=np.uint64) for x in group.column("keys").to_pylist()]
        sizes = [len(x) for x in keys]
        keys, counts = np.concatenate(keys), np.concatenate([unpacked(x) for x in group.column("counts").to_pylist()])
        ranks = np.argsort(keys)
        keys = keys[ranks]
        new = np.append(True, keys[1:] != keys[:-1])
        sums = np.add.reduceat(counts[ranks], np.flatnonzero(new))
        counts[ranks] = sums[np.cumsum(new) - 1]
        kinds = np.zeros(len(sizes), np.int64)
        kinds[0] = int((sums > 0).sum()) if order == 0 else 0
        answers = [packed(x) for x in np.split(counts, np.cumsum(sizes)[:-1])]
        return pa.table([group.column("block"), group.column("part"), pa.array(answers, pa.binary()), pa.array(kinds)], names=["block", "part", "counts", "kinds"])

    return run


class Slice:
    """The part of the automaton that the texts of a block can touch.

    State 0 is the empty history, states 1 to D the D words, and the further ones the pairs.  ``arcs`` holds
    (state x D + word) of all states but 0, sorted, with ``weight`` and ``to``; state 0 has an arc for each word, with
    ``base`` and ``after``.  ``back`` and ``failure`` are the goal and weight of each state's failure arc.
    """

    def __init__(self, texts: Encoded, counts: list[np.ndarray], room: float, strength: float = STRENGTH):
        one, two, three = (c.astype(np.float64) for c in counts)
        d = len(texts.words)
        pair, triple = map(ranks, texts.keys[1:])
        older, newer = np.zeros(len(two), np.int64), np.zeros(len(two), np.int64)
        older[pair], newer[pair] = texts.before, texts.codes
        history, last = np.zeros(len(three), np.int64), np.zeros(len(three), np.int64)
        history[triple], last[triple] = pair[texts.inner - 1], pair[texts.inner]

        p1 = (one + 1) / room
        p2 = (two + strength * p1[newer]) / (one[older] + strength)
        p3 = (three + strength * p2[last]) / (two[history] + strength)
        self.after = np.where(one > 0, 1 + np.arange(d), 0)
        self.base = np.log10(p1)
        # The state after each pair, and after each token of the texts; nothing goes on past the end of a text.
        state = np.where((two > 0) & (newer != texts.end), 1 + d + np.arange(len(two)), self.after[newer])
        self.reached = state[pair]
        twos, threes = np.flatnonzero(two > 0), np.flatnonzero(three > 0)
        arcs = np.concatenate([(1 + older[twos]) * d + newer[twos], (1 + d + history[threes]) * d + newer[last[threes]]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.weight = np.log10(np.concatenate([p2[twos], p3[threes]]))[order]
        self.to = np.concatenate([state[twos], state[last[threes]]])[order]
        self.back = np.concatenate([[0], np.zeros(d, np.int64), 1 + newer])
        self.failure = np.log10(strength / (np.concatenate([[0], one, two]) + strength))
        self.words = d

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of one token from each state."""
        gain, goal = np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            root = state == 0
            at, now = todo[root], word[root]
            gain[at] += self.base[now]
            goal[at] = self.after[now]
            todo, state, word = todo[~root], state[~root], word[~root]
            if not len(todo):
                break
            wanted = state * self.words + word
            place = np.searchsorted(self.arcs, wanted)
            place[place == len(self.arcs)] = 0
            hit = self.arcs[place] == wanted if len(self.arcs) else np.zeros(len(todo), bool)
            at, place = todo[hit], place[hit]
            gain[at] += self.weight[place]
            goal[at] = self.to[place]
            todo, state, word = todo[~hit], state[~hit], word[~hit]
            gain[todo] += self.failure[state]
            state = self.back[state]
        return gain, goal

    def read(self, texts: Encoded) -> np.ndarray:
        """Log10 probability of each text, its pieces read side by side from left to right."""
        n = -(-texts.sizes // PIECE)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = texts.offs[text] + place * PIECE
        size = np.minimum(texts.offs[text + 1] - start, PIECE)
        state = np.where(place > 0, self.reached[start - 1], self.after[texts.end])
        order = np.argsort(-size, kind="stable")
        start, state, active = start[order], state[order], -size[order]
        sums = np.zeros(len(start))
        for k in range(PIECE):
            on = int(np.searchsorted(active, -k))  # pieces of more than k tokens
            if not on:
                break
            gain, state[:on] = self.step(state[:on], texts.codes[start[:on] + k])
            sums[:on] += gain
        return np.bincount(text[order], sums, len(n))


def _reader(n_tokens: int, n_types: int, n_parts: int, bits: int, strength: float, kind: pa.DataType) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        encoded = group.filter(group.column("codes").is_valid())
        row = {c: encoded.column(c)[0].as_py() for c in ("sizes", "words", "codes")}
        ids = encoded.column("ids").combine_chunks().flatten() if encoded.column("ids").num_chunks != 1 else encoded.column("ids").chunk(0).flatten()
        texts = _read(row, bits)
        answers = group.filter(group.column("counts").is_valid())
        parts = answers.column("part").to_numpy()
        order = np.argsort(parts)
        found = [unpacked(x) for x in answers.column("counts").take(pa.array(order)).to_pylist()]
        counts = [np.concatenate([x for x, p in zip(found, parts[order] // n_parts) if p == k] or [np.zeros(0, np.uint64)]) for k in range(3)]
        model = Slice(texts, counts, n_tokens + n_types + 1.0, strength)
        known, base = (np.add.reduceat(x[texts.codes], texts.first) for x in ((counts[0] > 0).astype(np.int64), model.base))
        return pa.table([ids.cast(kind), pa.array(texts.sizes), pa.array(known), pa.array(np.full(len(ids), n_tokens, np.int64)), pa.array(base), pa.array(model.read(texts))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(documents: DataFrame, keep: Column, strength: float = STRENGTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document, learned from those that pass ``keep``."""
    with scratch(documents.sparkSession) as hold:
        return hold(written(_scored(documents, keep, strength), "scores"))


def _scored(documents: DataFrame, keep: Column, strength: float) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    train = F.coalesce(keep, F.lit(False)) & F.col("doc_id").isNotNull()
    texts = documents.select("doc_id", "text", train.alias("train"))
    encoded = written(texts.mapInArrow(_encoder, f"ids array<{kind}>, {_BLOCK}"), "encoded")
    n_train, n_tokens = encoded.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts, bits = 4 + int(n_tokens) // PART_TOKENS, min(WORD, SPARE + int(n_tokens).bit_length())
    rows = encoded.drop("ids", "n_train", "n_tokens")
    found = []
    for orders in ((0, 1), (2,)):  # one after the other, so that only one's shuffle is on disk
        asked = rows.mapInArrow(_asker(parts, bits, orders), "part int, block long, keys binary, counts binary")
        found.append(written(asked.groupBy("part").applyInArrow(_answerer(parts, bits), "block long, part int, counts binary, kinds long"), "answers"))
    answers = found[0].unionByName(found[1])
    n_types = answers.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    both = encoded.drop("n_train", "n_tokens").unionByName(answers.drop("kinds"), allowMissingColumns=True)
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("block").applyInArrow(_reader(int(n_train), int(n_types), parts, bits, strength, _arrow_type(documents)), schema)


def _arrow_type(documents: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(documents.schema["doc_id"].dataType)
