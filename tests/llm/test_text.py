"""Quality rules, n-gram join, substring dedup, language-model scores, mixing: against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from basketloom.llm import lm_score, mixing, quality_rules, shingle_join, substring_dedup, textblocks

from .helpers import ASCII_LOWER, awkward, components, fold, nothing, repeats, rules, shingles, words


def random_documents(spark, seed, n=120):
    """Unrelated texts, exact and near copies in chains, shared passages, very short texts."""
    rng = random.Random(seed)
    fresh = lambda k: [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(k)]
    passage, texts = fresh(50), []
    for k in range(n):
        kind = k % 6
        if kind < 2 or not texts:
            t = fresh(rng.choice([1, 3, 4, 5, 6, 20, 60, 90]))
        elif kind == 2:
            t = list(rng.choice(texts))
        elif kind == 3:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(len(t))] = rng.choice(["new", "NEW", "x"])
        elif kind == 4:
            t = fresh(20) + passage[rng.randint(0, 8) : 50 - rng.randint(0, 8)] + fresh(10)
        else:
            t = list(rng.choice(texts)) + fresh(2)
        texts.append(t)
    rows = [(k, rng.choice([" ", "\n", "  "]).join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_words_of_blocks():
    texts = ["a b", "", " c\x0bd ", "é f", "\n", "g"]
    (lo, hi, b), *rest = textblocks.blocks(pa.array(texts))
    assert (lo, hi, rest) == (0, 6, []) and list(b.n_words) == [len(words(t)) for t in texts]
    assert [bytes(b.data[s:e]).decode() for s, e in zip(b.ws, b.we)] == [w for t in texts for w in words(t)]
    h = {}
    for k, (_, _, x) in enumerate(textblocks.blocks(pa.array(["a b c a", None, "c a b"]), 1)):
        for w, v in zip(words(["a b c a", None, "c a b"][k]), x.word_hashes()):
            assert h.setdefault(w, v) == v
    assert len(set(h.values())) == 3


@pytest.mark.parametrize("seed, block", [(1, 100_000), (3, 40)])
def test_components(spark, monkeypatch, seed, block):
    """Whatever number of entries is cut."""
    monkeypatch.setattr(shingle_join, "BLOCK_ENTRIES", block)
    rows, df = random_documents(spark, seed)
    got = [tuple(r) for r in shingle_join.component_ids(df).collect()]
    assert sorted(got) == sorted(components(rows))
    kept = sorted(r.doc_id for r in shingle_join.one_of_each(df).collect())
    assert kept == sorted({c for _, n, c in components(rows)})


def test_long_chain_and_large_groups(spark):
    """A chain of small changes is one group although its ends share nothing; a large group costs no pairs."""
    base = [f"w{k}" for k in range(100)]
    rows, t = [], list(base)
    for k in range(30):
        rows.append((k, " ".join(t)))
        t = t[3:] + [f"c{k}{j}" for j in range(3)]
    rows += [(100 + k, " ".join(base[:60] + [f"e{k}"])) for k in range(80)] + [(300 + k, "same five words in here") for k in range(50)]
    got = sorted(tuple(r) for r in shingle_join.component_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert got == sorted(components(rows))


def test_pairs_of_blocks(monkeypatch):
    """Products of the columns of blocks against plain loops, in batches of any size."""
    monkeypatch.setattr(shingle_join, "_AT_ONCE", 20)
    rng = random.Random(8)
    rows = sorted((rng.randint(0, 2), rng.randint(0, 9), rng.randint(0, 2), False, cid, 10 + cid % 5, 4 + cid % 7, 9 + cid % 3, 9 + cid % 4, cid, cid % 4) for cid in range(60) for _ in range(3))
    rows = [(*r[:3], r[0] != 1, *r[4:]) for r in sorted({(r[0], r[1], r[4]): r for r in rows}.values())]
    names = ["block", "token", "own", "within", "cid", "n", "left", "live", "reach", "ends", "comp"]
    past = lambda n: -(-3 * n // 4) - 1
    wanted, total = {}, {}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            rest = past(x[5] if x[9] < y[9] else y[5])
            possible = 4 * min(x[5], y[5]) >= 3 * max(x[5], y[5]) and 7 * min(min(x[7], y[7]) + rest, x[8], y[8]) >= 3 * (x[5] + y[5])
            if x[:2] == y[:2] and x[10] != y[10] and (x[3] or x[2] != y[2]) and possible:
                key = min(x[4], y[4]), max(x[4], y[4])
                shared, near = total.get((x[0], *key), (0, False))
                total[x[0], *key] = shared + 1, near or 7 * min(x[6], y[6]) >= 3 * (x[5] + y[5])
    for (block, a, b), (shared, near) in total.items():
        x, y = (next(r for r in rows if r[4] == c) for c in (a, b))
        more = min(r[7] - sum(q[0] == block and q[4] == r[4] for q in rows) for r in (x, y))
        if 7 * (shared + more + past(x[5] if x[9] < y[9] else y[5])) >= 3 * (x[5] + y[5]):
            old = wanted.get((a, b), (0, False))
            wanted[a, b] = old[0] + shared, old[1] or near
    for size in (1, 7, 1000):
        kinds = [np.int64] * 3 + [bool] + [np.int64] * 7
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, k)) for c, k in zip(zip(*rows[lo : lo + size]), kinds)], names=names) for lo in range(0, len(rows), size)]
        got = {}
        for b in shingle_join._met(iter(batches)):
            for r in b.to_pylist():
                shared, near = got.get((r["a"], r["b"]), (0, False))
                got[r["a"], r["b"]] = shared + r["shared"], near or r["near"]
        assert got == wanted and len(wanted) > 50
    assert list(shingle_join._met(iter([]))) == []


@pytest.mark.parametrize("count", [5_000, 50_000])
def test_a_column_of_one_component(count):
    """Entries of one component are not paired with each other: two others in the column cost 2 * count + 1 pairs."""
    import time

    comp = np.zeros(count, np.int64)
    comp[[count // 3, count // 2]] = 1, 2
    flat = lambda v, k=np.int64: pa.array(np.full(count, v, k))
    columns = [flat(1), flat(7), flat(0), flat(True, bool), pa.array(np.arange(count)), flat(100), flat(60), flat(90), flat(90), flat(5), pa.array(comp)]
    batch = pa.RecordBatch.from_arrays(columns, names=["block", "token", "own", "within", "cid", "n", "left", "live", "reach", "ends", "comp"])
    began, pairs = time.process_time(), 0
    for b in shingle_join._met(iter([batch])):
        pairs += b.num_rows
    assert pairs == 2 * (count - 2) + 1 and time.process_time() - began < 2


def test_prefixes_meet():
    """Sets at the threshold share a prefix entry whatever n-grams count as frequent."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 62, 2).astype(np.uint64)]))
        level = dict(zip(rng.choice(x, len(x) // 2, replace=False).tolist(), rng.integers(1, 3, len(x)).tolist()))
        both = np.concatenate([x, y])
        got = shingle_join.prefixes(both, np.array([0, len(x), len(x) + len(y)]), np.array([level.get(int(h), 0) for h in both], np.uint8))
        if shingle_join.reaches(x, y):
            assert set(got[2][got[0] == 0]) & set(got[2][got[0] == 1])


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup(spark, seed):
    rows, df = random_documents(spark, seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(df).collect()}
    for (i, _), (w, gone) in zip(rows, repeats([t for _, t in rows])):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    for (i, t), (w, gone) in zip(rows, repeats([t for _, t in rows])):
        assert words(cut.get(i, "")) == [x for x, g in zip(w, gone) if not g] and (i in cut) == (not w or not all(gone))
        if i not in cut:
            continue
        if not any(gone):
            assert cut[i] == t


def test_quality_rules(spark):
    rows, df = random_documents(spark, 5, 60)
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.rate(df).collect()}
    assert got == {i: rules(t) for i, t in rows}


def test_vote_model_finds_the_bad_class():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.85
    n = len(quality_rules.RULES)
    v = np.where(good[:, None], rng.choice([1, 0, 2], (4000, n), p=[0.9, 0.02, 0.08]), rng.choice([1, 0, 2], (4000, n), p=[0.5, 0.4, 0.1]))
    code = (v * 3 ** np.arange(n - 1, -1, -1)).sum(1)
    kinds, counts = np.unique(code, return_counts=True)
    model = quality_rules.fit(kinds, counts)
    p = quality_rules.posterior(quality_rules.digits(code), **model)
    assert ((p >= 0.5) == good).mean() > 0.97 and abs(model["prior"] - 0.85) < 0.03


def plain_scores(rows, learn, strength):
    """Scores by smoothing over plain counters of words, pairs and triples."""
    from collections import Counter

    texts = {i: [None, *words((t or "").translate(ASCII_LOWER)), None] for i, t in rows}
    trained = [t for i, t in texts.items() if learn(i)]
    one = Counter(w for t in trained for w in t[1:])
    two = Counter(p for t in trained for p in zip(t, t[1:]))
    three = Counter(p for t in trained for p in zip(t, t[1:], t[2:]))
    room = sum(one.values()) + len(one) + 1
    p1 = lambda w: (one[w] + 1) / room
    p2 = lambda v, w: (two[v, w] + strength * p1(w)) / (one[v] + strength)
    p3 = lambda u, v, w: (three[u, v, w] + strength * p2(v, w)) / (two[u, v] + strength)
    out = {}
    for i, t in texts.items():
        model = math.log10(p2(t[0], t[1])) + sum(math.log10(p3(*x)) for x in zip(t, t[1:], t[2:]))
        out[i] = (len(t) - 1, sum(w in one for w in t[1:]), sum(one.values()), sum(math.log10(p1(w)) for w in t[1:]), model)
    return out


def same_scores(got, wanted):
    assert len(got) == len(wanted)
    for i, row in wanted.items():
        assert got[i][:3] == row[:3] and all(abs(a - b) < 1e-6 for a, b in zip(got[i][3:], row[3:]))


def test_lm_scores(spark):
    from pyspark.sql import functions as F

    from basketloom.llm.holdout import is_fold

    rows, df = random_documents(spark, 6)
    got = {r.doc_id: tuple(r)[1:] for r in lm_score.score(df, ~is_fold(F.col("doc_id"), 7, 2)).collect()}
    same_scores(got, plain_scores(rows, lambda i: fold(i, 7) != 2, lm_score.STRENGTH))


@pytest.mark.parametrize("block, part, piece", [(700_000, 2_000_000, 192), (30, 50, 4), (1, 7, 1), (200, 10, 3)])
def test_lm_scores_use_every_count(spark, monkeypatch, block, part, piece):
    """Whatever texts share a block, however counts are dealt, and wherever texts are cut."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm_score, "PART_TOKENS", part)
    monkeypatch.setattr(lm_score, "PIECE", piece)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    rng = random.Random(11)
    rows = [(k, " ".join(f"v{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(0, 40)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in lm_score.score(df, F.col("doc_id") % 4 != 0, 1.5).collect()}
    same_scores(got, plain_scores(rows, lambda i: i % 4 != 0, 1.5))


def slice_of(texts, learned):
    """The automaton slice of ``texts`` with the counts of ``learned``, and the texts encoded."""
    made = []
    for group in (texts + learned, learned):
        (_, _, b), *_ = textblocks.blocks(pa.array(group))
        tokens = lm_score.tokens(b)
        made.append((tokens, b.n_words + 1))
    words, codes = np.unique(made[0][0], return_inverse=True)
    both = lm_score.Encoded(words, codes, made[0][1])
    learn = np.arange(len(texts + learned)) >= len(texts)
    counts = [both.grams(learn, k)[1] for k in range(3)]
    return lm_score.Slice(both, counts, float(len(made[1][0]) + len(np.unique(made[1][0])) + 1)), both


def test_automaton_sums_to_one():
    """From every state the arcs and the failure arc share out all probability; states carry two words."""
    model, texts = slice_of([], ["the cat sat on the mat the cat ran the dog sat on the cat", "a cat", ""])
    rest = 1 - (10**model.base).sum()  # of all words never seen
    states = np.unique(np.append(model.reached, model.back))
    assert states.max() > model.words and 0 < rest < 0.1
    for state in states:
        gain, to = model.step(np.full(model.words, state), np.arange(model.words))
        lost, at = 0.0, state
        while at:
            lost, at = lost + model.failure[at], model.back[at]
        assert abs((10**gain).sum() + 10**lost * rest - 1) < 1e-9
        seen = np.isin(state * model.words + np.arange(model.words), model.arcs) & (np.arange(model.words) != texts.end)
        assert (to[seen] > model.words).all() and to[texts.end] == model.after[texts.end]


def test_automaton_carries_its_state():
    """Each text read token by token, one state after the other, against the pieces read side by side."""
    rng = random.Random(3)
    group = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 500))) for _ in range(12)]
    model, texts = slice_of(group[:6], group[6:])
    whole = model.read(texts)
    for k in range(len(group)):
        state, total = model.after[texts.end], 0.0
        for t in range(texts.offs[k], texts.offs[k + 1]):
            gain, to = model.step(np.array([state]), texts.codes[t : t + 1])
            state, total = int(to[0]), total + gain[0]
            assert state == model.reached[t]
        assert abs(total - whole[k]) < 1e-6


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:  # water-filling, round by round
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken == r.size * r.repeats <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)


def test_awkward_documents(spark):
    df = awkward(spark)
    rows = pairs(df)
    assert sorted(map(str, components(rows))) == sorted(str(tuple(r)) for r in shingle_join.component_ids(df).collect())
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(df).collect())
    wanted = [(str(i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()) for (i, _), (w, gone) in zip(rows, repeats([t for _, t in rows]))]
    assert got == sorted(wanted)
    got = sorted(str((r.doc_id, *tuple(r)[1:6])) for r in quality_rules.rate(df).collect())
    assert got == sorted(str((i, *rules(t))) for i, t in rows)
    assert all(not r.kept for r in quality_rules.rate(df).collect() if r.n_words == 0)
    assert mixing.mix(df).count() == len(rows)
    from pyspark.sql import functions as F

    scored = lm_score.score(df, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in scored) == sorted(len(words(t)) + 1 for _, t in rows) and all(r.n_known <= r.n_tokens for r in scored)
    kept = shingle_join.one_of_each(df)
    assert kept.columns == df.columns and kept.filter("text is null or trim(text) = ''").count() >= 2
    assert kept.filter(F.col("doc_id") == 5).count() == 1


def test_empty_tables(spark):
    df = nothing(spark)
    from pyspark.sql import functions as F

    assert shingle_join.component_ids(df).count() == 0 and shingle_join.one_of_each(df).count() == 0
    assert substring_dedup.digest(df).count() == 0 and quality_rules.rate(df).count() == 0 and mixing.mix(df).count() == 0
    assert lm_score.score(df, F.lit(True)).count() == 0
    scored = lm_score.score(spark.createDataFrame([("1", "a b")], "doc_id string, text string"), F.lit(False)).first()
    assert (scored.n_tokens, scored.n_known, scored.train_tokens, scored.base_score, scored.score) == (3, 0, 0, 0.0, 0.0)
    assert shingles("") == frozenset()
