"""Decontamination, toxicity, language, archives, classifier, pipeline."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketloom.llm import decontaminate, language, quality_model, sieve, toxicity, warc
from basketloom.llm.textblocks import blocks

from .helpers import awkward, labels, nothing


def test_edit_distance():
    word = lambda t: np.array([hash(w) & (2**63 - 1) for w in t.split()], np.uint64)
    for item, text, wanted in (("a b c d", "x a b c d y", (0, 1, 5)), ("a b c d", "a b d", (1, 0, 3)), ("a b c d", "a b q c d", (1, 0, 5)), ("a b c d", "a z c d", (1, 0, 4))):
        assert decontaminate.distance(word(item), word(text), 3) == wanted
    assert decontaminate.distance(word("a b c d"), word("p q r s"), 2)[0] == 3


@pytest.mark.parametrize("size", [10, 20, 40, 60])
def test_recall_of_the_keys(size):
    assert decontaminate.expected_recall(size, 0) == 1
    assert decontaminate.expected_recall(size, decontaminate.max_edits(size)) >= decontaminate.RECALL - 0.02


def test_edit_distance_cell_by_cell():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        cost = [0] * (len(text) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(cost[j - 1] + (t != w), cost[j] + 1, new[j - 1] + 1))
            cost = new
        edits, first, last = decontaminate.distance(item, text, 30)
        assert edits == min(cost)
        whole = decontaminate.distance(item, text[first:last], 30)  # the stretch itself is that near
        assert whole[0] == edits


@pytest.mark.parametrize("size", [100, 150, 200, 300, 500])
def test_recall_of_long_items(size):
    """Items of any length at the largest distance counted, anywhere in a text."""
    rng = random.Random(size)
    items = [(k, " ".join(f"i{rng.randrange(10**6)}" for _ in range(size))) for k in range(20)]
    index, found = decontaminate.build(items), 0
    for k, text in items:
        w = text.split()
        for _ in range(decontaminate.max_edits(size)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
        around = [f"x{rng.randrange(10**6)}" for _ in range(80)]
        (_, _, b), *_ = blocks(pa.array([" ".join(around + w + around)]))
        found += k in {x[1] for x in decontaminate.search(b, index)}
    assert found >= 18


def test_very_long_item_and_shared_runs():
    """A 2000-word item stays within 500 MB; runs that thousands of items share make no window each."""
    import time
    import tracemalloc

    rng = random.Random(9)
    long = [f"i{rng.randrange(10**6)}" for _ in range(2000)]
    shared = [(k, f"which of the following is item {k} of the list of {rng.randrange(10**6)}") for k in range(3000)]
    tracemalloc.start()
    index = decontaminate.build([(-1, " ".join(long)), *shared])
    began = time.time()
    (_, _, b), *_ = blocks(pa.array([" ".join(long[:700] + ["x"] * 50 + long[700:]) + " which of the following is odd" * 3000]))
    assert [x[1] for x in decontaminate.search(b, index)] == [0]
    assert tracemalloc.get_traced_memory()[1] < 500 << 20 and time.time() - began < 60
    tracemalloc.stop()
    (_, _, b), *_ = blocks(pa.array(["=" * 20_000 + " " + "word " * 50_000]))
    began = time.time()
    assert len(decontaminate.words_of(b)) == 50_001 and time.time() - began < 1


def brute_matches(docs, items):
    out = set()
    for d, t in docs:
        for _, _, b in blocks(pa.array([t], pa.string())):
            w = decontaminate.words_of(b)
            for i, s in items:
                for _, _, c in blocks(pa.array([s], pa.string())):
                    x = decontaminate.words_of(c)
                    most = decontaminate.max_edits(len(x))
                    if len(x) and decontaminate.distance(x, w, most)[0] <= most:
                        out.add((d, i))
    return out


def test_matches(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghjk" for b in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 15, 30, 50])))) for k in range(25)]
    docs = []
    for k in range(90):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        if k % 2:
            w = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 4))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], "extra"], [w[at].upper() + ","]])
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((k, " ".join(body)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    wanted = brute_matches(docs, items)
    assert got <= wanted and len(got) >= 0.95 * len(wanted) and len(wanted) > 20
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench, per_pass=7).collect()}
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {k for k, _ in docs} - {d for d, _ in got}


def test_awkward_matches(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog"), (None, "one"), (4, "... !!!")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert (1, 3) in found and (7, None) in found and (8, None) in found
    assert decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.matches(nothing(spark), bench).count() == 0
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_folding():
    assert toxicity.fold("ST0P1D Ｍоrоn émile") == "stopid moron emile"
    made = toxicity.Lexicon({"moron": 2.0, "stup*": 1.0, "trash": 3.0}).automaton()
    total, largest, density = toxicity.signals("You m0r0n and stupidly, oxymorons trash can", made)
    assert (total, largest) == (3.0, 2.0) and 0 < density < 3
    assert toxicity.signals("", made) == (0.0, 0.0, 0.0) and toxicity.signals("plain words", made) == (0.0, 0.0, 0.0)
    assert toxicity.signals("any", toxicity.Lexicon({}, ()).automaton()) == (0.0, 0.0, 0.0)


def labelled(spark, seed=3, n=900):
    rng = random.Random(seed)
    rows, marks = [], []
    for k in range(n):
        w = [f"{rng.choice('abcde')}{rng.choice('aeiou')}{rng.choice('xyz')}{rng.randint(0, 500)}" for _ in range(rng.randint(20, 120))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grulk", "GRULK!", "zarp" + rng.choice("aeio") + "x", "gru1k"]))
        if bad:
            w = [x + rng.choice(["", "###", "|"]) for x in w]
        rows.append((k, " ".join(w)))
        if k % 3:
            marks.append((k, int(not bad), int(toxic), 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels(spark, marks), {m[0]: m for m in marks}


def test_toxicity_learns(spark):
    df, marks, truth = labelled(spark)
    lexicon = toxicity.train(df, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    held = [k for k in truth if k % 5 == 0]
    assert sum((got[k] >= 0.5) == truth[k][2] for k in held) / len(held) > 0.95
    assert len(got) == 900 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_against_plain_loops(spark):
    """Learning, curve and scores against loops over a small fixture, with ids that are text."""
    import re

    df, marks, truth = labelled(spark, 8, 240)
    df, marks = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), marks.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    lexicon = toxicity.train(df, marks, F.lit(True))
    texts = {r.doc_id: r.text for r in df.collect()}
    pieces = {}
    for k, (_, _, toxic, _) in truth.items():
        whole = set(re.findall(r"[^\W_]+", toxicity.fold(texts[f"d{k}"])))
        pieces[k] = toxic, whole | {w[:n] + "*" for w in whole for n in (5, 6) if len(w) > n}
    weights = {}
    n1 = sum(t for t, _ in pieces.values())
    for w in set().union(*(p for _, p in pieces.values())):
        holds = [t for t, p in pieces.values() if w in p]
        share1, share0 = (sum(holds) + 0.5) / (n1 + 1), (len(holds) - sum(holds) + 0.5) / (len(pieces) - n1 + 1)
        if sum(holds) >= 4 and np.log(share1 / share0) > 1.2:
            weights[w] = np.log(share1 / share0)
    assert lexicon.weights.keys() == weights.keys() and all(abs(lexicon.weights[w] - weights[w]) < 1e-9 for w in weights)
    for r in toxicity.score(df, lexicon).collect():
        hits, folded = {}, toxicity.fold(texts[r.doc_id])
        for w in set(re.findall(r"[^\W_]+", folded)):
            here = [x for t, x in weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
            if here:
                hits[w] = max(here)
        total = sum(hits.values())
        a = lexicon.curve
        margin = a[0] + a[1] * np.log1p(total) + a[2] * max(hits.values(), default=0) + a[3] * total / (1 + len(set(folded.split()))) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-9


def test_common_and_rare_toxic_words_alike(spark):
    """Words of a small language with clean documents against them, and phrases at home in clean documents."""
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(1200):
        small, toxic = rng.random() < 0.15, rng.random() < 0.12
        w = [f"{'q' if small else 'e'}{rng.randint(0, 150)}" for _ in range(40)]
        if toxic:
            w[::7] = [f"{'bad' if not small else 'mal'}{rng.randint(0, 3)}" for _ in w[::7]]
        elif rng.random() < 0.1:  # clean documents hold such words too
            w[5] = rng.choice(["bad1", "mal1"])
        if not toxic and rng.random() < 0.1:
            w[9:11] = ["bad2", "company"]
        rows.append((k, " ".join(w), small, toxic))
        marks.append((k, 1, int(toxic), 0.0))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    lexicon = toxicity.train(df, labels(spark, marks), F.col("doc_id") % 5 != 0)
    assert "bad2 company" in lexicon.exceptions and {"badi", "malo"} <= lexicon.weights.keys()
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(df, lexicon).collect()}
    for kind in (True, False):
        held = [(got[k], toxic) for k, _, small, toxic in rows if k % 5 == 0 and small == kind]
        assert sum(g for g, t in held if t) >= 0.8 * sum(t for _, t in held) and sum(g for g, t in held if not t) <= 0.03 * len(held)


def test_trees_node_by_node():
    """Scores against a walk row by row, and the first split against a search of all cuts."""
    rng = np.random.default_rng(7)
    x, y = rng.random((300, 4)).astype(np.float32), (rng.random(300) < 0.4).astype(float)
    y[x[:, 2] > 0.6] = 1
    model = quality_model.fit_trees(x, y, trees=5, depth=3, bins=400)
    for row, got in zip(x[:50], model.margin(x[:50])):
        total = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        assert abs(total - got) < 1e-9
    share = (y.sum() + 0.5) / 301
    best = (0, None, None)
    for j in range(4):
        for c in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= c
            if min(low.sum(), (~low).sum()) * share * (1 - share) >= 3:
                gain = sum((y[s] - share).sum() ** 2 / (s.sum() * share * (1 - share) + 1) for s in (low, ~low))
                best = max(best, (gain, j, float(c)))
    assert (model.feature[0, 0], round(float(model.cut[0, 0]), 6)) == (best[1], round(best[2], 6))


def test_classifier_learns(spark):
    df, marks, truth = labelled(spark)
    model = quality_model.train(df, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect()}
    held = [k for k in truth if k % 5 == 0]
    assert sum((got[k] >= 0.5) == truth[k][1] for k in held) / len(held) > 0.95
    again = quality_model.train(df.repartition(7), marks, F.col("doc_id") % 5 != 0)
    assert np.array_equal(model.value, again.value)


def test_trees_split_where_they_should():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_model.fit_trees(x, y, trees=40, depth=3)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    assert quality_model.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality_model.fit_trees(x, np.ones(2000)).score(x[:2]) > 0.99).all()


def test_awkward_models(spark):
    df = awkward(spark)
    for marks in (labels(spark), labels(spark, [(1, 1, 0, 0.1), (5, 0, 1, 0.1), (5, 1, 0, 0.1), (None, 1, 1, 0.1), (7, None, None, None), (2, 0, 0, 0.0)])):
        lexicon, model = toxicity.train(df, marks, F.lit(True)), quality_model.train(df, marks, F.lit(True))
        for out in (toxicity.score(df, lexicon), quality_model.score(df, model)):
            rows = out.collect()
            assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(nothing(spark), lexicon).count() == 0 and quality_model.score(nothing(spark), model).count() == 0
    toxicity.train(nothing(spark), labels(spark), F.lit(True))
    assert quality_model.score(df, model, "score", "size", name="_q").columns == ["doc_id", "score", "size", "_q"]


def naive_bits(texts, text):
    """Code length by following the escapes one byte at a time."""
    top = language.ORDER
    plain = lambda t: [32] * top + [32 if c in (32, *range(9, 14)) else c for c in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t).encode()]
    counts = [{} for _ in range(top + 1)]
    for t in texts:
        s = plain(t)
        for k in range(top, len(s)):
            for o in range(top + 1):
                c = counts[o].setdefault(tuple(s[k - o : k]), {})
                c[s[k]] = c.get(s[k], 0) + 1
    s, bits = plain(text), 0.0
    for k in range(top, len(s)):
        for o in range(top, -1, -1):
            c = counts[o].get(tuple(s[k - o : k]))
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if s[k] in c:
                bits -= np.log2(c[s[k]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths():
    model = language.fit([("en", "the cat and the dog"), ("en", "a hat"), ("fr", "le chat et le chien"), ("ru", "кот и собака")])
    assert model.languages == ["en", "fr", "ru"]
    for text in ("the hat", "Le\tCHAT", "zzz", "é€", "собака", "собр"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = language.lengths(model, data, np.array([0, len(data)]))[0]
        for k, known in enumerate((["the cat and the dog", "a hat"], ["le chat et le chien"], ["кот и собака"])):
            assert abs(got[k] - naive_bits(known, text)) < 0.002 * len(data)
    two = language.lengths(model, np.frombuffer(b"the hatle chat", np.uint8), np.array([0, 7, 7, 14]))
    assert np.allclose(two[0], language.lengths(model, np.frombuffer(b"the hat", np.uint8), np.array([0, 7]))[0]) and (two[1] == 0).all()


def test_language_predictions(spark):
    rng = random.Random(1)
    texts = {"en": "the and of ing tion her th re ed".split(), "fr": "le et de eau oui ment que éa".split()}
    rows = [(k, " ".join(rng.choice(texts[("en", "fr")[k % 2]]) for _ in range(25)), ("en", "fr")[k % 2] if k % 7 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert sum(got[k] == ("en", "fr")[k % 2] for k in got) / 200 > 0.98


def test_every_language_is_learned(spark, monkeypatch):
    """Twenty languages, some in other scripts, in several passes with the results of a single one."""
    rng = random.Random(4)
    names = [f"l{k:02}" for k in range(20)]
    letters = {n: ("abcdefghijklmnop", "абвгдежзиклмнопр", "αβγδεζηθικλμνξοπ", "あいうえおかきくけこさしすせそ")[min(k // 14 + k % 3 * (k // 14), 3)] for k, n in enumerate(names)}
    words = {n: ["".join(rng.choice(letters[n]) for _ in range(4)) for _ in range(12)] for n in names}
    rows = [(k, " ".join(rng.choice(words[n]) for _ in range(20)), n) for k in range(240) for n in [names[k * 7 % 19 if k % 9 else 19]]] + [(900, "123 456", "l01"), (901, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(language, "LANGUAGES", 32)
    whole = {r.doc_id: r for r in language.predict(df, language.train(df, F.col("doc_id") % 5 != 2)).collect()}
    monkeypatch.setattr(language, "LANGUAGES", 8)
    models = language.train(df, F.col("doc_id") % 5 != 2)
    assert [m.value.languages for m in models] == [names[k : k + 8] for k in (0, 8, 16)]
    got = {r.doc_id: r for r in language.predict(df, models).collect()}
    assert len(got) == len(rows)
    for k, _, n in rows:
        a, b = got[k], whole[k]
        assert a.lang_pred == b.lang_pred == (n if k < 900 else "und")
        assert abs(a.score - b.score) < 1e-9 and abs(a.bits_per_byte - b.bits_per_byte) < 1e-9


def test_a_long_text_does_not_shut_out_others(spark):
    rng = random.Random(6)
    words = {n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(12)] for n in ("l0", "l1")}
    rows = [(k, " ".join(rng.choice(words[f"l{k % 2}"]) for _ in range(20)), f"l{k % 2}") for k in range(60)]
    first = spark.range(0, 60, 2).orderBy(F.xxhash64("id")).first().id
    rows[first] = (first, "zzzz " * 4000, "l0")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.train(df, F.lit(True), most_bytes=8000)).collect()}
    assert all(got[k] == n for k, _, n in rows)


def test_awkward_languages(spark):
    df = awkward(spark)
    got = [(r.text, p.lang_pred, p.score) for r, p in zip(df.collect(), language.predict(df, language.train(df, F.lit(True))).collect())]
    for text, pred, score in got:
        lettered = text is not None and any(c.isalpha() for c in text)
        assert (pred == "und") == (not lettered) and 0 <= score <= 1
    none = language.train(nothing(spark), F.lit(True))
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"} and language.predict(nothing(spark), none).count() == 0


def test_archives(spark, monkeypatch):
    big, other = "<p>é" + "x" * 1200, "y" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9%\r\n", big), (3, "u", other), (4, "u", other), (5, None, None), (6, "", ""), (None, "http://n", "z" * 2000), (7, "\r", "q" * 1000), (8, "w", "q" * 1000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, digest string, n int").repartition(3)
    folder, index = warc.write(df)
    got = {r.page_id: r for r in warc.read(folder, index).collect()}
    refers = {1: 9, 2: 9, 7: 8}
    for page_id, url, html in rows:
        payload, r = (html or "").encode(), got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest()) and r.url == url
        assert (r.record_type, r.refers_to) == (("revisit", refers[page_id]) if page_id in refers else ("response", None))
        assert r.payload == (None if page_id in refers else (html or ""))
    some = warc.read(folder, index.filter("page_id in (3, 9)")).collect()
    assert {r.page_id for r in some} == {3, 9}
    twice = spark.createDataFrame([(1, "a", big), (1, "a", big), (1, "b", big), (None, None, big)], "page_id long, url string, html string")
    kinds = sorted((r.record_type, r.refers_to or 0) for r in warc.read(*warc.write(twice)).collect())
    assert kinds == [("response", 0), ("revisit", 1), ("revisit", 1), ("revisit", 1)]
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)  # then large payloads are shuffled
    alike = spark.createDataFrame([(2, "a", big), (2, "a", big), (2, "a", big), (1, "b", big), (3, "c", other), (3, "c", other)], "page_id long, url string, html string").repartition(3)
    read = warc.read(*warc.write(alike)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in read) == [(1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (2, "revisit", 2), (3, "response", 0), (3, "response", 0)]
    assert sorted(r.payload for r in read if r.payload) == sorted([big, other, other]) and all(r.payload_bytes == len((big if r.page_id < 3 else other).encode()) for r in read)
    folder, index = warc.write(df.limit(0))
    assert index.count() == 0 and warc.read(folder, index).count() == 0


def test_coalesced_ranges():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (103, 40)], gap=20, span=1000) == [(0, 15, 0, 2), (100, 43, 2, 4)]
    assert warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=5, span=20) == [(0, 20, 0, 2), (20, 10, 2, 3)]
    assert warc.coalesced([]) == []


def test_sieve(spark):
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    made = sieve.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 5000).load()
    assert sieve.may_hold(made, keys).all()
    assert sieve.may_hold(made, np.random.default_rng(4).integers(-(2**62), 2**62, 20_000)).mean() < 0.1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    df, marks, _ = labelled(spark, 5, 240)
    copies = df.limit(20).withColumn("doc_id", F.col("doc_id") + 1000)
    docs = df.union(copies).select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    leaked = docs.filter("doc_id = 2").first().text
    spark.createDataFrame([(1, " ".join(leaked.split()[:15]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "substring_dedup", "decontamination", "mixing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert 0 < after.count() <= now.count()
        if k < 4:
            assert after.columns == docs.columns
        now = after
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) and 2 not in ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == sorted(ids)


def test_pipeline_of_awkward_documents(spark, tmp_path):
    """Each stage alone on null, empty, long and repeated rows, with extra columns of the operators' own inner names."""
    import corpus_pipeline

    names = "tag score _score wordless size h text_key _text_key cuts key cid comp n n_words n_removed kept_text target taken repeats source_size c0 c3 row part y".split()
    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(names)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(1, 1, 0, 0.0), (12, 0, 0, 0.0)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs.collect()
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        got[name] = out.collect()
        assert all(r[c] == f"x{k}" for r in got[name] for k, c in enumerate(names))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == out.columns and empty.count() == 0
    rows = lambda rs: sorted((str(r.doc_id), str(r.text)) for r in rs)
    once = rows(r for r in before if r.doc_id not in (5, 6, 8)) + [("5", rows(r for r in before if r.doc_id == 5)[0][1])]
    assert rows(got["near_duplicates"]) == sorted(once)  # 6 is near 5, which stands twice; 8 is 7 in capitals
    cut = {str(r.doc_id): r for r in got["substring_dedup"]}
    assert cut["6"].text == "tail" and cut["6"].n_chars == 4 and not {"5", "9", "10"} & cut.keys() and len(got["substring_dedup"]) == len(before) - 4
    assert rows(got["decontamination"]) == rows(r for r in before if r.doc_id not in (7, 8))
    assert all(r.repeats_ >= 1 and r.taken_ == r.size_ * r.repeats_ and r.source_size_ >= r.size_ for r in got["mixing"])
    assert set(rows(got["mixing"])) <= set(rows(before)) and set(rows(got["quality_classifier"])) <= set(rows(before))
    corpus_pipeline.run(spark, str(tmp_path)).count()
