"""The registered queries on the smallest tables: columns, folds, SQL, and quality rules against a plain estimate."""

import math
import re
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from basketloom.llm import quality_rules
from basketloom.llm.queries import ORACLES, QUERIES

from .helpers import awkward, rules, words

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")

#: Columns that each query must return, and its held-out fold.
SCORED = {"doc_id", "held_out", "score", "predicted"}
COLUMNS = {
    "op1_decontamination": {"doc_id", "item_id"}, "op2_toxicity": SCORED, "op3_language": {"doc_id", "held_out", "lang_pred", "score"}, "op8_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op10_quality_classifier": SCORED, "op5_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}
FOLDS = {"op2_toxicity": (5, 0), "op3_language": (4, 2), "op8_lm_score": (7, 2), "op10_quality_classifier": (3, 1)}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plainly(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    theirs = con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    ours = QUERIES[name](spark, str(DATA))
    assert sorted(ours.columns) == sorted(columns)
    assert plainly(map(tuple, ours.select(*columns).collect())) == plainly(theirs.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_folds(spark, con, name):
    rows = QUERIES[name](spark, str(DATA)).collect()
    assert COLUMNS[name] <= set(rows[0].asDict())
    if name != "op1_decontamination":
        assert sorted(r.doc_id for r in rows) == [i for (i,) in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    if name in FOLDS:
        m, k = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == k) for r in rows)
    if "predicted" in COLUMNS[name]:
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op8_lm_score":
        assert all(r.score < 0 and r.base_score < 0 and 0 <= r.n_known <= r.n_tokens for r in rows) and len({r.train_tokens for r in rows}) == 1
    if name == "op3_language":
        assert {r.lang_pred for r in rows} <= {x for (x,) in con.execute("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL").fetchall()} | {"und"}


def plain_votes(text):
    """Votes of the rules, from the text alone: 1 good, 0 bad, 2 neither."""
    w, n_words, word_chars, n_symbols, n_dup_lines, n_repeat = words(text), *rules(text)
    t, n = text or "", max(n_words, 1)
    lines = max(sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)), 1)
    letter = lambda c: ("a" <= c.lower() <= "z" and c.isascii()) or len(c.encode()) > 1 and c.encode()[0] >= 0xC0
    letters, upper = sum(map(letter, t)), sum("A" <= c <= "Z" for c in t)
    share = {
        "mean_word": word_chars / n, "symbols": n_symbols / n, "dup_lines": n_dup_lines / lines, "repeats": n_repeat / n, "alpha_words": sum(any(map(letter, x)) for x in w) / n,
        "upper": upper / max(letters, 1), "exclaim": t.count("!") / n, "symbol_words": sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w) / n, "same_next": sum(a == b for a, b in zip(w, w[1:])) / n,
    }
    up = lambda x, good, bad: 1 if x <= good else 0 if x > bad else 2
    down = lambda x, good, bad: 1 if x >= good else 0 if x < bad else 2
    return (
        down(n_words, 60, 30), 1 if 3 <= share["mean_word"] <= 10 else 0 if not 2 <= share["mean_word"] <= 14 else 2, up(share["symbols"], 0.02, 0.1), up(share["dup_lines"], 0.1, 0.3), up(share["repeats"], 0.1, 0.35),
        down(share["alpha_words"], 0.9, 0.7), up(share["upper"], 0.2, 0.5), up(share["exclaim"], 0.05, 0.2), up(share["symbol_words"], 0.02, 0.15), up(share["same_next"], 0.02, 0.1),
    )


def plain_posteriors(texts):
    """Expectation-maximisation document by document, in plain loops."""
    votes = [plain_votes(t) for t in texts]
    m, prior = len(votes[0]), 0.85
    start = {0: (0.35, 0.5, 0.15), 1: (0.01, 0.9, 0.09)}  # by class: bad, good, no vote
    chance = {y: [list(start[y]) for _ in range(m)] for y in (0, 1)}

    def good(v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(chance[1][j][x] / chance[0][j][x]) for j, x in enumerate(v))
        return 1 / (1 + math.exp(-min(500, max(-500, odds))))

    for _ in range(200):
        p = [good(v) for v in votes]
        new = {0: [], 1: []}
        for j in range(m):
            for y in (0, 1):
                seen = [2 * start[y][x] + sum(q if y else 1 - q for q, v in zip(p, votes) if v[j] == x) for x in range(3)]
                new[y].append([s / sum(seen) for s in seen])
            if new[0][j][0] < 20 * new[1][j][0]:
                new[1][j][0] = max(new[0][j][0] / 20, 1e-6)
        share = min(0.98, max(0.5, sum(p) / len(p)))
        moved = max(abs(new[y][j][x] - chance[y][j][x]) for y in (0, 1) for j in range(m) for x in range(3))
        settled = moved < 1e-9 and abs(share - prior) < 1e-9
        chance, prior = new, share
        if settled:
            break
    return [good(v) for v in votes]


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_kept_against_a_plain_estimate(spark, table):
    df = spark.read.parquet(str(DATA / "documents.parquet")) if table == "documents" else awkward(spark)
    df = df.withColumn("doc_id", F.monotonically_increasing_id())
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    wanted = dict(zip(texts, plain_posteriors(list(texts.values()))))
    rows = quality_rules.rate(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.posterior - wanted[r.doc_id]) < 1e-6
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and wanted[r.doc_id] >= 0.5)
