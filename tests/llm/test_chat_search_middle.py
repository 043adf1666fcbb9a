"""Chat formatting, ranked lexical search, fill-in-the-middle: against plain versions, brute force and exact round trips."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketloom.llm import chat, fill_in_middle, lexical_search
from basketloom.llm.queries import _FORGED, ORACLES, QUERIES

from .helpers import ASCII_LOWER, CLASHING, SCHEMA, awkward, nothing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting.

RECORDS = [
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "", "history": [["q", "a"], ["r", None]]}, "instruction", [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", ""), ("user", "do"), ("assistant", "")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}, None, {"role": "gpt", "content": "x"}]}, "messages", [("system", "s"), ("user", ""), ("gpt", "x")]),
    ({"prompt": "again", "messages": [{"role": "user", "content": "again"}, {"role": "assistant"}]}, "messages", [("user", "again"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"value": "v"}]}, "from_value", [("user", "h"), ("assistant", "g"), ("", "v")]),
    ({"system": "s", "dialogue": [{"speaker": {"role": "human"}, "parts": {"text": "h"}}, {"speaker": {"role": "bot"}}]}, "dialogue", [("system", "s"), ("user", "h"), ("assistant", "")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": "p", "completion": "c", "question": "q"}, None, None),
    ({"messages": []}, None, None),
    ({"unknown": 1}, None, None),
    ({}, None, None),
]


def test_layouts_by_fingerprint(spark):
    """JSON records of all layouts in one column; columns that clash with added and inner names are carried along."""
    rows = spark.createDataFrame([(k, json.dumps(r), "l", "t", "f", k) for k, (r, _, _) in enumerate(RECORDS)], "id int, j string, layout string, Turns string, fingerprint string, c0 int")
    read = rows.select("*", F.from_json("j", chat.json_schema()).alias("r")).select("id", "layout", "Turns", "fingerprint", "c0", "r.*")
    out = chat.canonical(read)
    assert out.columns[:5] == read.columns[:5] and out.columns[-3:] == ["fingerprint_", "layout_", "turns_"]
    got = {r["id"]: r for r in out.collect()}
    for k, (record, layout, turns) in enumerate(RECORDS):
        assert got[k]["layout_"] == layout, record
        assert (None if got[k]["turns_"] is None else [tuple(t) for t in got[k]["turns_"]]) == turns
    known = chat.fingerprints(chat.LAYOUTS)
    assert all(known.get(got[k]["fingerprint_"]) == layout for k, (_, layout, _) in enumerate(RECORDS))
    assert len({got[k]["fingerprint_"] for k in (9, 10)}) == 2  # what is declared nowhere can be told apart


def test_records_without_most_fields(spark):
    """A schema that lacks the optional paths, a field of another kind, and no field at all."""
    rows = spark.createDataFrame([(1, "p", 2.5), (2, None, 1.0)], "id int, prompt string, completion double")
    assert [(r.id, r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical(rows).orderBy("id").collect()] == [(1, "prompt_completion", [("user", "p"), ("assistant", "2.5")]), (2, None, None)]
    assert [r.layout for r in chat.canonical(spark.range(2)).collect()] == [None, None]
    assert chat.formatted(chat.canonical(rows.limit(0))).count() == 0
    back = chat.read_back(chat.formatted(chat.canonical(spark.range(1)))).first()
    assert (back.formatted, back.turns_back, back.loss) == (None, None, None)


def test_two_layouts_of_one_set_of_paths():
    one = chat.Layout("one", ("a",), ("b",), ())
    with pytest.raises(ValueError, match="both claim"):
        chat.fingerprints((one, chat.Layout("two", ("a", "b"), (), ())))


def test_marks_in_texts_come_back(spark):
    rng = random.Random(5)
    bits = ["<", "|", "\\", ">", "<|im_start|>", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\n", "\n", "é", "🙂", "$1", "\\n", "\\b", "a", ""]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = [(k, [(rng.choice(["user", "assistant", "system", text()]), text()) for _ in range(rng.randint(0, 6))]) for k in range(300)]
    out = chat.read_back(chat.formatted(spark.createDataFrame(rows, f"id int, turns {chat.TURNS}"))).collect()
    for r in out:
        turns = dict(rows)[r.id]
        assert [tuple(t) for t in r.turns_back] == turns
        assert r.formatted.count(chat.START) == r.formatted.count("<|im_end|>") == len(turns)
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        for m in r.loss_mask:
            under = r.formatted[m.start : m.start + m.chars]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", under) == turns[m.turn][1] and turns[m.turn][0] == "assistant"
            assert r.formatted.split(chat.START)[m.turn + 1][m.within - len(chat.START) :][: m.chars] == under


def plain_digests(rows):
    out = {}
    for i in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == i)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        esc = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
        size = sum(len("<|im_start|>\n<|im_end|>\n") + len(role) + len(esc(text)) for _, role, text in turns)
        out[i] = (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)), len(loss), sha(loss), size)
    return out


def test_conversations_of_rows(spark):
    """A conversation of many parts, null ids, turns, roles and texts, ties, repeated rows, clashing columns."""
    rows = [(k % 7, k // 7, ("user", "assistant")[k % 2], f"text {k} <| {k}") for k in range(70)] + [(9, k, "assistant", f"t{k}") for k in range(-300, 1500)]
    rows += [(None, 0, None, None), (None, 1, "user", "x"), (20, None, "user", "late"), (20, 0, "assistant", None), (21, 1, "b", "y"), (21, 1, "a", "z"), (21, 1, "a", "z"), (22, 0, "assistant", "é🙂")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "m", "p", "q") for r in rows], "conv_id long, turn long, role string, text string, m string, part string, messages string").repartition(3)
    for per_part in (4, 64):
        found = chat.digest(chat.formatted(chat.canonical(chat.gathered(df, per_part))))
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in found.collect()} == plain_digests(rows)
    assert chat.digest(chat.formatted(chat.canonical(chat.gathered(df.limit(0))))).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Fill-in-the-middle.


def plain_middle(i, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digits = sha(f"7:{'null' if i is None else i}")
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return i, len(units), "plain", None, None, t, sha(t)
    spm = h[3] % 100 < 50
    return i, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", sha(t)


def odd_texts():
    rng = random.Random(3)
    bits = ["\n", "a", "é", "🙂", "<", "P>", "S", ">", "<M", "\r", "\x00", " ", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["<P>", "x\n<S>", "<M>\n", "\n\n\n", "no line", None]


def test_middle_against_plain(spark):
    rows = list(enumerate(odd_texts())) + [(None, "a\nb\nc"), (-5, "a\nb\nc"), (-5, "a\nb\nc"), (7, "\n".join(f"line {k}" for k in range(30_000)))]
    df = spark.createDataFrame([(*r, "k", 1, "plain") for r in rows], "doc_id long, text string, key string, n int, form string").repartition(3)
    made = fill_in_middle.cut(df).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, sha(r.back)) for r in made.collect()]
    assert sorted(got, key=str) == sorted((plain_middle(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.digest(nothing(spark)).count() == 0
    assert fill_in_middle.digest(awkward(spark)).count() == awkward(spark).count()
    ids = fill_in_middle.cut(df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), fim=0)
    assert {r.form for r in ids.collect()} == {"plain"}


def test_middle_in_pieces(monkeypatch):
    """What is handed on early is the same rows."""
    monkeypatch.setattr(fill_in_middle, "FLUSH", 5)
    texts = odd_texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], names=["doc_id", "key", "text"])
    pieces = list(fill_in_middle._cutter(fill_in_middle.LINES, 7, 100, 50, ("doc_id",))(iter([batch.slice(1)])))
    assert len(pieces) > 50
    assert [tuple(r.values()) for p in pieces for r in p.to_pylist()] == [plain_middle(*r)[:6] for r in list(enumerate(texts))[1:]]


# Ranked lexical search.

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_ranks(documents, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(ASCII_LOWER)))) for i, t in documents]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(TERM.findall((t or "").translate(ASCII_LOWER)))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c in held:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in terms.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def collection(seed, n=400):
    """Texts of several topics, copies, ties, and odd characters."""
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdéß')}{k}" for k in range(120)]
    texts = [" ".join(rng.choice(words[30 * (k // 100) :][:50]) for _ in range(rng.choice([1, 5, 30, 80]))) for k in range(n)]
    texts[20:60] = [texts[20]] * 40
    texts[70:80] = ["A1-a1 x y.Z", "", None, " .,;", "漢字 漢字", "a1" * 50, "é" * 9, "B2 b2_b2", "a\x00b", "0"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[20]), (5, texts[20]), (3, texts[3])]
    items = [(k, " ".join(rng.choice(texts[100 * (k % 4) :][:100] or [""]) or "" for _ in range(2))) for k in range(12)]
    return rows, items + [(50, None), (51, "..."), (52, "nowhere"), (53, texts[20]), (53, "漢字"), (None, "a1 A1")]


def ranks(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("seed, block, per_pass, first", [(1, 1 << 18, 20_000, 8), (2, 300, 20_000, 2), (3, 1, 4, 1)])
def test_ranks_against_brute_force(spark, monkeypatch, seed, block, per_pass, first):
    """Whatever the size of blocks, with one pass or several."""
    monkeypatch.setattr(lexical_search, "QUERIES_PER_PASS", per_pass)
    monkeypatch.setattr(lexical_search, "FIRST", first)
    rows, items = collection(seed)
    documents = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "doc_id long, text string, block int, docs string, score int").repartition(3)
    asked = spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, term string")
    assert ranks(lexical_search.ranked(documents, asked, block_text=block)) == sorted(plain_ranks(rows, items), key=str)


def test_ranks_of_odd_tables(spark):
    asked = spark.createDataFrame([(1, "fox dog"), (2, "w3 w4 漢字")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert ranks(lexical_search.ranked(awkward(spark), asked)) == sorted(plain_ranks(docs, [(1, "fox dog"), (2, "w3 w4 漢字")]), key=str)
    assert ranks(lexical_search.ranked(nothing(spark), asked)) == []
    assert ranks(lexical_search.ranked(awkward(spark), asked.limit(0))) == []
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    found = ranks(lexical_search.ranked(named, spark.createDataFrame([("q", "x")], "item_id string, text string"), 2))
    assert [r[:3] for r in found] == [("q", 1, "a"), ("q", 2, "b")]


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """Blocks come in the order of their bounds; once the bound is below the tenth score no block is opened."""
    import numpy as np

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + str(b) for _ in range(50)) for b in range(20) for _ in range(30)]
    column = pa.array(texts)
    lengths = sum(len(t.split()) for t in texts)
    packed = [lexical_search.pack_block(b, len(texts), lengths) | {"lo": lo, "n": b.n} for lo, _, b in lexical_search.blocks(lexical_search.terms_only(column), 50 * 3 * 30)]
    assert len(packed) >= 20
    names = ["sizes", "vocabulary", "largest", "holders", "starts", "terms", "counts"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([list(range(p["lo"], p["lo"] + p["n"])) for p in packed]), pa.array(range(len(packed))), *(pa.array([p[c].tobytes() for p in packed], pa.binary()) for c in names)], names=["docs", "block", *names],
    )
    words = "a3 b3 c3 a7".split()
    h = lexical_search.Block(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, 11])).word_hashes()
    vocabulary, term = np.unique(h, return_inverse=True)
    queries = lexical_search.Queries([1], np.array([0, 4]), term, np.ones(4, np.int64), vocabulary, np.full(4, 3000), np.zeros(1, np.int64))
    opened = []
    real = lexical_search._Opened
    monkeypatch.setattr(lexical_search, "_Opened", lambda b, row, *rest: opened.append(row) or real(b, row, *rest))
    shared = type("Shared", (), {"value": queries})
    (out,) = lexical_search._scorer(shared, len(texts), lengths, 10, pa.int64(), pa.int64())(iter([batch]))
    assert 0 < len(opened) <= 4 and out.num_rows == 10
    assert {texts[d].split()[0][1:] for d in out.column(2).to_pylist()} == {"3"}


# The queries themselves.


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_lexical_search", "op13_fill_in_middle"])
def test_query_against_sql(spark, tmp_path, name):
    import duckdb

    rows, items = collection(6)
    documents = [(i, t, "en", "s", 1, *CLASHING) for i, t in rows if i is not None] + [(1000 + k, t, "en", None, 1, *CLASHING) for k, t in enumerate(odd_texts())]
    documents = [(k, *r[1:]) for k, r in enumerate(documents)]
    talk = [(k % 9, k // 9, ("system", "user", "assistant")[k % 3], None if k == 4 else f"say {k} {_FORGED * (k % 2)} <\\\\| <\\|") for k in range(60)]
    tables = {
        "documents": spark.createDataFrame(documents, SCHEMA), "benchmark": spark.createDataFrame([(i, t) for i, t in items if i is not None], "item_id long, text string"),
        "conversations": spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"),
    }
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    ours, theirs = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(*columns).collect()), key=str) == sorted(theirs.fetchall(), key=str)
