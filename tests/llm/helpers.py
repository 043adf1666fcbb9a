"""Awkward documents, and plain versions of what the operators compute."""

import re
import zlib
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PASSAGE = " ".join(f"w{k}" for k in range(60))
#: Columns of documents, and names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag long, score double, size long, h string, text_key string, cid long, n long, y int, pattern long, row long, cuts string"
CLASHING = (7, 0.5, 3, "h", "k", 1, 2, 1, 4, 5, "c")


def words(text):
    return WORD.findall(text or "")


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters, and columns with clashing names."""
    texts = [
        (1, "the quick brown fox jumps over the lazy dog\nthe quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, "no id here at all, sadly"), (None, None),
        (5, PASSAGE), (5, PASSAGE), (6, PASSAGE + " tail"), (7, "one"), (8, "ONE"), (9, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
        (10, " ".join(f"long{k % 997}" for k in range(30_000))), (11, "é è ñ ß     漢字 🙂"), (12, "###$$$ %%% |||"), (-13, "negative id text"), (14, "x" * 5000),
    ]
    rows = [(i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None if k % 4 == 0 else f"s{k % 3}", len(t) if t else None, *CLASHING) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, score double")


def fold(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def shingles(text):
    w = words((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """Smallest id of each row's group; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def repeats(texts, size=35):
    """Words of each text that a repeated window covers."""
    held = [words(t) for t in texts]
    counts = Counter(tuple(w[k : k + size]) for w in held for k in range(len(w) - size + 1))
    out = []
    for w in held:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if counts[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((w, gone))
    return out


def rules(text):
    t, w = text or "", words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    twice = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)
