"""Fill-in-the-middle: documents cut at two unit boundaries and put together in another order.

Units are isolated matches of a regular expression, found by the Split pre-tokenizer of the tokenizers library,
which needs no training and gives each match's code-point offsets.  The number of offsets is the number of units; cut
points are places in that array, drawn from a hash of the id, so a rerun cuts alike wherever the row is worked on.

Nulls, empty tables and odd rows: a null text counts as empty; an empty text, and one that holds a mark, stays plain.
A null id is hashed as the word null.  Rows alike are cut alike.  Ids may be of any type that is written as text.
Other columns are not looked at.  One text at a time is cut, and results leave in pieces of a few megabytes, so memory
is bounded by that or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .textblocks import column_of

LINES = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 100, 50
SEED = 7
#: Characters after which a task hands on what it has.
FLUSH = 4 << 20


def splitter(pattern: str) -> Split:
    return Split(Regex(pattern), "isolated")


def unit_ends(text: str, split: Split) -> list[int]:
    """Code-point offsets after each unit; as many as there are units."""
    return [end for _, (_, end) in split.pre_tokenize_str(text)] if text else []


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned numbers from the hash of seed and key."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(text: str, key: str, split: Split, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    ends = unit_ends(text, split)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim:
        return len(ends), "plain", None, None, text
    ranked = [0, *ends]
    a, b = sorted((ranked[h1 % len(ranked)], ranked[h2 % len(ranked)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def _cutter(pattern: str, seed: int, fim: int, spm: int, extra: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            texts, keys = column_of(batch, "text"), column_of(batch, "key")
            first, held, rows = 0, 0, []

            def flush(upto: int) -> pa.RecordBatch:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                columns[4] = columns[4].cast(pa.string())
                return pa.RecordBatch.from_arrays([*(column_of(batch, c).slice(first, upto - first) for c in extra), *columns], names=[*extra, "n", "form", "prefix_chars", "middle_chars", "output"])

            for k in range(batch.num_rows):
                rows.append(transform(texts[k].as_py() or "", keys[k].as_py() or "null", split, seed, fim, spm))
                held += len(rows[-1][4])
                if held >= FLUSH:
                    yield flush(k + 1)
                    first, held, rows = k + 1, 0, []
            if rows:
                yield flush(batch.num_rows)

    return run


def cut(documents: DataFrame, pattern: str = LINES, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    ``fim`` percent of the documents are cut, ``spm`` percent of those with the suffix first.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    return rows.mapInArrow(_cutter(pattern, seed, fim, spm, ("doc_id",)), f"doc_id {kind}, {_SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    No piece holds a mark and no two marks overlap, so the first place of each mark is the one that was set.
    """
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    width = len(PREFIX)
    at, end = F.position(first, output), F.position(second, output)
    one, two, middle = F.substring(output, F.lit(width + 1), at - width - 1), F.substring(output, at + width, end - at - width), F.substring(output, end + width, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of output and of the text restored from it."""
    made = cut(documents)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
