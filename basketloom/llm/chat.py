"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records come in many layouts: prompt and completion, instruction with input and output, lists of messages, lists
of from/value objects, histories of question and answer.  A record's fingerprint is the hash of the nested field
paths that it fills (``messages[].role``, ``instruction``, ...), of those that some declared layout knows.  The
fingerprint selects the layout, and the layout says which paths make which turns.  What comes out is one shape for
all: ``turns``, an array of (role, text).

A template marks each turn; a backslash is set between ``<`` and ``|`` of every text (and one more where some
stand there already), so no text can hold a mark, and taking one out gives the text back.  Roles are escaped in the
same way, line breaks in them too.  The loss mask names the stretches of the formatted text that a model is trained
on: the texts of the assistant's turns, without marks.

Nulls, empty tables and odd rows: a record whose set of paths no layout declares (nothing filled, or two layouts at
once) has a null layout and null turns, and its fingerprint tells which sets occur.  A null text of a turn is empty,
a null role too; a null turn in a list is skipped.  An empty list fills no path.  Rows alike each stay.  Columns
that no layout names may be there under any name.  In ``gathered`` a null id is a conversation of its own, turns of
equal number are in order of role and text, and those without a number come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .store import free_name

#: Turn numbers of one part of a gathered conversation; parts are formatted apart from each other.
TURNS_PER_PART = 64

#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
#: Names that other layouts give to the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "bing": "assistant", "model": "assistant"}

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Said:
    """One turn of a fixed role from flat fields; those that are filled are joined by an empty line."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each object of a list; ``roles`` renames."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Pairs:
    """Two turns, user and assistant, for each (question, answer) of a list of lists."""

    path: str


@dataclass(frozen=True)
class Layout:
    """Paths that a record must fill, paths that it may fill, and the turns in order."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[Said | Each | Pairs, ...]

    def path_sets(self) -> Iterator[frozenset[str]]:
        for n in range(len(self.may) + 1):
            for some in combinations(self.may, n):
                yield frozenset(self.needs + some)


_RENAMED = tuple(ROLES.items())
LAYOUTS = (
    Layout("messages", ("messages[].role",), ("messages[].content", "prompt"), (Each("messages", "role", "content"),)),
    Layout("from_value", ("conversations[].from",), ("conversations[].value", "system"), (Said("system", ("system",)), Each("conversations", "from", "value", _RENAMED))),
    Layout("dialogue", ("dialogue[].speaker.role", "dialogue[].parts.text"), ("system",), (Said("system", ("system",)), Each("dialogue", "speaker.role", "parts.text", _RENAMED))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout(
        "instruction", ("instruction", "output"), ("input", "system", "history[][]"),
        (Said("system", ("system",)), Pairs("history"), Said("user", ("instruction", "input")), Said("assistant", ("output",))),
    ),
    Layout("question_answer", ("question", "answer"), ("context",), (Said("user", ("context", "question")), Said("assistant", ("answer",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(layouts: Iterable[Layout]) -> dict[str, str]:
    """Layout name by fingerprint; two layouts that claim one set of paths are an error."""
    found: dict[str, str] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            if found.setdefault(fingerprint(paths), layout.name) != layout.name:
                raise ValueError(f"{layout.name} and {found[fingerprint(paths)]} both claim {sorted(paths)}")
    return found


def field_paths(kind: DataType, before: str = "") -> Iterator[str]:
    """Nested paths of a schema's leaves: dots between fields, [] after lists."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from field_paths(f.dataType, f"{before}.{f.name}" if before else f.name)
    elif isinstance(kind, ArrayType):
        yield from field_paths(kind.elementType, before + "[]")
    else:
        yield before


def json_schema(layouts: Iterable[Layout] = LAYOUTS) -> StructType:
    """The schema under which JSON records of any of the layouts are read (``from_json``, or ``spark.read.schema``)."""
    tree: dict = {}
    for path in sorted({p for layout in layouts for p in layout.needs + layout.may}):
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def build(node: dict) -> StructType:
        out = StructType()
        for step, inner in node.items():
            kind = build(inner) if inner else StringType()
            for _ in range(step.count("[]")):
                kind = ArrayType(kind)
            out.add(step.replace("[]", ""), kind)
        return out

    return build(tree)


def _filled(at: Column, steps: list[str]) -> Column:
    """Whether a value is there at the end of the path: steps are field names and [] for any item of a list."""
    if not steps:
        return at.isNotNull()
    if steps[0] == "[]":
        return F.coalesce(F.exists(at, lambda x: _filled(x, steps[1:])), F.lit(False))
    return _filled(at.getField(steps[0]), steps[1:])


def _steps(path: str) -> list[str]:
    return [s for s in path.replace("[]", ".[]").split(".") if s]


class _Records:
    """Columns of records by declared name; a schema may lack most of what the layouts know."""

    def __init__(self, df: DataFrame):
        self.inner = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
        self.at = {name: f"c{k}" for k, name in reversed(list(enumerate(df.columns)))}
        self.kinds = {f.name: f.dataType for f in reversed(df.schema.fields)}
        self.paths = {p for name, kind in self.kinds.items() for p in field_paths(kind, name)}

    def column(self, name: str) -> Column:
        return F.col(self.at[name])

    def filled(self, path: str) -> Column:
        name, *rest = _steps(path)
        return _filled(self.column(name), rest)

    def turns(self, part: Said | Each | Pairs) -> Column | None:
        if isinstance(part, Said):
            texts = [self.column(p).cast("string") for p in part.paths if p in self.paths]
            if not texts:
                return None
            turn = F.struct(F.lit(part.role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))
            return F.when(F.coalesce(*texts).isNotNull(), F.array(turn)).otherwise(F.array().cast(TURNS))
        if part.path not in self.at:
            return None
        rows = self.column(part.path)
        if isinstance(part, Pairs):
            made = F.flatten(F.transform(F.filter(rows, lambda x: x.isNotNull()), lambda x: F.array(
                F.struct(F.lit("user").alias("role"), F.coalesce(F.get(x, 0).cast("string"), F.lit("")).alias("text")),
                F.struct(F.lit("assistant").alias("role"), F.coalesce(F.get(x, 1).cast("string"), F.lit("")).alias("text")),
            )))
        else:
            def turn(x: Column) -> Column:
                role = self._within(x, part.path, part.role)
                for said, meant in part.roles:
                    role = F.when(self._within(x, part.path, part.role) == said, F.lit(meant)).otherwise(role)
                return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(self._within(x, part.path, part.text), F.lit("")).alias("text"))

            made = F.transform(F.filter(rows, lambda x: x.isNotNull()), turn)
        return F.coalesce(made, F.array().cast(TURNS))

    def _within(self, x: Column, path: str, inner: str) -> Column:
        if f"{path}[].{inner}" not in self.paths:
            return F.lit(None).cast("string")
        for step in inner.split("."):
            x = x.getField(step)
        return x.cast("string")


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records, all columns as they were, with ``fingerprint``, ``layout`` and ``turns``.

    Where the records have a column of such a name, the added one gets underscores after it.
    """
    of = _Records(records)
    known = sorted({p for layout in layouts for p in layout.needs + layout.may} & of.paths)
    filled = F.concat_ws("\n", *(F.when(of.filled(p), F.lit(p)) for p in known)) if known else F.lit("")
    rows = of.inner.withColumn("f", F.sha2(filled, 256))
    claims = fingerprints(layouts)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        prints = [p for p, claimed in claims.items() if claimed == layout.name]
        parts = [p for p in map(of.turns, layout.turns) if p is not None]
        if set(layout.needs) <= of.paths and parts:
            name = F.when(F.col("f").isin(prints), F.lit(layout.name)).otherwise(name)
            turns = F.when(F.col("f").isin(prints), F.concat(*parts).cast(TURNS)).otherwise(turns)
    out, bear = [F.col(f"c{k}").alias(c) for k, c in enumerate(records.columns)], list(records.columns)
    for added, value in (("fingerprint", F.col("f")), ("layout", name), ("turns", turns)):
        bear.append(free_name(bear, added))
        out.append(value.alias(bear[-1]))
    return rows.select(*out)


def gathered(rows: DataFrame, per_part: int = TURNS_PER_PART) -> DataFrame:
    """Records (conv_id, part, more, messages) from a row for each turn (conv_id, turn, role, text).

    A conversation is gathered in parts of ``per_part`` turn numbers, so a very long one is spread over tasks.  ``more``
    says that its conversation may have other parts: true for all parts but the first (part 0), and for the first one
    where there are others, which tell it so by a row without text.
    """
    part = F.coalesce(F.floor(F.col("turn") / per_part), F.lit(0)).cast("long")
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    turns = rows.select("conv_id", part.alias("part"), (part != 0).alias("more"), said.alias("m"))
    others = rows.filter(part != 0).select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(True).alias("more"), F.lit(None).cast(turns.schema["m"].dataType).alias("m"))
    listed = turns.unionByName(others).groupBy("conv_id", "part").agg(F.max("more").alias("more"), F.sort_array(F.collect_list("m")).alias("m")).filter(F.size("m") > 0)
    return listed.select("conv_id", "part", "more", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def formatted(records: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` to records with canonical turns (null where the turns are).

    The mask lists (turn, within, start, chars): a stretch of ``chars`` code points from ``start`` of the formatted
    text, which is ``within`` its turn.  Existing columns of those names are replaced.
    """
    pieces = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")))
    rows = records.withColumn("_pieces", pieces)
    sizes = F.transform("_pieces", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda upto, n: F.concat(upto, F.array(F.element_at(upto, -1) + n)))
    rows = rows.withColumn("_starts", starts)
    mask = F.transform("_pieces", lambda p, i: F.struct(
        i.alias("turn"), F.char_length(p["head"]).alias("within"), (F.get(F.col("_starts"), i) + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).alias("chars"),
        (p["role"] == TRAINED).alias("trained"),
    ))
    mask = F.transform(F.filter(mask, lambda m: m["trained"]), lambda m: F.struct(m["turn"].alias("turn"), m["within"].alias("within"), m["start"].alias("start"), m["chars"].alias("chars")))
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return rows.withColumn("formatted", text).withColumn("loss_mask", mask).drop("_pieces", "_starts")


def read_back(rows: DataFrame) -> DataFrame:
    """Adds ``turns_back``, read from ``formatted``, and ``loss``, the texts under ``loss_mask``, unescaped and joined."""
    marked = F.split("formatted", START.replace("|", r"\|"))  # no text holds the mark
    rows = rows.withColumn("_turns", F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))))
    head = lambda p: F.substring_index(p, "\n", 1)
    turn = lambda p: F.struct(
        _role_in(head(p)).alias("role"),
        unescaped(F.substring(p, F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - 1 - len(END))).alias("text"),
    )
    under = lambda m: unescaped(F.substring(F.get(F.col("_turns"), m["turn"]), m["within"] + 1 - len(START), m["chars"]))
    return rows.withColumn("turns_back", F.transform("_turns", turn)).withColumn("loss", F.array_join(F.transform("loss_mask", under), "")).drop("_turns")


def digest(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted parts, as read back.

    Only conversations with ``more`` than their first part are gathered once more; of the others nothing is shuffled.
    """
    said = F.array_join(F.transform("turns_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(parts).select("conv_id", "part", "more", F.size("turns_back").cast("long").alias("n_turns"), said.alias("said"), "loss", F.char_length("formatted").cast("long").alias("formatted_chars"))
    pieces = rows.filter("more").groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("part", "said", "loss"))).alias("p"),
    )
    joined = pieces.select("conv_id", "n_turns", F.array_join("p.said", "").alias("said"), F.array_join("p.loss", "").alias("loss"), "formatted_chars")
    rows = rows.filter("not more").select(joined.columns).unionByName(joined)
    return rows.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
