"""Drawing baskets as arrows (SVG)."""

from __future__ import annotations

import colorsys
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALING, HEIGHT, MARGIN = 30, 30, 3


def _trimmed(x: Column) -> Column:
    """Whole part, towards zero."""
    return x.cast("int")


def hit_geometry(hits: DataFrame, scaling: int = SCALING, height: int = HEIGHT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(gene_key, domain, start, width, height) of domain hits within their gene, in drawing units.

    Hits count in amino acids, genes in bases.  On the reverse strand a hit is measured from the gene's other end.
    """
    place = F.split(F.regexp_replace("location", "[<>]", ""), ";")
    width = 3 * (F.col("q_end") - F.col("q_start"))
    forward = 3 * F.col("q_start")
    start = F.when(place[2] == "+", forward).otherwise(place[1].cast("int") - place[0].cast("int") - forward - width)
    return hits.select(
        *keep, F.concat_ws("_", "bgc", F.col("orf_num").cast("string")).alias("gene_key"), "domain",
        _trimmed(start / scaling).alias("start"), _trimmed(width / scaling).alias("width"), F.lit(height - 2 * MARGIN).alias("height"),
    )


def colour_of(name: str) -> tuple[int, int, int]:
    """A colour that depends on the name alone."""
    h = int.from_bytes(name.encode()[:64] or b"\0", "big") * 2654435761 % (1 << 32)
    return tuple(int(255 * c) for c in colorsys.hsv_to_rgb(h / (1 << 32), 0.45 + h % 97 / 300, 0.9))


def contour_of(rgb: tuple[int, int, int]) -> tuple[int, int, int]:
    """A darker shade."""
    h, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in rgb))
    return tuple(int(c * 255) for c in colorsys.hsv_to_rgb(h, s, 0.8 * v))


@lru_cache(maxsize=1 << 10)
def _heights(y: float, height: float) -> tuple[str, ...]:
    """An arrow's heights: of its shaft, of its head, and of its tip."""
    return tuple(f"{v:.1f}" for v in (y, y + height, y - height / 4, y + height + height / 4, y + height / 2))


def arrow(x: float, y: float, width: float, height: float, strand: str, fill: str, line: str, title: str) -> str:
    """An arrow of a gene; short genes are all head."""
    head = min(width, height / 2)
    if strand == "+":
        back, base, tip = f"{x:.1f}", f"{x + width - head:.1f}", f"{x + width:.1f}"
    else:
        back, base, tip = f"{x + width:.1f}", f"{x + head:.1f}", f"{x:.1f}"
    top, bottom, above, below, middle = _heights(y, height)
    points = f"{back},{top} {base},{top} {base},{above} {tip},{middle} {base},{below} {base},{bottom} {back},{bottom}"
    return f'<polygon points="{points}" fill="{fill}" stroke="{line}"><title>{escape(title)}</title></polygon>'


def _rgb(c: tuple[int, int, int]) -> str:
    return f"rgb({c[0]},{c[1]},{c[2]})"


@lru_cache(maxsize=1 << 16)
def _look(domain: str, rgb: tuple[int, int, int] | None) -> str:
    """Colours and title of a domain; by its name without a colour of its own."""
    rgb = rgb or colour_of(domain)
    return f'fill="{_rgb(rgb)}" stroke="{_rgb(contour_of(rgb))}"><title>{escape(domain)}</title></rect>'


_FIRST_TWO = itemgetter(0, 1)


def _svg(genes: list[tuple], marked: set[str] | None, colours: dict[str, tuple[int, int, int]]) -> str:
    """``svg`` of genes (start, gene_key, end, strand, gene, domains) with domains (start, domain, width, height)."""
    left, right = min((g[0] for g in genes), default=0), max((g[2] for g in genes), default=0)
    width = (right - left) / SCALING
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 2 * MARGIN:.0f}" height="{2 * HEIGHT}">', f'<line x1="0" y1="{HEIGHT}" x2="{width:.1f}" y2="{HEIGHT}" stroke="black"/>']
    for start, key, end, strand, gene, domains in sorted(genes, key=_FIRST_TWO):
        x, shown = (start - left) / SCALING, marked is None or gene in marked
        parts.append(arrow(x, HEIGHT / 2, (end - start) / SCALING, HEIGHT, strand, "rgb(220,220,220)" if shown else "white", "black", f"{key} {gene}"))
        for at, domain, wide, high in sorted(domains, key=_FIRST_TWO) if shown else ():
            parts.append(f'<rect x="{x + at:.1f}" y="{HEIGHT / 2 + MARGIN}" width="{wide}" height="{high}" {_look(domain, colours.get(domain))}')
    return "\n".join([*parts, "</svg>"])


def svg(genes: list, marked: set[str] | None = None, colours: dict[str, tuple[int, int, int]] | None = None) -> str:
    """SVG text of one basket; only genes in ``marked`` (gene strings) are filled, all if None.

    A gene has start, end, strand, gene_key, gene and ``domains`` (start, width, height, domain).
    """
    rows = [(g["start"], g["gene_key"], g["end"], g["strand"], g["gene"], [(d["start"], d["domain"], d["width"], d["height"]) for d in g["domains"]]) for g in genes]
    return _svg(rows, marked, colours or {})


def _lists(column: pa.Array, rows: list) -> list[list]:
    """Values of a list column, given those of its flat array."""
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    return [rows[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _tuples(structs: pa.Array, names: tuple[str, ...], **known: list) -> list[tuple]:
    """The named fields of structs, one tuple each."""
    fields = dict(zip((f.name for f in structs.type), structs.flatten()))
    return list(zip(*(known.get(n) or fields[n].to_pylist() for n in names)))


def genes_of(column: pa.Array) -> list[list[tuple]]:
    """Lists of genes, as ``_svg`` takes them, of a column of lists of structs without nulls; read field by field."""
    flat = column.flatten()
    domains = dict(zip((f.name for f in flat.type), flat.flatten()))["domains"]
    held = _lists(domains, _tuples(domains.flatten(), ("start", "domain", "width", "height")))
    return _lists(column, _tuples(flat, ("start", "gene_key", "end", "strand", "gene", "domains"), domains=held))


#: Places of family and clan among the columns of a module that do not hold its genes.
FAMILY, CLAN = 5, 6


def chosen_modules(blocks: DataFrame, kind: str, topics: list[str] | None = None, modules: list[str] | None = None, families: list[str] | None = None, clans: list[str] | None = None) -> DataFrame:
    """(bgc, place, module, genes) of the blocks (ord, bgc, info, genes) with one of the given values each; None is any.

    Modules of a basket with a clan are in the order of clan and family, those with a family only in that of the
    family, both as numbers, and others as they stand; places count from 1.  A module without the asked column is left out.
    """
    at = lambda k: F.get("info", F.lit(k))
    asked = [(at(0), topics)] if kind == "topic" else [(at(0), modules), (at(FAMILY), families), (at(CLAN), clans)]
    rows = blocks
    for column, wanted in asked:
        if wanted is not None:
            rows = rows.filter(F.coalesce(column.isin(list(wanted)), F.lit(False)))
    number = lambda k: at(k).try_cast("long")
    order = [] if kind == "topic" else [number(CLAN), number(FAMILY)]
    place = F.row_number().over(Window.partitionBy("bgc").orderBy(*order, "ord"))
    return rows.select("bgc", place.alias("place"), at(0).alias("module"), "genes")


def all_genes(marked: DataFrame | None) -> DataFrame | None:
    """(bgc, genes): the genes of all modules of a basket."""
    return None if marked is None else marked.groupBy("bgc").agg(F.array_distinct(F.flatten(F.collect_list("genes"))).alias("genes"))


def _drawable(hits: DataFrame) -> DataFrame:
    """(bgc, genes): the genes of each basket with their places and domains."""
    place = F.split(F.regexp_replace("location", "[<>]", ""), ";")
    drawn = hit_geometry(hits.withColumn("_all", F.struct(*hits.columns)), keep=("_all",)).select("_all.*", "gene_key", F.struct("domain", "start", "width", "height").alias("d"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_start", "domain"))), lambda x: x["domain"]), ";")
    # Genes and baskets are gathered where a basket's hits are.
    genes = drawn.repartition("bgc").groupBy("bgc", "gene_key", "location").agg(names.alias("gene"), F.collect_list("d").alias("domains"))
    one = F.struct("gene_key", "gene", "domains", place[0].cast("double").alias("start"), place[1].cast("double").alias("end"), place[2].alias("strand"))
    return genes.groupBy("bgc").agg(F.collect_list(one).alias("genes"))


def _drawn(rows: DataFrame, keep: tuple[str, ...], colours: dict[str, tuple[int, int, int]] | None) -> DataFrame:
    """The kept columns with ``svg`` of rows (genes, marked); null ``marked`` fills all genes."""
    kinds = {c: rows.schema[c].dataType for c in keep}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column("marked").to_pylist()
            texts = [_svg(g, None if m is None else set(m), colours or {}) for g, m in zip(genes_of(batch.column("genes")), marked)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "svg"])

    return rows.select(*keep, "genes", "marked").mapInArrow(draw, ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", svg string")


def render(hits: DataFrame, marked: DataFrame | None = None, colours: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """(bgc, svg) of every basket with hits.  ``marked`` (bgc, genes) names the genes to fill."""
    rows = _drawable(hits)
    if marked is None:
        rows = rows.withColumn("marked", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(marked.select("bgc", F.col("genes").alias("marked")), "bgc", "left").withColumn("marked", F.coalesce("marked", F.array().cast("array<string>")))
    return _drawn(rows, ("bgc",), colours)


def render_modules(hits: DataFrame, chosen: DataFrame, colours: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """(bgc, place, module, svg): each basket as a whole (place 0), then once for each of its modules with its genes filled."""
    rows = _drawable(hits)
    whole = rows.select("bgc", F.lit(0).alias("place"), F.lit(None).cast("string").alias("module"), "genes", F.lit(None).cast("array<string>").alias("marked"))
    each = rows.join(chosen.withColumnRenamed("genes", "marked"), "bgc").select("bgc", "place", "module", "genes", "marked")
    return _drawn(whole.unionByName(each), ("bgc", "place", "module"), colours)
