"""Genes as columns.

A gene is an ordered list of domains; as a string the domains are joined by ``;``.  A gene without domains is
``EMPTY``.  A basket (gene cluster) is an ordered list of genes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "-"
GENE_SEP, DOMAIN_SEP = ",", ";"


def base_name(domain: Column) -> Column:
    """Domain name without a sub-family suffix ``_c<digits>``."""
    return F.regexp_replace(domain, r"_c\d+$", "")


def gene_domains(gene: Column) -> Column:
    return F.split(gene, DOMAIN_SEP)


def gene_string(domains: Column) -> Column:
    """Gene string of a list of domains; ``EMPTY`` for none."""
    return F.when(F.size(domains) > 0, F.array_join(domains, DOMAIN_SEP)).otherwise(F.lit(EMPTY))


def n_nonempty(genes: Column) -> Column:
    """Number of genes other than ``EMPTY`` in a list of gene strings."""
    return F.size(F.filter(genes, lambda g: g != EMPTY))


def genes_text(genes: Column) -> Column:
    """A list of gene strings as text, and ``text_genes`` back."""
    return F.array_join(genes, GENE_SEP)


def text_genes(text: Column) -> Column:
    return F.split(text, GENE_SEP)


def keep_listed(gene: Column, names: Column) -> Column:
    """Gene with the domains whose base name is in the list ``names`` (an array column)."""
    return gene_string(F.filter(gene_domains(gene), lambda d: F.array_contains(names, base_name(d))))


def flat_domains(genes: Column) -> Column:
    """All domains of a basket in order, ``EMPTY`` standing for empty genes."""
    return F.flatten(F.transform(genes, gene_domains))


def adjacent_pairs(genes: Column) -> Column:
    """Distinct sorted pairs of neighbouring domains, each as ``a;b``; an empty gene breaks the neighbourhood."""
    d = flat_domains(genes)
    pairs = F.zip_with(F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    pairs = F.filter(pairs, lambda p: (p["a"] != EMPTY) & (p["b"] != EMPTY))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat(p["a"], F.lit(DOMAIN_SEP), p["b"])))


def domain_set(genes: Column) -> Column:
    """Distinct domains of a basket without ``EMPTY``."""
    return F.array_distinct(F.filter(flat_domains(genes), lambda d: d != EMPTY))


def adjacency_index(pairs_a: Column, pairs_b: Column) -> Column:
    """Jaccard index of two sets of adjacent pairs; 0 if either is empty."""
    both = F.size(F.array_intersect(pairs_a, pairs_b))
    return F.when((F.size(pairs_a) == 0) | (F.size(pairs_b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(pairs_a, pairs_b)))


def contains_either(set_a: Column, set_b: Column) -> Column:
    """Whether one set of domains holds the other."""
    return (F.size(F.array_except(set_a, set_b)) == 0) | (F.size(F.array_except(set_b, set_a)) == 0)


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length shared by two half-open intervals; 0 where they touch, negative where they are apart."""
    return F.least(end_a, end_b) - F.greatest(start_a, start_b)


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column, share: Column | float) -> Column:
    """Whether the shared length exceeds ``share`` of the shorter interval."""
    shorter = F.least(end_a - start_a, end_b - start_b)
    return overlap_length(start_a, end_a, start_b, end_b) > shorter * (share if isinstance(share, Column) else F.lit(float(share)))


def round_significant(x: Column, digits: int) -> Column:
    """A positive number rounded to significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.when(x == 0, F.lit(1.0)).otherwise(F.abs(x)))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def rewritten_length(genes: Column) -> Column:
    """Length of a basket after its repeated genes are emptied and appended once each behind a gap."""
    real = F.filter(genes, lambda g: g != EMPTY)
    repeated = F.size(F.filter(F.array_distinct(real), lambda g: F.size(F.filter(real, lambda h: h == g)) > 1))
    return (F.size(genes) + 2 * repeated).cast("long")
