"""GenBank files to protein records (FASTA).

Only the first record of a file is read.  The parser knows what is needed here: features with their locations
(complement, join, order, partial ends) and qualifiers.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = "bgc string, status string, n int, header string, sequence string"


#: A location of one part without open ends.
_PLAIN = re.compile(r"(\d+)\.\.(\d+)|complement\((\d+)\.\.(\d+)\)")
_UNINDENTED = re.compile(r"^\S", re.M)
_NOT_IN_HEADERS = str.maketrans("", "", "<> ")


def parse_location(text: str) -> tuple[str, str, str]:
    """(start, end, strand): 0-based start, exclusive end; strand ``+`` only if every part lies on it."""
    plain = _PLAIN.fullmatch(text)
    if plain:
        first, last, back_first, back_last = plain.groups()
        return (str(int(first) - 1), str(int(last)), "+") if first else (str(int(back_first) - 1), str(int(back_last)), "-")
    text = re.sub(r"\s+", "", text)
    ends, strands = [], []
    for at in re.finditer(r"([<>]?\d+)(?:(?:\.\.|\^)([<>]?\d+))?", re.sub(r"[\w.]+:", "", text)):
        first, last = at[1], at[2] or at[1]
        ends.append((int(first.strip("<>")) - 1, int(last.strip("<>"))))
        before = re.sub(r"[\w.]+:", "", text)[: at.start()]
        depth = 0
        inside = False
        for opened in re.finditer(r"complement\(|\(|\)", before):
            if opened[0] == ")":
                depth -= 1
                inside = inside and depth > level
            else:
                depth += 1
                if opened[0] != "(" and not inside:
                    inside, level = True, depth - 1
        strands.append("-" if inside else "+")
    if not ends:
        raise ValueError(f"no location in {text!r}")
    return str(min(a for a, _ in ends)), str(max(b for _, b in ends)), "+" if set(strands) == {"+"} else "-"


def parse_features(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, location, first value of each qualifier) of the features of the first record."""
    record = text.split("\n//", 1)[0]
    if not record.lstrip().startswith("LOCUS"):
        raise ValueError("not a GenBank record")
    head = re.search(r"^FEATURES[^\n]*\n", record, re.M)
    end = head and _UNINDENTED.search(record, head.end())
    table = record[head.end() : end.start() if end else len(record)] if head else ""
    out: list[tuple[str, str, dict[str, str]]] = []
    for part in re.split(r"\n(?=     \S)", "\n" + table)[1:]:
        lines = [line.strip() for line in part.split("\n")]
        kind, _, rest = lines[0].partition(" ")
        body = [rest.strip(), *filter(None, lines[1:])]
        at = 0
        while at < len(body) and body[at][:1] != "/":
            at += 1
        values: dict[str, str] = {}
        found: list[tuple[str, list[str]]] = []
        quoted = False  # and not closed yet
        for line in body[at:]:
            if line[0] == "/" and not quoted:
                name, _, value = line[1:].partition("=")
                found.append((name, [value]))
                quoted = value[:1] == '"' and (len(value) == 1 or value[-1] != '"')
            else:
                found[-1][1].append(line)
                quoted = found[-1][1][0][:1] == '"' and line[-1] != '"'
        for name, held in found:
            if name and name not in values:
                joined = held[0] if len(held) == 1 else ("" if name == "translation" else " ").join(held)
                values[name] = joined[1:-1].replace('""', '"') if joined[:1] == '"' else joined
        out.append((kind, "".join(body[:at]), values))
    return out


def records(name: str, text: str, include_edge: bool = False, exclude: tuple[str, ...] = ("final",)) -> tuple[str, list[tuple[str, str]]]:
    """(status, [(header, sequence)]) of a file; the status is excluded, failed, filtered or converted."""
    if any(word in name for word in exclude):
        return "excluded", []
    try:
        features = parse_features(text)
        found = []
        for kind, location, values in features:
            if kind == "protocluster" and not include_edge and values.get("contig_edge") == "True":
                return "filtered", []
            if kind == "CDS":
                gene, protein = values.get("gene", "").replace("_", "-"), values.get("protein_id", "").replace("_", "-")
                head = f"{name}_gid:{gene}_pid:{protein}_loc:{';'.join(parse_location(location))}_{len(found) + 1}"
                found.append((head.translate(_NOT_IN_HEADERS), values.get("translation", "")))
    except ValueError:
        return "failed", []
    return "converted", [(f">{head}/{len(found)}", sequence) for head, sequence in found]


def parse_files(rows: DataFrame, include_edge: bool = False, exclude: tuple[str, ...] = ("final",)) -> DataFrame:
    """(bgc, status, n, header, sequence) of files (bgc, content): a row for each protein, or one without."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for bgc, content in zip(part["bgc"], part["content"]):
                status, found = records(bgc, bytes(content).decode("utf-8", "replace").replace("\r\n", "\n"), include_edge, tuple(exclude))
                out += [(bgc, status, k, h, s) for k, (h, s) in enumerate(found, 1)] or [(bgc, status, None, None, None)]
            yield pd.DataFrame(out, columns=["bgc", "status", "n", "header", "sequence"]).astype({"n": "Int32"})

    return rows.select("bgc", "content").mapInPandas(parse, RECORDS)


def read_genbank(spark: SparkSession, path: str, include_edge: bool = False, exclude: tuple[str, ...] = ("final",), existing: DataFrame | None = None) -> DataFrame:
    """(bgc, status, n, header, sequence) of all ``*.gbk`` files of a folder: a row for each protein, or one without.

    Names in ``existing`` (bgc) have the status ``existed`` and are not read again, unless they are excluded.
    """
    files = spark.read.format("binaryFile").load(path, pathGlobFilter="*.gbk") if not path.endswith(".gbk") else spark.read.format("binaryFile").load(path)
    name = F.split(F.element_at(F.split("path", "/"), -1), r"\.gbk")[0]
    rows = files.select(name.alias("bgc"), "content")
    excluded = F.lit(False)
    for word in exclude:
        excluded = excluded | F.col("bgc").contains(word)
    done = None
    if existing is not None:
        known = existing.select("bgc").distinct()
        done = rows.filter(~excluded).select("bgc").join(known, "bgc", "left_semi").select("bgc", F.lit("existed").alias("status"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("sequence"))
        rows = rows.filter(excluded).unionByName(rows.filter(~excluded).join(known, "bgc", "left_anti"))

    parsed = parse_files(rows, include_edge, exclude)
    return parsed if done is None else parsed.unionByName(done)


def fasta_lines(found: DataFrame) -> DataFrame:
    """(bgc, value): header and sequence lines in order, to be written by ``partitionBy("bgc")``."""
    rows = found.filter("header is not null")
    return rows.select("bgc", F.concat_ws("\n", "header", F.coalesce("sequence", F.lit(""))).alias("value"), "n").repartition("bgc").sortWithinPartitions("bgc", "n").drop("n")


def write_fasta(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder ``bgc=<name>`` with the records of each file."""
    fasta_lines(found).write.mode(mode).partitionBy("bgc").text(path)


#: What may have become of a file, and of a search.
STATUSES, SEARCHES = ("converted", "excluded", "filtered", "failed", "existed"), ("done", "failed")


def numbered(found: DataFrame) -> DataFrame:
    """Adds i and n: the place of each record and how many its file has."""
    return found.withColumn("i", F.row_number().over(Window.partitionBy("bgc").orderBy("n"))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("bgc")))


def searches(found: DataFrame, profiles: str, program: str = "hmmscan") -> DataFrame:
    """(cluster_id, ord, line, status): the lines of an external profile search over the records of each file.

    The first row of each file has no line but a status: done, or failed, after which no lines follow.  The program
    must be installed on the executors, and ``profiles`` must be readable there; without the program the job fails.
    """
    texts = found.filter("header is not null").groupBy("bgc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "header", "sequence"))), lambda r: F.concat(r["header"], F.lit("\n"), r["sequence"])), "\n").alias("fasta"))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for bgc, fasta in zip(part["bgc"], part["fasta"]):
                lines: list[str] = []
                with tempfile.TemporaryDirectory() as folder:
                    source, out = os.path.join(folder, "in.fasta"), os.path.join(folder, "out.domtable")
                    with open(source, "w") as handle:
                        handle.write(fasta + "\n")
                    done = subprocess.run([program, "-o", os.devnull, "--cpu", "0", "--domtblout", out, "--cut_tc", profiles, source], check=False).returncode == 0
                    if done:
                        with open(out) as handle:
                            lines = [line.strip() for line in handle]
                yield pd.DataFrame({"cluster_id": bgc, "ord": range(-1, len(lines)), "line": [None, *lines], "status": ["done" if done else "failed"] + [None] * len(lines)})

    return texts.mapInPandas(scan, "cluster_id string, ord long, line string, status string")
