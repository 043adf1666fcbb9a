"""Text files of a run, tallies taken while tables are written, selectors of drawings."""

from pyspark.sql import functions as F

from basketloom import cli
from basketloom.operators import render
from basketloom.plans.pipeline import Config, Run
from basketloom.sources import tables
from basketloom.sources.onefile import write_file


def test_one_file_of_many_parts(spark, tmp_path):
    lines = spark.range(5000).repartition(7).select(F.concat(F.lit("line "), "id").alias("value"), "id")
    path = f"file://{tmp_path}/all.txt"
    assert write_file(lines, path, "id", header="head") == path
    assert (tmp_path / "all.txt").read_text() == "head\n" + "".join(f"line {k}\n" for k in range(5000))
    write_file(lines.limit(0), path, "id")  # replaced
    assert (tmp_path / "all.txt").read_text() == "" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.txt"]


def files(folder):
    return {p.name: p.read_text() for p in folder.iterdir() if p.suffix in (".txt", ".csv")}


def test_text_files_of_a_run(spark, tmp_path):
    lines = [f"b{k:02d},{','.join(['A', 'B;D', 'C'] if k % 2 else ['X', 'Y', 'Q' + str(k % 3)])}" for k in range(30)]
    (tmp_path / "c.csv").write_text("\n".join(reversed(lines)) + "\n")
    (tmp_path / "names").write_text("A\nB\nC\nX\nY\n")
    (tmp_path / "known").write_text("b01\tgroup1\tA,C\n")
    out = tmp_path / "out"
    Run(spark, Config(out=str(out), clusters=str(tmp_path / "c.csv"), domain_filtering=True, include_list=str(tmp_path / "names"), topic=True, topics=2, iterations=5, known=str(tmp_path / "known"), text=True)).run()
    made = files(out)
    assert made["clusters.csv"].splitlines() == lines[::-1]
    assert made["clusters_gene_counts.txt"].splitlines()[:2] == ["#Total\t90", "A\t15"]
    assert made["clusters_domfiltered.csv"].splitlines() == [f"b{k:02d},{'A,B,C' if k % 2 else 'X,Y,-'}" for k in range(29, -1, -1)]
    assert made["clusters_domfiltered_gene_counts.txt"] == "#Total\t90\n" + "".join(f"{g}\t15\n" for g in "ABCXY-")
    every = spark.read.parquet(str(out / "modules")).collect()
    if every:
        assert [x.split("\t")[-1] for x in made["stat_modules_unfiltered.txt"].splitlines()[1:]] == [",".join(m.genes) for m in sorted(every, key=lambda m: m.module_id)]
    else:
        assert "stat_modules_unfiltered.txt" not in made
    assert len(made["detected_stat_module_ids.txt"].splitlines()) == 31 and made["detected_stat_module_ids.txt"].startswith("bgc_id\tmodule_ids\nb00\t\nb01\t1\n")
    assert [x for x in made["detected_stat_modules.txt"].splitlines() if x[0] == ">"] == [f">b{k:02d}" for k in range(30)]
    assert made["topics.txt"].startswith("topic\tnumber_ldavis") and len(made["topics.txt"].splitlines()) == 3
    assert made["matches_per_topic.txt"].startswith("#Topic ") and made["bgc_topics.txt"].startswith(">b00\nclass=None\n") and "terms_to_topic.txt" in made
    assert made["matches_per_topic_summary.txt"].startswith("topic\tmatches\tmatches_len>1\tclasses\tclasses_len>1\n") and "known_subcluster_matches.txt" in made
    assert spark.read.parquet(str(out / "topic_convergence")).count() > 0


def test_text_files_of_representatives(spark, tmp_path):
    (tmp_path / "c.csv").write_text("x,A,B,C\ny,A,B\nz,Q,R\n")
    out = tmp_path / "out"
    cli.main(["run", "--out", str(out), "--clusters", str(tmp_path / "c.csv"), "--similarity_filtering", "--no_infrequent_filter", "--text"], spark)
    made = files(out)
    assert made["clusters_representatives.csv"] == "x,A,B,C\nz,Q,R\n" and made["representative_clusters.txt"] == "x\tx,y\nz\tz\n"
    assert made["edges_clusters.txt"] == "x\ty\t0.5\tTrue\n"


RECORD = """LOCUS       X 900 bp DNA
FEATURES             Location/Qualifiers
     protocluster    1..900
                     /contig_edge="{edge}"
     CDS             complement(1..300)
                     /protein_id="P_1"
                     /translation="MKV"
     CDS             301..900
                     /gene="g_2"
                     /translation="MAA"
ORIGIN
//
"""


def test_tallies_while_a_run_goes_on(spark, tmp_path, monkeypatch):
    """Files by status, and searches by a stand-in for the external program that fails on one file."""
    gbks, bin_ = tmp_path / "gbks", tmp_path / "bin"
    gbks.mkdir()
    bin_.mkdir()
    for name, edge in (("a", "False"), ("bad", "False"), ("edge", "True"), ("my_final", "False")):
        (gbks / f"{name}.gbk").write_text(RECORD.format(edge=edge))
    (gbks / "broken.gbk").write_text("nothing\n")
    program = bin_ / "search"
    program.write_text(
        "#!/bin/sh\nwhile [ $# -gt 1 ]; do [ $1 = --domtblout ] && out=$2; shift; done\ngrep -q '>bad' $1 && exit 1\n"
        "grep '^>' $1 | sed 's/>\\(.*\\)/DomA - 10 \\1 - 100 1e-9 50.0 0.1 1 1 1e-9 1e-9 49.5 0.1 1 9 1 30 1 30 0.9 x y/' > $out\n"
    )
    program.chmod(0o755)
    from basketloom.sources import genbank

    real = genbank.searches
    monkeypatch.setattr(genbank, "searches", lambda found, profiles: real(found, profiles, str(program)))
    run = Run(spark, Config(out=str(tmp_path / "out"), gbks=str(gbks), hmm="none", statistical=False, text=True))
    assert {(r.bgc_id, tuple(r.genes)) for r in run.run()["clusters"].collect()} == {("a", ("DomA", "DomA"))}
    assert run.tallies["records"] == {"converted": 2, "excluded": 1, "filtered": 1, "failed": 1, "existed": 0}
    assert run.tallies["searches"] == {"done": 1, "failed": 1}
    made = files(tmp_path / "out")
    assert made["clusters.csv"] == "a,DomA,DomA\n" and made["all_domain_hits.txt"].splitlines()[1].split("\t") == ["a", "", "P-1", "0;300;-", "1", "2", "DomA", "0;30", "49.5"]
    again = Run(spark, Config(out=str(tmp_path / "out"), gbks=str(gbks), hmm="none", statistical=False))
    again.run()
    assert again.tallies == {}  # nothing was parsed or searched anew


HITS = "bgc string, location string, orf_num int, domain string, q_start int, q_end int"


def test_selected_modules_are_drawn(spark, tmp_path):
    hits = spark.createDataFrame([("b", "0;900;+", 1, "A", 10, 110), ("b", "1000;1900;-", 2, "B", 10, 110), ("c", "0;300;+", 1, "A", 0, 10)], HITS)
    stat = ">b\n7\t2\t2\t0.1\t3\tA\t20\t5\n8\t2\t2\t0.1\t3\tB\t3\t5\n9\t2\t2\t0.1\t3\tA,B\t4\t1\n>c\n7\t2\t2\t0.1\t3\tA\t20\t5\n"
    (tmp_path / "stat").write_text(stat)
    blocks = tables.read_module_blocks(spark, str(tmp_path / "stat"), "stat")
    chosen = lambda **k: [tuple(r) for r in render.chosen_modules(blocks, "stat", **k).orderBy("bgc", "place").select("bgc", "place", "module").collect()]
    assert chosen() == [("b", 1, "9"), ("b", 2, "8"), ("b", 3, "7"), ("c", 1, "7")]  # by clan, then family, as numbers
    assert chosen(clans=["5"], families=["3", "20"]) == [("b", 1, "8"), ("b", 2, "7"), ("c", 1, "7")]
    assert chosen(modules=["9"]) == [("b", 1, "9")] and chosen(families=["none"]) == []
    (tmp_path / "topic").write_text(">b\nclass=X\n3\t0.9\t0.5\tA:0.9,B:0.5\n4\t0.8\t0.5\tB:0.9\n")
    topics = tables.read_module_blocks(spark, str(tmp_path / "topic"), "topic")
    assert [(r.place, r.module, r.genes) for r in render.chosen_modules(topics, "topic", topics=["4"]).collect()] == [(1, "4", ["B"])]
    drawn = {(r.bgc, r.place): r.svg for r in render.render_modules(hits, render.chosen_modules(blocks, "stat", clans=["5"])).collect()}
    assert {k: v.count("<rect") for k, v in drawn.items()} == {("b", 0): 2, ("b", 1): 1, ("b", 2): 1, ("c", 0): 1, ("c", 1): 1}
    both = {r.bgc: r.svg.count("<rect") for r in render.render(hits, render.all_genes(render.chosen_modules(blocks, "stat", modules=["8"]))).collect()}
    assert both == {"b": 1, "c": 0}
    tables.write_hits(hits.selectExpr("*", "'g' AS g_id", "'p' AS p_id", "2 AS tot_orf", "1.0D AS bitscore"), str(tmp_path / "hits"))
    cli.main(["draw", "--hits", str(tmp_path / "hits"), "--out", str(tmp_path / "drawn"), "--modules", str(tmp_path / "stat"), "--kind", "stat", "--each", "--clans", "1"], spark)
    assert {(r.bgc, r.place) for r in spark.read.parquet(str(tmp_path / "drawn")).collect()} == {("b", 0), ("b", 1), ("c", 0)}
