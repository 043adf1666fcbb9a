"""GenBank and domain tables to baskets."""

import pytest

from basketloom.sources import domtable, genbank, tables

QUERY = "BGC1_gid:_pid:P{k}.1_loc:308;1040;-_{k}/5"


def line(domain, k, start, end, score):
    return f"{domain} - 136 {QUERY.format(k=k)} - 243 4.2e-28 98.9 9.2 1 1 1.7e-32 4.2e-28 {score} 9.2 1 136 {start} {end} 29 163 0.99 some free text"


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("# comment\n" + "\n".join(lines) + "\n")


def test_domain_tables(spark, tmp_path):
    folder = tmp_path / "tables"
    write(folder, "one.domtable", [
        line("AzlC", 2, 29, 162, 98.9), line("Oxy", 3, 33, 218, 111.3),
        line("Sam_c10", 4, 166, 294, 74.9), line("Sam_c90", 4, 186, 317, 35.4), line("Spasm_c22", 4, 391, 445, 34.5), line("Sam_c10", 4, 1, 60, 99.0),
    ])
    write(folder, "empty.domtable", [])
    write(folder, "broken.domtable", ["X - 136 noquery - 243 4.2e-28 98.9 9.2 1 1 1.7e-32 4.2e-28 10 9.2 1 136 1 9 29 163 0.99 -"])
    baskets, hits = domtable.tokenised(spark, str(folder))
    rows = baskets.orderBy("pos").collect()
    assert [(r.bgc_id, r.gene) for r in rows] == [("one", x) for x in ("-", "AzlC", "Oxy", "Sam_c10;Spasm_c22", "-")]
    found = domtable.in_order(hits).collect()
    assert [(r.bgc, r.g_id, r.p_id, r.location, r.orf_num, r.tot_orf, r.domain, r.q_start, r.q_end, r.bitscore) for r in found][0] == ("BGC1", "", "P2.1", "308;1040;-", 2, 5, "AzlC", 28, 162, 98.9)
    assert [r.domain for r in found] == ["AzlC", "Oxy", "Sam_c10", "Spasm_c22"]
    tables.write_hits(hits, str(tmp_path / "hits"))
    again = tables.read_hits(spark, str(tmp_path / "hits"))
    assert sorted((r.domain, r.q_start, r.q_end) for r in again.collect()) == sorted((r.domain, r.q_start, r.q_end) for r in found)


def test_losers_still_beat_others(spark):
    rows = spark.createDataFrame([("c", 0, 0, 10, 5.0), ("c", 1, 5, 15, 9.0), ("c", 2, 12, 20, 7.0), ("c", 3, 30, 40, 1.0), ("c", 4, 30, 40, 1.0)], "k string, ord int, q_start int, q_end int, bitscore double")
    from basketloom.operators.overlap import survivors

    assert sorted(r.ord for r in survivors(rows, ["k"], "ord", 0.1).collect()) == [1, 3]


def test_survivors_of_large_groups(spark):
    """A group of many intervals is compared in parts, against plain pairs; each group is one list, read once."""
    import random

    from basketloom.operators import overlap

    draw = random.Random(5)
    rows = [("c" if k < 600 else None, k, a, a + draw.randrange(-1, 30), draw.choice([1.0, 2.0, 3.0, None])) for k, a in ((k, draw.randrange(2000)) for k in range(620))]
    beaten = set()
    for i, (_, _, a, b, x) in enumerate(rows[:600]):
        for j, (_, _, c, d, y) in enumerate(rows[i + 1 : 600], i + 1):
            if min(b, d) - max(a, c) > min(b - a, d - c) * 0.1:
                beaten.add(j if x is not None and y is not None and x >= y else i)
    frame = spark.createDataFrame(rows, "k string, ord int, q_start int, q_end int, bitscore double")
    found = overlap.survivors(frame, ["k"], "ord", 0.1)
    assert sorted(r.ord for r in found.collect()) == [k for k in range(620) if k not in beaten] and 0 < len(beaten) < 600
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hits_read_their_lines_once(spark):
    rows = spark.createDataFrame([("c", k, f"D - 1 c_gid:g_pid:p_loc:1;9;+_{n} - 1 0 0 0 1 1 0 0 5 0 1 1 2 9 1 1 0.9 -") for k, n in enumerate(("1/2", "2/2"))] + [("d", 0, "D - 1 d_gid:_pid:_loc:_99999999999/2 - 1 0 0 0 1 1 0 0 5 0 1 1 2 9 1 1 0.9 -")], "cluster_id string, ord long, line string")
    found = domtable.hits(domtable.parse_rows(rows))
    assert sorted(tuple(r) for r in found.collect()) == [("c", k, "c", "g", "p", "1;9;+", k + 1, 2, "D", 1, 9, 5.0) for k in range(2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


GBK = """LOCUS       TEST 100 bp DNA linear
FEATURES             Location/Qualifiers
     protocluster    1..100
                     /contig_edge="{edge}"
     CDS             complement(1..312)
                     /gene="ab_C"
                     /protein_id="P_1.1"
                     /note="two
                     lines"
                     /translation="MKV
                     LLA"
     CDS             join(<5..20,30..>44)
                     /protein_id="P2"
ORIGIN
        1 acgt
//
LOCUS       SECOND
FEATURES             Location/Qualifiers
     CDS             1..9
//
"""


def test_genbank_records():
    status, found = genbank.records("x", GBK.format(edge="False"))
    assert status == "converted"
    assert found == [(">x_gid:ab-C_pid:P-1.1_loc:0;312;-_1/2", "MKVLLA"), (">x_gid:_pid:P2_loc:4;44;+_2/2", "")]
    assert genbank.records("x", GBK.format(edge="True"))[0] == "filtered"
    assert genbank.records("x", GBK.format(edge="True"), include_edge=True)[0] == "converted"
    assert genbank.records("x.final", GBK)[0] == "excluded"
    assert genbank.records("x", "junk")[0] == "failed"
    assert genbank.records("x", "")[0] == "failed"


def test_locations():
    for text, wanted in (("1..9", ("0", "9", "+")), ("complement(join(1..3,7..9))", ("0", "9", "-")), ("join(complement(1..3),7..9)", ("0", "9", "-")), ("order(4..5,7)", ("3", "7", "+"))):
        assert genbank.parse_location(text) == wanted


def test_genbank_folder(spark, tmp_path):
    folder = tmp_path / "gbk"
    folder.mkdir()
    for name, text in (("a.gbk", GBK.format(edge="False")), ("b.gbk", GBK.format(edge="True")), ("c.final.gbk", GBK), ("d.gbk", "junk"), ("e.gbk", GBK.format(edge="False"))):
        (folder / name).write_text(text)
    existing = spark.createDataFrame([("e",)], "bgc string")
    rows = genbank.read_genbank(spark, str(folder), existing=existing).collect()
    assert sorted({(r.bgc, r.status) for r in rows}) == [("a", "converted"), ("b", "filtered"), ("c.final", "excluded"), ("d", "failed"), ("e", "existed")]
    genbank.write_fasta(genbank.read_genbank(spark, str(folder)), str(tmp_path / "fasta"))
    text = next((tmp_path / "fasta" / "bgc=a").glob("part-*")).read_text()
    assert text.splitlines() == [">a_gid:ab-C_pid:P-1.1_loc:0;312;-_1/2", "MKVLLA", ">a_gid:_pid:P2_loc:4;44;+_2/2", ""]


def test_tables(spark, tmp_path):
    modules = spark.createDataFrame([("1", ["A;B", "C", "D"], 0.5, 3)], "module_id string, genes array<string>, strictest_pval double, occurences long")
    assert tables.write_modules(modules, str(tmp_path / "m"))
    assert not tables.write_modules(modules.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    row = tables.read_modules(spark, str(tmp_path / "m")).first()
    assert (row.module_id, row.genes, row.n_genes, row.n_domains, row.strictest_pval, row.occurences) == ("1", ["A;B", "C", "D"], 3, 4, 0.5, 3)
    edges = spark.createDataFrame([("a", "b", 0.5, True), ("a", "c", 0.25, False)], "bgc1 string, bgc2 string, ai double, contained boolean")
    tables.write_edges(edges, str(tmp_path / "e"))
    assert sorted(map(tuple, tables.read_edges(spark, str(tmp_path / "e")).collect())) == [("a", "b", 0.5, True), ("a", "c", 0.25, False)]
    (tmp_path / "d").write_text("head,x\nk,1\nk,2,3\n")
    assert [(r.key, r["values"]) for r in tables.read_dictionary(spark, str(tmp_path / "d"), ",", True).collect()] == [("k", ["2", "3"])]
    (tmp_path / "k").write_text("b1\tname\tinfo\tA,B,-\n")
    assert tuple(tables.read_known_groups(spark, str(tmp_path / "k")).first()) == ("b1", ["name", "info"], ["A", "B", "-"])
    (tmp_path / "c").write_text("# c\nAzlC\t1,2,3\n")
    assert tuple(tables.read_colours(spark, str(tmp_path / "c")).first()) == ("AzlC", 1, 2, 3)
    (tmp_path / "t").write_text("#Topic 1, matches:2\n0.5\t0.2\tA:1.00,B:0.40\tx\tNRP\n0.1\t0.2\tA:1.00\ty\tNRP\n#Topic 2, matches:1\n0.9\t0.1\tC:1.00,D:2.00\tx\tNRP\n")
    assert [(r.bgc, r.topic, r.genes) for r in tables.read_topic_matches(spark, str(tmp_path / "t"), ["1"], 2).collect()] == [("x", "1", ["A", "B"])]
    (tmp_path / "b").write_text(">x\nclass=N\nknown_subcluster=q\n3\t0.5\t0.2\tA:1.00,B:0.40\n>y\n")
    assert [(r.bgc, r.info, r.genes) for r in tables.read_module_blocks(spark, str(tmp_path / "b")).collect()] == [("x", ["3", "0.5", "0.2"], ["A", "B"])]
    (tmp_path / "s").write_text(">x\n7\tA,B,C\n")
    assert [(r.bgc, r.info, r.genes) for r in tables.read_module_blocks(spark, str(tmp_path / "s"), "stat").collect()] == [("x", ["7"], ["A", "B", "C"])]


@pytest.mark.parametrize("sizes", [(1, 400), (400, 1), (3, 50, 1, 200)])
def test_lines_follow_the_files(spark, tmp_path, sizes):
    """Spark packs files by size; lines keep the order of their paths all the same."""
    from basketloom.sources.clusters import carried_header, read_clusters, read_lines

    lines = []
    for k, n in enumerate(sizes):
        mine = [f"{'#' if j == 0 and k % 2 == 0 else ''}id{j % 5},f{k},{j}" for j in range(n)]
        (tmp_path / f"part-{k:05}").write_text("\n".join(mine) + "\n")
        lines += mine
    found = read_lines(spark, str(tmp_path))
    assert [r.line for r in found.orderBy("ord").collect()] == lines
    last, first = {}, {}
    for x in lines:
        i, _, genes = x.partition(",")
        last[i] = genes
        first.setdefault(i, genes)
    for kind, wanted in (("last", last), ("first", first)):
        assert {r.bgc_id: ",".join(r.genes) for r in read_clusters(spark, str(tmp_path), kind).collect()} == wanted
    heads, now = [], None
    for x in lines:
        now = x if x.startswith("#") else now
        heads.append(now)
    from pyspark.sql import functions as F

    assert [r.header for r in carried_header(found, F.col("line").startswith("#")).orderBy("ord").collect()] == heads


def test_plain_locations_and_features():
    """Locations of one part take a short way, with the result of the long one; values go on over lines until their quote."""
    from basketloom.sources import genbank

    for text in ("3..9", "complement(3..9)"):
        assert genbank._PLAIN.fullmatch(text) and genbank.parse_location(text) == genbank.parse_location(text + " ") == ("2", "9", "-" if "c" in text else "+")
    assert not any(genbank._PLAIN.fullmatch(t) for t in ("<3..9", "join(1..2,4..9)", "complement(3..9", "3^4", "7"))
    text = "LOCUS x\nFEATURES  q\n     CDS             complement(3..9)\n" + "".join(" " * 21 + q + "\n" for q in ('/note="a', "/b", 'c""d"', "/translation=\"MK", 'LL"', "/pseudo", '/note="second"')) + "ORIGIN\n     CDS  1..2\n//\n"
    assert genbank.parse_features(text) == [("CDS", "complement(3..9)", {"note": 'a /b c"d', "translation": "MKLL", "pseudo": ""})]
