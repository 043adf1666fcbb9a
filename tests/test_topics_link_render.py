"""Topics, product links, drawings, streams, the pipeline and the command line."""

from pyspark.sql import functions as F

from basketloom.operators import link, render, topics


def test_feature_selection(spark):
    rows = spark.createDataFrame([(0, 0, "A", 0.5), (0, 1, "B", 0.3), (0, 2, "C", 0.2), (0, 3, "D", 0.0), (0, 4, "E", 0.1), (1, 0, "A", 0.0)], "topic int, rank int, gene string, score double")
    out = topics.topic_features(rows, 0.6, 10)
    assert [(r.gene, r.selected) for r in out.orderBy("rank").collect()] == [("A", True), ("B", True), ("C", False)]
    assert [r.selected for r in topics.topic_features(rows, 0.6, 1).orderBy("rank").collect()] == [True, False, False]
    row = topics.topic_table(out).first()
    assert (row.topic_length, row.selected, row.genes, row.scores) == (2, "A:0.5,B:0.3", "A,B,C", "0.5,0.3,0.2")


MATCHES = [("x", 1, 0.9, [("A", 1.0), ("B", 0.5), ("Q", 0.9)], 0.8), ("y", 1, 0.2, [("A", 2.0)], 0.5), ("z", 1, 0.1, [("B", 0.2)], 0.3), ("w", 2, 0.4, [], 0.0)]
SCHEMA = "bgc_id string, topic int, prob double, feats array<struct<gene:string,p:double>>, overlap_score double"
FEATURES = [(1, "A", 0.5), (1, "B", 0.3)]


def test_matches(spark):
    found = spark.createDataFrame(MATCHES, SCHEMA)
    features = spark.createDataFrame(FEATURES, "topic int, gene string, score double")
    kept = topics.filter_matches(found, features)
    assert {(r.bgc_id, tuple(f.gene for f in r.feats), round(r.overlap_score, 6)) for r in kept.collect()} == {("x", ("A", "B"), 0.8), ("y", ("A",), 0.5)}
    classes = spark.createDataFrame([("x", "NRP"), ("z", "RiPP")], "bgc_id string, class string")
    row = {r.topic: tuple(r) for r in topics.class_summary(found, classes).collect()}
    assert row[1] == (1, 3, 2, "NRP:1,None:1,RiPP:1", "NRP:1,None:1") and row[2] == (2, 1, 0, "None:1", "")
    lines = {(r.topic, r.place): r.value for r in topics.match_lines(found, classes).collect()}
    assert lines[1, 1] == "0.200\t0.500\tA:2.00\ty\tNone" and lines[1, 3].startswith("0.900\t0.800\tA:1.00,B:0.50,Q:0.90\tx")
    assert lines[2, 0].startswith("#Topic 2, matches:1,") and (2, 1) not in lines
    blocks = {r.bgc_id: r.value for r in topics.basket_lines(kept, classes).collect()}
    assert blocks["x"] == ">x\nclass=NRP\n1\t0.900\t0.800\tA:1.00,B:0.50"
    counts = {r.n_topics: r.baskets for r in topics.topics_per_basket(kept, spark.createDataFrame([("x",), ("y",), ("q",)], "bgc_id string"), True).collect()}
    assert counts == {1: 2, 0: 1}


def test_known_overlap(spark):
    found = spark.createDataFrame(MATCHES, SCHEMA)
    known = spark.createDataFrame([("k1", ["A", "A", "-", "B"]), ("k2", ["A", "C", "D"]), ("k3", ["A"])], "group string, genes array<string>")
    rows = {(r.group, r.bgc_id): (r.overlap, r.n_overlap, r.genes, r.other_genes) for r in topics.known_overlap(found, known).collect()}
    assert rows == {("k1", "x"): (0.667, 2, "A:1.00,B:0.50", "Q:0.90"), ("k1", "y"): (0.667, 2, "A:2.00", "")}
    assert [r.found for r in topics.known_by_threshold(topics.known_overlap(found, known), known).orderBy("threshold").collect()] == [1, 1, 1, 0, 0, 0, 0]


def test_known_groups_one_by_one(spark):
    """Groups of one name are compared each by itself; copies of groups and matches meet as one; the best overlaps need no rows of matches."""
    found = spark.createDataFrame([("x", 1, 0.9, [("A", 1.0), ("C", 2.0)], 0.8), ("y", 2, 0.2, [("B", 1.0)], 0.5)], SCHEMA)
    known = spark.createDataFrame([("k", ["A", "B"]), ("k", ["C", "D"]), ("m", ["C", "C", "Z"])], "group string, genes array<string>")
    rows = sorted((r.group, r.bgc_id, r.overlap, r.n_overlap, r.genes, r.other_genes) for r in topics.known_overlap(found, known).collect())
    assert rows == [("k", "x", 0.5, 1, "A:1.00", "C:2.00"), ("k", "x", 0.5, 1, "C:2.00", "A:1.00"), ("k", "y", 0.5, 1, "B:1.00", ""), ("m", "x", 0.667, 2, "C:2.00", "A:1.00")]
    many = spark.createDataFrame([(f"x{k}", k, 0.9, [("A", 1.0), ("B", 1.0)], 0.8) for k in range(300)], SCHEMA)
    alike = spark.createDataFrame([(f"k{k}", ["B", "A", "-"]) for k in range(300)], "group string, genes array<string>")
    assert topics.known_overlap(many, alike).groupBy("overlap", "n_overlap").count().collect() == [(1.0, 2, 90_000)]
    one = topics._in_blocks(many.select("bgc_id", "feats"), "feats").withColumnRenamed("held", "matches")
    two = topics._in_blocks(topics._groups(alike), "members", "size").withColumnRenamed("held", "groups")
    assert topics._met(two, one, 0.4).count() <= 16
    best = {(r.group, r.overlap) for r in topics.best_overlaps(found, known).collect()}
    assert best == {("k", 0.5), ("m", 0.667)}
    assert {tuple(r) for r in topics.known_by_threshold(topics.best_overlaps(many, alike), alike).collect()} == {(t, 300) for t in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)}


def test_sums_at_a_cutoff(spark):
    """0.001 + 0.008 is 0.009 and not above it, whatever doubles make of it; so is ten times 0.005 in any order."""
    features = spark.createDataFrame([(1, "A", 0.001), (1, "B", 0.008), (2, "A", 0.001), (2, "B", 0.0081)], "topic int, gene string, score double")
    found = spark.createDataFrame([("x", t, 0.5, [("A", 1.0), ("B", 1.0)], 0.0) for t in (1, 2)], SCHEMA)
    assert [(r.topic, r.overlap_score) for r in topics.filter_matches(found, features, 0.3, 1.1, 0.009).collect()] == [(2, 0.0091)]
    features = spark.createDataFrame([(1, f"g{k}", x) for k, x in enumerate((0.006, 0.004) * 5)], "topic int, gene string, score double")
    found = spark.createDataFrame([(str(b), 1, 0.5, [(f"g{k}", 1.0) for k in sorted(range(10), key=lambda k: (k * (b + 3) % 11, k))], 0.0) for b in range(8)], SCHEMA)
    assert topics.filter_matches(found, features, 0.3, 1.1, 0.05).isEmpty()

def test_topic_model(spark, tmp_path):
    rows = [(f"b{k}", ["A", "B", "C"] if k % 2 else ["X", "Y", "Z"]) for k in range(40)]
    baskets = spark.createDataFrame(rows, "bgc_id string, genes array<string>")
    model = topics.TopicModel.train(baskets, topics=2, iterations=20, chunk=40, seed=1)
    model.save(str(tmp_path / "model"))
    model = topics.TopicModel.load(str(tmp_path / "model"))
    terms = model.terms(spark).collect()
    assert {r.gene for r in terms} == set("ABCXYZ") and {r.topic for r in terms} == {0, 1}
    found = topics.scored_matches(model.matches(baskets), topics.topic_features(model.terms(spark)))
    best = {}
    for r in found.collect():
        if r.prob > 0.5:
            best[r.bgc_id] = (r.topic, {f.gene for f in r.feats if f.p > 0.5})
    assert best["b1"][1] == set("ABC") and best["b2"][1] == set("XYZ") and best["b1"][0] != best["b2"][0]
    total = model.matches(baskets).filter("bgc_id = 'b1'").agg(F.sum("p")).first()[0]
    assert abs(total - 3) < 0.05
    assert {r.gene for r in model.term_topics(spark).collect()} == set("ABCXYZ")
    assert topics.TopicModel.passes(1000, 2000, 4001) == 500
    assert topics.amplified(baskets, 3).count() == 120


def test_links(spark):
    products = spark.createDataFrame([("n1", "Strepto", "albus T1", ["a", "b", "c"], "no"), ("n2", "Strepto", "sp.", ["a", "b", "c"], "no"), ("n3", "Bacillus", "x", ["a", "b", "c"], "no")], "np_id string, genus string, species string, info array<string>, has_mibig string")
    taxonomy = spark.createDataFrame([("g1", "STREPTO albus t1"), ("g2", "Strepto albus"), ("g3", "Strepto other"), ("g4", "Bacillus x")], "bgc string, taxonomy string")
    motif = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "bgc string")
    links = link.link_products(products, taxonomy, motif)
    assert {(r.np_id, r.bgc, r.level) for r in links.collect()} == {("n1", "g1", "exact"), ("n1", "g2", "species"), ("n1", "g3", "genus"), *(("n2", g, "genus") for g in ("g1", "g2", "g3"))}
    text = {r.np_id: r.value for r in link.report_lines(links, products).collect()}
    assert text["n1"] == ">n1\tStrepto\talbus T1\ta\tb\tc\tno\n#Exact_matches:\ng1 STREPTO albus t1\n#Species_matches:\ng2 Strepto albus\n#Genus_matches:\ng3\tStrepto other"
    assert "#Genus_matches:\ng1\tSTREPTO albus t1\ng2 Strepto albus" in text["n2"]


HITS = "bgc string, location string, orf_num int, domain string, q_start int, q_end int"


def test_links_of_short_names(spark):
    """Genera of any length against plain containment: shorter than the grams that meet, empty, and null."""
    genera = ["a", "Ba", "bac", "Baci", "bacill", "", None, "x", "  "]
    texts = ["Bacillus sp", "abc", "", "X", "a  b", "ba"]
    products = spark.createDataFrame([(f"n{k}", g, "sp.") for k, g in enumerate(genera)], "np_id string, genus string, species string")
    taxonomy = spark.createDataFrame([(f"g{k}", t) for k, t in enumerate(texts)], "bgc string, taxonomy string")
    wanted = {(f"n{i}", f"g{j}") for i, g in enumerate(genera) for j, t in enumerate(texts) if g is not None and g.lower() in t.lower()}
    rows = link.link_products(products, taxonomy)
    assert {(r.np_id, r.bgc) for r in rows.collect()} == wanted
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in rows._jdf.queryExecution().executedPlan().toString()


def test_links_of_one_text_are_dealt(spark, monkeypatch):
    """Products and baskets of a single text are the work of several tasks; nulls and repeated rows stay."""
    from collections import Counter

    for name, most in (("BLOCK", 8), ("PRODUCTS", 10), ("BLOCKS", 2)):
        monkeypatch.setattr(link, name, most, raising=False)
    products = [(f"n{k}", "Strepto", "albus") for k in range(60)] + [("n0", "Strepto", "albus"), (None, "Strepto", "x"), ("other", "Bacillus", "x"), ("empty", "Strepto", ""), ("null", "Strepto", None)]
    baskets = [(f"g{k}", "Strepto albus") for k in range(150)] + [("g0", "Strepto albus"), (None, "Strepto albus"), ("h", None), ("i", "Nothing")]
    rows = link.link_products(spark.createDataFrame(products, "np_id string, genus string, species string"), spark.createDataFrame(baskets, "bgc string, taxonomy string"))
    wanted = Counter((n, b, "genus" if s == "x" else "exact") for n, g, s in products for b, t in baskets if g in (t or ""))
    assert Counter((r.np_id, r.bgc, r.level) for r in rows.collect()) == wanted
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == sum(wanted.values()) and max(sizes) < sum(sizes) / 3


def test_geometry_and_drawing(spark):
    hits = spark.createDataFrame([("b", "<0;900;+", 1, "A", 10, 110), ("b", "1000;1900;-", 2, "B", 10, 110)], HITS)
    rows = {r.gene_key: (r.start, r.width, r.height) for r in render.hit_geometry(hits).collect()}
    assert rows == {"b_1": (1, 10, 24), "b_2": (19, 10, 24)}
    marked = spark.createDataFrame([("b", ["A"])], "bgc string, genes array<string>")
    text = render.render(hits, marked, {"A": (1, 2, 3)}).first().svg
    assert text.count("<polygon") == 2 and text.count("<rect") == 1 and "rgb(1,2,3)" in text
    assert render.render(hits).first().svg.count("<rect") == 2


def test_streams(spark, tmp_path):
    from basketloom.streaming import detect

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x,A,B,C\ny,A\n")
    known = spark.createDataFrame([(1, ["A", "B"]), (2, ["C", "D"])], "module_id long, genes array<string>")
    run = detect.detect_stream(detect.read_cluster_stream(spark, str(folder)), known).writeStream.format("memory").queryName("found").outputMode("append").start()
    run.processAllAvailable()
    (folder / "b.csv").write_text("z,D,C\n")
    run.processAllAvailable()
    run.stop()
    assert {(r.bgc_id, r.module_id) for r in spark.table("found").collect()} == {("x", 1), ("z", 2)}


def test_pipeline_and_command_line(spark, tmp_path):
    from basketloom import cli
    from basketloom.plans.pipeline import Config, Run

    lines = [f"b{k},{','.join(['A', 'B', 'C'] if k % 2 else ['X', 'Y', 'Q' + str(k % 3)])}" for k in range(30)]
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "names").write_text("A\nB\nC\nX\nY\n")
    config = Config(out=str(tmp_path / "out"), clusters=str(tmp_path / "c.csv"), domain_filtering=True, include_list=str(tmp_path / "names"), topic=True, topics=2, iterations=5)
    out = Run(spark, config).run()
    assert out["clusters"].count() == 30
    assert {(r.bgc_id, tuple(r.genes)) for r in out["detected"].collect()} == {(f"b{k}", ("A", "B", "C")) for k in range(1, 30, 2)}
    cli.main(["run", "--out", str(tmp_path / "out2"), "--clusters", str(tmp_path / "c.csv"), "--similarity_filtering", "--pval_cutoff", "0.5"], spark)
    assert (tmp_path / "out2" / "representatives").exists()
    try:
        Config(out="x").check()
    except ValueError:
        pass
    else:
        raise AssertionError("a run without input must be refused")


def test_hits_are_gathered_once(spark):
    """Genes and baskets from one shuffle; columns of genes are read like lists of genes."""
    hits = spark.createDataFrame([("b", k, f"{k * 1000};{k * 1000 + 900};{'+-'[k % 2]}", d, 3 * k, 3 * k + 9) for k in range(5) for d in ("x", "y<")], "bgc string, orf_num int, location string, domain string, q_start int, q_end int")
    drawn = render.render(hits)
    assert drawn._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    genes = [{"gene_key": f"b_{k}", "gene": "x;y<", "start": k * 1000.0, "end": k * 1000 + 900.0, "strand": "+-"[k % 2], "domains": [{"domain": d, "start": int((3 * 3 * k if k % 2 == 0 else 900 - 9 * k - 27) / 30), "width": 0, "height": 24} for d in ("x", "y<")]} for k in range(5)]
    assert [r.svg for r in drawn.collect()] == [render.svg(genes)]
