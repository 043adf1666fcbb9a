"""Column functions, cluster files and filters."""

from pyspark.sql import functions as F

from basketloom.functions import genes as g
from basketloom.operators import filters
from basketloom.sources import clusters


def one(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression.alias("x")).first()["x"]


def test_nonempty(spark):
    for held, n in ((["A;B", "-", "C"], 2), (["-", "-"], 0), ([], 0)):
        assert one(spark, g.n_nonempty(F.col("g")), "g array<string>", held) == n


def test_overlap_length(spark):
    for a, b, n in (((0, 5), (4, 8), 1), ((0, 5), (5, 8), 0), ((0, 5), (6, 8), -1), ((0, 10), (5, 7), 2)):
        assert one(spark, g.overlap_length(*map(F.col, "abcd")), "a int, b int, c int, d int", *a, *b) == n


def test_overlaps(spark):
    for a, b, share, wanted in (((0, 5), (4, 8), 0.1, True), ((0, 5), (4, 8), 0.5, False), ((0, 5), (5, 8), 0, False), ((0, 5), (0, 5), 1, False)):
        assert one(spark, g.overlaps(*map(F.col, "abcd"), share), "a int, b int, c int, d int", *a, *b) is wanted


def test_base_name(spark):
    for name, base in (("domain_c1", "domain"), ("domain", "domain"), ("domain_c", "domain_c")):
        assert one(spark, g.base_name(F.col("d")), "d string", name) == base


def test_adjacent_pairs(spark):
    assert set(one(spark, g.adjacent_pairs(F.col("g")), "g array<string>", ["A;B", "C", "-", "E", "D"])) == {"A;B", "B;C", "D;E"}
    assert one(spark, g.adjacent_pairs(F.col("g")), "g array<string>", ["A", "A"]) == ["A;A"]
    assert one(spark, g.adjacent_pairs(F.col("g")), "g array<string>", []) == []


def test_adjacency_index(spark):
    rows = ((["A", "B"], ["A", "B"], 1.0), (["A", "B"], ["A", "B", "C"], 0.5), (["A", "B", "C"], ["A", "B", "D"], 1 / 3), (["A", "B"], ["A", "-", "B"], 0.0))
    for a, b, index in rows:
        assert one(spark, g.adjacency_index(g.adjacent_pairs(F.col("a")), g.adjacent_pairs(F.col("b"))), "a array<string>, b array<string>", a, b) == index


def test_containment(spark):
    for a, b, held in (("ABC", "ABCD", True), ("ABC", "ABD", False), ("AB-", "ABC", True)):
        assert one(spark, g.contains_either(g.domain_set(F.col("a")), g.domain_set(F.col("b"))), "a array<string>, b array<string>", list(a), list(b)) is held


def test_round_significant(spark):
    for x, y in ((0.0123456, 0.0123), (0.0, 0.0), (123456.0, 123000.0)):
        assert abs(one(spark, g.round_significant(F.col("x"), 3), "x double", x) - y) < 1e-9


def test_rewritten_length(spark):
    for held, n in ((["A", "B"], 2), (["A", "A", "B"], 5), (["-", "-", "A"], 3), (["A", "A", "B", "B"], 8)):
        assert one(spark, g.rewritten_length(F.col("g")), "g array<string>", held) == n


def test_cluster_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,X;Y,-\nb,Z\na,W\n")
    rows = {r.bgc_id: r.genes for r in clusters.read_clusters(spark, str(tmp_path / "in.csv")).collect()}
    assert rows == {"a": ["W"], "b": ["Z"]}
    first = clusters.read_clusters(spark, str(tmp_path / "in.csv"), "first", 1)
    assert {r.bgc_id: r.genes for r in first.collect()} == {"a": ["X;Y", "-"], "b": ["Z"]}
    clusters.write_clusters(first.coalesce(1), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(r.value for r in lines) == ["a,X;Y,-", "b,Z"]


def genes_of(spark, baskets):
    rows = [(k, i, gene, n) for n, (k, held) in enumerate(baskets.items()) for i, gene in enumerate(held)]
    return spark.createDataFrame(rows, "bgc_id string, pos int, gene string, ord int")


def test_gene_counts(spark):
    rows = genes_of(spark, {"a": ["X", "-", "Y"], "b": ["Y", "-"]})
    assert [r.value for r in clusters.gene_count_lines(rows).collect()] == ["#Total\t5", "-\t2", "Y\t2", "X\t1"]


def test_domain_filter(spark):
    rows = genes_of(spark, {"g1": ["-", "AzlC", "2OG-Fe_Oxy_2", "Radical_SAM_c10;SPASM_c22", "-"], "g2": ["DoxX", "DUF692"]}).drop("ord")
    include = spark.createDataFrame([("2OG-Fe_Oxy_2",), ("Radical_SAM",), ("SPASM",)], "domain string")
    out = filters.filter_domains(rows, include, 2).orderBy("pos").collect()
    assert [r.gene for r in out] == ["-", "-", "2OG-Fe_Oxy_2", "Radical_SAM_c10;SPASM_c22", "-"]


def test_mask_infrequent(spark):
    rows = genes_of(spark, {"a": ["X", "Y", "X"], "b": ["X", "Z", "Y"], "c": ["Z", "W"]}).drop("ord")
    out = {(r.bgc_id, r.pos): r.gene for r in filters.mask_infrequent(rows, 2, 2).collect()}
    assert out == {("a", 0): "X", ("a", 1): "Y", ("a", 2): "X", ("b", 0): "X", ("b", 1): "Z", ("b", 2): "Y"}
    assert {r.bgc_id for r in filters.mask_infrequent(rows, 3, 2).collect()} == {"a", "b"}
    assert {r.bgc_id for r in filters.mask_infrequent(rows, 3, 2, distinct=True).collect()} == {"b"}


def test_domain_lengths(spark):
    out = {r.bgc_id: r.n_domains for r in filters.domains_per_basket(genes_of(spark, {"a": ["A", "B;C"], "b": ["A", "-"]})).collect()}
    assert out == {"a": 3, "b": 1}


def test_representative_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c"), ("a", "a"), ("b", "b")], "rep string, member string")
    lines = clusters.representative_lines(rows)
    assert [r.value for r in lines.collect()] == ["a\ta,c", "b\tb"]
    lines.coalesce(1).write.text(str(tmp_path / "r"))
    assert sorted(map(tuple, clusters.read_representatives(spark, str(tmp_path / "r")).collect())) == [("a", "a"), ("a", "c"), ("b", "b")]


def test_carried_header(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(["x", "#1", "a", "b", "#2", "c", "d"])], "ord long, line string")
    out = clusters.carried_header(rows, F.col("line").startswith("#"), F.floor(F.col("ord") / 3)).orderBy("ord").collect()
    assert [r.header for r in out] == [None, "#1", "#1", "#1", "#2", "#2", "#2"]
