"""The queries of ``plans.queries`` in plain SQL, where SQL can say them."""

from __future__ import annotations

# Orders as baskets: genes by place, and as lists.
_GENES = """
WITH genes AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS bgc_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INTEGER) AS pos,
         CASE WHEN p_type LIKE '%PROMO%' THEN '-' ELSE {gene} END AS gene
  FROM lineitem JOIN part ON l_partkey = p_partkey),
baskets AS (SELECT bgc_id, list(gene ORDER BY pos) AS genes FROM genes GROUP BY bgc_id)
"""
ORDERS = _GENES.format(gene="replace(p_name, ' ', ';')")
RARE = _GENES.format(gene="replace(p_name, ' ', ';') || '_c' || p_size")
PARTS = _GENES.format(gene="'p' || l_partkey")

_HITS = """
WITH hits AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS cluster_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, replace(p_name, ' ', '_')) - 1 AS ord,
         replace(p_name, ' ', '_') AS domain, l_linenumber AS orf_num, CAST(l_partkey % 100 AS INTEGER) AS q_start,
         CAST(l_partkey % 100 + CAST(trunc(l_quantity) AS INTEGER) AS INTEGER) AS q_end, l_extendedprice AS bitscore
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

_SURVIVORS = """
SELECT {out} FROM {src} x WHERE NOT EXISTS (
  SELECT 1 FROM {src} y WHERE {same} AND y.ord <> x.ord
    AND least(x.q_end, y.q_end) - greatest(x.q_start, y.q_start) > least(x.q_end - x.q_start, y.q_end - y.q_start) * 0.1::DOUBLE
    AND (y.bitscore > x.bitscore OR (y.bitscore = x.bitscore AND y.ord < x.ord)))
"""

# Pairs of part baskets that share a domain.
_MEASURES = PARTS + """,
real AS (SELECT bgc_id, genes FROM baskets WHERE len(list_filter(genes, lambda g: g <> '-')) >= {least}),
dom AS (SELECT DISTINCT bgc_id, unnest(genes) AS d FROM real), doms AS (SELECT * FROM dom WHERE d <> '-'),
nb AS (SELECT bgc_id, unnest(list_zip(genes[1:len(genes) - 1], genes[2:])) AS z FROM real WHERE len(genes) > 1),
adj AS (SELECT DISTINCT bgc_id, least(z[1], z[2]) || ';' || greatest(z[1], z[2]) AS p FROM nb WHERE z[1] <> '-' AND z[2] <> '-'),
n AS (SELECT bgc_id, count(*) AS n FROM doms GROUP BY 1), m AS (SELECT bgc_id, count(*) AS m FROM adj GROUP BY 1),
n12 AS (SELECT a.bgc_id AS bgc1, b.bgc_id AS bgc2, count(*) AS n12 FROM doms a JOIN doms b ON a.d = b.d AND a.bgc_id < b.bgc_id GROUP BY 1, 2),
m12 AS (SELECT a.bgc_id AS bgc1, b.bgc_id AS bgc2, count(*) AS m12 FROM adj a JOIN adj b ON a.p = b.p AND a.bgc_id < b.bgc_id GROUP BY 1, 2),
measures AS (
  SELECT n12.bgc1, n12.bgc2, coalesce(m12 * 1.0::DOUBLE / (ma.m + mb.m - m12), 0.0::DOUBLE) AS ai, n12 = least(na.n, nb.n) AS contained
  FROM n12 JOIN n na ON na.bgc_id = n12.bgc1 JOIN n nb ON nb.bgc_id = n12.bgc2
  LEFT JOIN m12 ON m12.bgc1 = n12.bgc1 AND m12.bgc2 = n12.bgc2 LEFT JOIN m ma ON ma.bgc_id = n12.bgc1 LEFT JOIN m mb ON mb.bgc_id = n12.bgc2)
"""
MEASURES, MEASURES3 = _MEASURES.replace("{least}", "1"), _MEASURES.replace("{least}", "3")

# Neighbours within baskets of two genes or more.
_NEAR = ORDERS + """,
t AS (
  SELECT lag(gene) OVER w AS p, gene AS g, lead(gene) OVER w AS n, count(*) OVER (PARTITION BY bgc_id) AS len
  FROM genes WINDOW w AS (PARTITION BY bgc_id ORDER BY pos)),
tt AS (SELECT p, g, n FROM t WHERE len > 1),
own AS (SELECT g AS gene, 1 AS cnt, CASE WHEN p IS NULL OR n IS NULL THEN 1 ELSE 2 END AS n1, 0 AS n2 FROM tt WHERE g <> '-'),
moved AS (SELECT p AS gene, 0 AS cnt, -2 AS n1, 1 AS n2 FROM tt WHERE p = n AND p <> '-'),
adj_node AS (SELECT gene, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2 FROM (SELECT * FROM own UNION ALL SELECT * FROM moved) GROUP BY gene),
near AS (
  SELECT g AS a, p AS b, 1 AS b1, 0 AS b2 FROM tt WHERE g <> '-' AND p <> '-' AND p <> g
  UNION ALL SELECT g, n, 1, 0 FROM tt WHERE g <> '-' AND n <> '-' AND n <> g
  UNION ALL SELECT p, g, -2, 1 FROM tt WHERE p = n AND p <> '-' AND g <> '-' AND g <> p),
adj_pair AS (SELECT a, b, CAST(sum(b1) AS BIGINT) AS b1, CAST(sum(b2) AS BIGINT) AS b2 FROM near GROUP BY a, b HAVING sum(b1) <> 0 OR sum(b2) <> 0)
"""
_COLOC = ORDERS + """,
u AS (SELECT DISTINCT bgc_id, gene FROM genes WHERE gene <> '-'),
dup AS (SELECT bgc_id, count(*) AS d FROM (SELECT bgc_id, gene FROM genes WHERE gene <> '-' GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
lens AS (SELECT g.bgc_id, g.c + 2 * coalesce(d, 0) AS len2 FROM (SELECT bgc_id, count(*) AS c FROM genes GROUP BY 1) g LEFT JOIN dup USING (bgc_id)),
co_node AS (SELECT gene, count(*) AS cnt, CAST(sum(len2 - 1) AS BIGINT) AS n1 FROM u JOIN lens USING (bgc_id) GROUP BY gene),
co_pair AS (SELECT x.gene AS a, y.gene AS b, count(*) AS b1 FROM u x JOIN u y ON x.bgc_id = y.bgc_id AND x.gene <> y.gene GROUP BY 1, 2)
"""
# Log binomials; places that cannot be filled have probability 0.
_CHOOSE = "(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def _c(n: str, k: str) -> str:
    return _CHOOSE.format(n=n, k=k)


_COP = _COLOC + f""",
par AS (
  SELECT a, b, b1, x.n1 AS n1, y.cnt AS bt, t.n - x.cnt AS nt, t.n - x.cnt - x.n1 AS n0
  FROM co_pair JOIN co_node x ON x.gene = a JOIN co_node y ON y.gene = b, (SELECT sum(len2) AS n FROM lens) t),
co_p AS (
  SELECT a, b, least(1.0, list_sum(list_transform(range(CAST(b1 AS BIGINT), CAST(least(n1, bt) AS BIGINT) + 1),
    lambda d: CASE WHEN bt - d > n0 THEN 0.0 ELSE exp({_c("n1", "d")} + {_c("n0", "(bt - d)")} - {_c("nt", "bt")}) END))) AS pval
  FROM par)
"""
_ADP = _NEAR + f""",
par AS (
  SELECT a, b, b1, b2, x.n1 AS n1, x.n2 AS n2, y.cnt AS bt, t.n - x.cnt AS nt, t.n - x.cnt - x.n1 - x.n2 AS n0
  FROM adj_pair JOIN adj_node x ON x.gene = a JOIN adj_node y ON y.gene = b, (SELECT count(*) AS n FROM genes) t),
ad_p AS (
  SELECT a, b, 1 - CASE WHEN b2 = 0 OR b1 = 0 THEN
      coalesce(list_sum(list_transform(range(CASE WHEN b2 = 0 THEN b1 ELSE b2 END),
        lambda d: CASE WHEN d > (CASE WHEN b2 = 0 THEN n1 ELSE n2 END) THEN 0.0 ELSE exp({_c("(CASE WHEN b2 = 0 THEN n1 ELSE n2 END)", "d")} + {_c("n0", "(bt - d)")} - {_c("nt", "bt")}) END)), 0.0)
    ELSE
      coalesce(list_sum(list_transform(range((b1 + 1) * (b2 + 1) - 1),
        lambda i: CASE WHEN i // (b2 + 1) > n1 OR i % (b2 + 1) > n2 THEN 0.0
          ELSE exp({_c("n1", "(i // (b2 + 1))")} + {_c("n2", "(i % (b2 + 1))")} + {_c("n0", "(bt - i // (b2 + 1) - i % (b2 + 1))")} - {_c("nt", "bt")}) END)), 0.0)
    END AS pval
  FROM par)
"""


def _by(source: str, name: str) -> str:
    """Benjamini-Yekutieli over the directed p-values of a relation."""
    return f""",
{name}_n AS (SELECT count(*) AS n, sum(1.0 / i) AS c FROM (SELECT row_number() OVER () AS i FROM {source})),
{name}_r AS (SELECT a, b, pval, row_number() OVER (ORDER BY pval, a, b) AS r FROM {source}),
{name} AS (SELECT a, b, least(1.0, min(pval * n * c / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj FROM {name}_r, {name}_n)
"""


def _max2(source: str, column: str) -> str:
    return f"SELECT least(a, b) AS g1, greatest(a, b) AS g2, max({column}) AS pval FROM {source} GROUP BY 1, 2 HAVING count(*) = 2"


_WEAK = _COP + f", e AS (SELECT * FROM ({_max2('co_p', 'pval')}) WHERE pval <= 0.1)"
_TRI = _WEAK + """,
both_e AS (SELECT g1 AS u, g2 AS v, pval FROM e UNION ALL SELECT g2, g1, pval FROM e),
tri AS (
  SELECT x.g1 AS a, x.g2 AS b, y.g2 AS c, greatest(x.pval, y.pval, z.pval) AS w
  FROM e x JOIN e y ON y.g1 = x.g2 JOIN e z ON z.g1 = x.g1 AND z.g2 = y.g2),
modules AS (
  SELECT a, b, c, w FROM tri WHERE NOT EXISTS (
    SELECT 1 FROM both_e p JOIN both_e q ON p.v = q.v JOIN both_e r ON p.v = r.v
    WHERE p.u = tri.a AND q.u = tri.b AND r.u = tri.c AND p.pval <= w AND q.pval <= w AND r.pval <= w)),
held AS (
  SELECT m.a, m.b, m.c, m.w, x.bgc_id FROM modules m JOIN u x ON x.gene = m.a JOIN u y ON y.gene = m.b AND y.bgc_id = x.bgc_id JOIN u z ON z.gene = m.c AND z.bgc_id = x.bgc_id),
occ AS (SELECT m.a, m.b, m.c, m.w, count(h.bgc_id) AS n FROM modules m LEFT JOIN held h ON h.a = m.a AND h.b = m.b AND h.c = m.c GROUP BY 1, 2, 3, 4)
"""

_TERMS = """
WITH counts AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS topic, replace(p_name, ' ', ';') AS gene, count(*) AS n FROM part GROUP BY 1, 2),
terms AS (
  SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, gene) - 1 AS INTEGER) AS rank, gene,
         round(n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY topic) - 0.01::DOUBLE, 3) AS score FROM counts),
cut AS (SELECT t.* FROM terms t LEFT JOIN (SELECT topic, min(rank) AS z FROM terms WHERE score = 0 GROUP BY 1) USING (topic) WHERE z IS NULL OR rank < z),
features AS (
  SELECT topic, rank, gene, score,
         coalesce(sum(score) OVER (PARTITION BY topic ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) < 0.5 AND row_number() OVER (PARTITION BY topic ORDER BY rank) <= 10 AS selected
  FROM cut)
"""
_MATCH = _TERMS + """,
links AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS bgc_id, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS topic, replace(p_name, ' ', ';') AS gene, count(*) * 0.25::DOUBLE AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
kept AS (SELECT l.bgc_id, l.topic, l.gene, l.p, f.score FROM links l JOIN features f ON f.topic = l.topic AND f.gene = l.gene WHERE p >= 0.3),
filtered AS (SELECT bgc_id, topic, count(*) AS n, sum(p) AS total, sum(score) AS overlap_score, max(p) AS pmax FROM kept GROUP BY 1, 2 HAVING sum(p) > 1.1 AND sum(score) > 0.05),
longs AS (SELECT *, n > 1 OR round_even(pmax, 0) > 1 AS long FROM filtered),
classes AS (SELECT CAST(s_suppkey AS VARCHAR) AS bgc_id, n_name AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tc AS (SELECT topic, coalesce(class, 'None') AS class, count(*) AS n, count_if(long) AS n_long FROM longs LEFT JOIN classes USING (bgc_id) GROUP BY 1, 2)
"""
_KNOWN = _MATCH + """,
members AS (
  SELECT 'k' || (p_partkey // 4) AS grp, replace(p_name, ' ', ';') AS gene, count(*) AS times FROM part GROUP BY 1, 2),
sizes AS (SELECT grp, sum(times) AS size FROM members GROUP BY 1 HAVING sum(times) > 1),
met AS (
  SELECT m.grp, s.size, k.bgc_id, k.topic, sum(1 + CASE WHEN times > 1 AND round_even(p, 0) >= times THEN times - 1 ELSE 0 END) AS n_overlap
  FROM kept k JOIN filtered f ON f.bgc_id = k.bgc_id AND f.topic = k.topic JOIN members m ON m.gene = k.gene JOIN sizes s ON s.grp = m.grp GROUP BY 1, 2, 3, 4),
known AS (SELECT grp, round(n_overlap * 1.0::DOUBLE / size, 3) AS overlap, n_overlap, bgc_id, topic FROM met WHERE n_overlap * 1.0::DOUBLE / size > 0.4)
"""

ORACLES: dict[str, str] = {
    "gene_counts": ORDERS + "SELECT gene, count(*) AS n FROM genes GROUP BY gene",
    "gene_count_lines": ORDERS + "SELECT gene || chr(9) || count(*) AS value FROM genes GROUP BY gene UNION ALL SELECT '#Total' || chr(9) || count(*) FROM genes",
    "nonempty_gene_counts": ORDERS + "SELECT bgc_id, CAST(count_if(gene <> '-') AS INTEGER) AS n_genes FROM genes GROUP BY bgc_id",
    "min_genes_filter": ORDERS + "SELECT bgc_id, array_to_string(genes, ',') AS genes FROM baskets WHERE len(list_filter(genes, lambda g: g <> '-')) >= 3",
    "suffix_strip": "SELECT regexp_replace(split_part(p_name, ' ', 1) || CASE WHEN p_size % 2 = 0 THEN '_c' || p_size ELSE '_c' END, '_c\\d+$', '') AS domain, count(*) AS n FROM part GROUP BY 1",
    "include_list_filter": ORDERS + """, kept AS (
        SELECT bgc_id, pos, CASE WHEN gene = '-' THEN '-' ELSE coalesce(nullif(array_to_string(list_filter(string_split(gene, ';'), lambda d: d < 'n'), ';'), ''), '-') END AS gene FROM genes)
        SELECT * FROM kept WHERE bgc_id IN (SELECT bgc_id FROM kept GROUP BY 1 HAVING count_if(gene <> '-') >= 2)""",
    "infrequent_mask": RARE + """, f AS (SELECT gene FROM genes WHERE gene <> '-' GROUP BY 1 HAVING count(*) >= 20),
        m AS (SELECT bgc_id, pos, CASE WHEN gene IN (SELECT gene FROM f) THEN gene ELSE '-' END AS gene FROM genes)
        SELECT * FROM m WHERE bgc_id IN (SELECT bgc_id FROM m GROUP BY 1 HAVING count_if(gene <> '-') >= 2)""",
    "infrequent_mask_distinct": ORDERS + """, f AS (SELECT gene FROM genes WHERE gene <> '-' GROUP BY 1 HAVING count(*) >= 3),
        m AS (SELECT bgc_id, pos, CASE WHEN gene IN (SELECT gene FROM f) THEN gene ELSE '-' END AS gene FROM genes)
        SELECT * FROM m WHERE bgc_id IN (SELECT bgc_id FROM m GROUP BY 1 HAVING count(DISTINCT nullif(gene, '-')) >= 3)""",
    "duplicate_first": "SELECT min(event_id) AS ord, CAST(user_id AS VARCHAR) AS bgc_id, arg_min(event_type, event_id) || ',' || user_id AS genes FROM events GROUP BY user_id",
    "duplicate_last": "SELECT min(event_id) AS ord, CAST(user_id AS VARCHAR) AS bgc_id, arg_max(event_type, event_id) || ',' || user_id AS genes FROM events GROUP BY user_id",
    "cluster_line_roundtrip": ORDERS + "SELECT bgc_id || ',' || array_to_string(genes, ',') AS line, bgc_id, array_to_string(genes, ',') AS genes, CAST(len(genes) AS INTEGER) AS n FROM baskets",
    "excluded_names": "SELECT p_partkey, p_name AS name FROM part WHERE p_name NOT LIKE '%ring%' AND p_name NOT LIKE '%red%'",
    "interval_overlap_survivors": _HITS + _SURVIVORS.format(out="cluster_id, ord, q_start, q_end, bitscore", src="hits", same="x.cluster_id = y.cluster_id"),
    "domain_hits": _HITS + """, one AS (SELECT cluster_id, orf_num, domain, min(ord) AS ord, arg_min(q_start, ord) AS q_start, arg_min(q_end, ord) AS q_end, arg_min(bitscore, ord) AS bitscore FROM hits GROUP BY 1, 2, 3)
        """ + _SURVIVORS.format(out="cluster_id, ord, cluster_id AS bgc, '' AS g_id, 'P' AS p_id, '0;9;+' AS location, orf_num, 7 AS tot_orf, domain, q_start, q_end, bitscore", src="one", same="x.cluster_id = y.cluster_id AND x.orf_num = y.orf_num"),
    "gap_fill": _HITS + """, g AS (SELECT cluster_id, orf_num, string_agg(domain, ';' ORDER BY q_start, ord) AS gene FROM hits GROUP BY 1, 2),
        slots AS (SELECT DISTINCT cluster_id, unnest(range(1, 8)) AS orf_num FROM hits)
        SELECT s.cluster_id AS bgc_id, CAST(s.orf_num - 1 AS INTEGER) AS pos, coalesce(gene, '-') AS gene FROM slots s LEFT JOIN g ON g.cluster_id = s.cluster_id AND g.orf_num = s.orf_num""",
    "domain_lengths": ORDERS + "SELECT bgc_id, CAST(sum(CASE WHEN gene = '-' THEN 0 ELSE len(string_split(gene, ';')) END) AS BIGINT) AS n_domains FROM genes GROUP BY bgc_id",
    "adjacent_domain_pairs": ORDERS + """, flat AS (SELECT bgc_id, string_split(array_to_string(genes, ';'), ';') AS d FROM baskets),
        z AS (SELECT bgc_id, unnest(list_zip(d[1:len(d) - 1], d[2:])) AS z FROM flat WHERE len(d) > 1)
        SELECT DISTINCT bgc_id, least(z[1], z[2]) || ';' || greatest(z[1], z[2]) AS pair FROM z WHERE z[1] <> '-' AND z[2] <> '-'""",
    "adjacency_index_pairs": MEASURES + "SELECT bgc1, bgc2, round(ai, 6) AS ai FROM measures WHERE ai > 0",
    "containment_pairs": MEASURES + "SELECT bgc1, bgc2 FROM measures WHERE contained",
    "similarity_edges": MEASURES + "SELECT bgc1, bgc2, round(ai, 6) AS ai, contained FROM measures WHERE contained OR ai > 0.3",
    "unique_baskets": MEASURES + ", ed AS (SELECT * FROM measures WHERE contained OR ai > 0.3) SELECT bgc_id FROM real WHERE bgc_id NOT IN (SELECT bgc1 FROM ed) AND bgc_id NOT IN (SELECT bgc2 FROM ed)",
    "connected_components": MEASURES3.replace("WITH genes", "WITH RECURSIVE genes") + """, ed AS (SELECT bgc1 AS u, bgc2 AS v FROM measures WHERE contained OR ai > 0.2 UNION SELECT bgc2, bgc1 FROM measures WHERE contained OR ai > 0.2),
        reach AS (SELECT u, u AS r FROM ed UNION SELECT ed.v AS u, reach.r FROM reach JOIN ed ON ed.u = reach.u)
        SELECT u AS bgc_id, min(r) AS component FROM reach GROUP BY u""",
    "adjacency_node_counts": _NEAR + "SELECT * FROM adj_node",
    "adjacency_pair_counts": _NEAR + "SELECT * FROM adj_pair",
    "colocation_node_counts": _COLOC + "SELECT * FROM co_node",
    "colocation_pair_counts": _COLOC + "SELECT * FROM co_pair",
    "position_totals": _COLOC + "SELECT 'adjacency' AS kind, CAST(count(*) AS BIGINT) AS n FROM genes UNION ALL SELECT 'colocation', CAST(sum(len2) AS BIGINT) FROM lens",
    "colocation_pvalues": _COP + "SELECT a, b, round(pval, 6) AS pval FROM co_p",
    "adjacency_pvalues": _ADP + "SELECT a, b, round(pval, 6) AS pval FROM ad_p",
    "adjusted_pvalues": _COP + _by("co_p", "byc") + "SELECT a, b, round(adj, 6) AS adj FROM byc",
    "significant_edges": _WEAK + "SELECT g1, g2, round(pval, 6) AS pval FROM e",
    "triangle_modules": _TRI + "SELECT a || ',' || b || ',' || c AS genes, round(w, 6) AS strictest_pval FROM modules",
    "module_occurrences": _TRI + "SELECT a || ',' || b || ',' || c AS genes, n AS occurences FROM occ",
    "filtered_modules": _TRI + "SELECT row_number() OVER (ORDER BY w, a || ',' || b || ',' || c) AS module_id, a || ',' || b || ',' || c AS genes, round(w, 6) AS strictest_pval, n AS occurences FROM occ WHERE n >= 2",
    "detected_modules": _TRI + "SELECT bgc_id, a || ',' || b || ',' || c AS genes FROM held",
    "detected_module_ids": _TRI + """, ids AS (SELECT *, row_number() OVER (ORDER BY w, a || ',' || b || ',' || c) AS id FROM modules),
        found AS (SELECT h.bgc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS module_ids FROM held h JOIN ids i ON i.a = h.a AND i.b = h.b AND i.c = h.c GROUP BY 1)
        SELECT b.bgc_id, coalesce(module_ids, '') AS module_ids FROM baskets b LEFT JOIN found USING (bgc_id)""",
    "detected_blocks": _TRI + """, ids AS (SELECT *, row_number() OVER (ORDER BY w, a || ',' || b || ',' || c) AS id FROM modules),
        found AS (SELECT h.bgc_id, string_agg(id || chr(9) || h.a || ',' || h.b || ',' || h.c, chr(10) ORDER BY id) AS lines FROM held h JOIN ids i ON i.a = h.a AND i.b = h.b AND i.c = h.c GROUP BY 1)
        SELECT b.bgc_id, '>' || b.bgc_id || coalesce(chr(10) || lines, '') AS value FROM baskets b LEFT JOIN found USING (bgc_id)""",
    "selected_modules": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')",
    "lines_file": "SELECT row_number() OVER (ORDER BY event_id) AS line_no, event_type || ' ' || user_id AS line FROM events",
    "clusters_file_last": "SELECT CAST(user_id AS VARCHAR) AS bgc_id, arg_max(event_type, event_id) || ',' || max(event_id) AS genes FROM events GROUP BY user_id",
    "clusters_file_first": "SELECT CAST(user_id AS VARCHAR) AS bgc_id, arg_min(event_type, event_id) || ',' || min(event_id) AS genes FROM events GROUP BY user_id",
    "modules_file": """SELECT CAST(p_partkey AS VARCHAR) AS module_id, replace(p_name, ' ', ';') || ',' || p_brand AS genes, p_size / 64.0::DOUBLE AS strictest_pval, CAST(p_size AS BIGINT) AS occurences,
        2 AS n_genes, CAST(len(string_split(p_name, ' ')) + 1 AS INTEGER) AS n_domains FROM part""",
    "module_sizes": "SELECT p_brand, CAST(count(*) AS INTEGER) AS n_genes, CAST(sum(len(string_split(p_name, ' '))) AS INTEGER) AS n_domains FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1",
    "edges_file": "SELECT CAST(s_suppkey AS VARCHAR) AS bgc1, CAST(s_nationkey AS VARCHAR) AS bgc2, s_nationkey / 32.0::DOUBLE AS ai, s_suppkey % 2 = 0 AS contained FROM supplier",
    "dictionary_file": "SELECT CAST(c_nationkey AS VARCHAR) AS key, arg_max(c_mktsegment, c_custkey) || ';' || max(c_custkey) AS values FROM customer GROUP BY c_nationkey",
    "known_groups_file": "SELECT CAST(p_partkey AS VARCHAR) AS bgc, p_brand || ';' || p_type AS info, replace(p_name, ' ', ',') AS genes FROM part",
    "products_file": """SELECT CAST(s_suppkey AS VARCHAR) AS np_id, n_name AS genus, 'sp ' || s_name AS species, s_name || ';' || s_nationkey || ';' || n_regionkey AS info,
        CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS has_mibig FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "taxonomy_file": "SELECT CAST(c_custkey % 100 AS VARCHAR) AS bgc, arg_max(c_mktsegment || ' ' || c_name, c_custkey) AS taxonomy FROM customer GROUP BY 1",
    "hits_file": _HITS + "SELECT cluster_id || '_' || ord AS bgc, '0;9;+' AS location, CAST(orf_num AS INTEGER) AS orf_num, 7 AS tot_orf, domain, q_start, q_end, bitscore FROM hits",
    "colours_file": "SELECT n_name AS name, CAST(n_nationkey AS INTEGER) AS r, 7 AS g, CAST(n_regionkey * 50 AS INTEGER) AS b FROM nation",
    "categories_file": "SELECT 'd' || p_partkey AS domain, p_brand AS category FROM part",
    "representatives_file": "SELECT CAST(s_nationkey AS VARCHAR) AS rep, CAST(s_suppkey AS VARCHAR) AS member FROM supplier",
    "topic_matches_file": "SELECT CAST(s_suppkey AS VARCHAR) AS bgc, CAST(s_nationkey AS VARCHAR) AS topic, s_nationkey / 32.0::DOUBLE AS prob, 0.25::DOUBLE AS overlap, 'g' || s_suppkey || ',h' AS genes, 'kind' AS class FROM supplier WHERE s_nationkey IN (3, 5)",
    "module_blocks_file": "SELECT n_name AS bgc, s_suppkey || ';i' AS info, 'a,g' || s_suppkey AS genes FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "feature_selection": _TERMS + "SELECT * FROM features",
    "topic_table": _TERMS + "SELECT topic, '-' AS number_ldavis, CAST(count_if(selected) AS INTEGER) AS topic_length, string_agg(gene, ',' ORDER BY rank) AS genes FROM features GROUP BY topic",
    "overlap_scores": _MATCH + "SELECT l.bgc_id, l.topic, round(1.0::DOUBLE / (l.topic + 1), 6) AS prob, CAST(count(*) AS INTEGER) AS n_feats, round(coalesce(sum(f.score), 0.0), 6) AS overlap_score FROM links l LEFT JOIN features f ON f.topic = l.topic AND f.gene = l.gene GROUP BY 1, 2",
    "match_filter": _MATCH + "SELECT k.bgc_id, k.topic, string_agg(gene, ',' ORDER BY gene) AS genes, round(f.overlap_score, 6) AS overlap_score FROM kept k JOIN filtered f ON f.bgc_id = k.bgc_id AND f.topic = k.topic GROUP BY k.bgc_id, k.topic, f.overlap_score",
    "class_summary": _MATCH + """SELECT topic, CAST(sum(n) AS BIGINT) AS matches, CAST(sum(n_long) AS BIGINT) AS matches_long,
        coalesce(string_agg(class || ':' || n, ',' ORDER BY n DESC, class), '') AS classes,
        coalesce(string_agg(class || ':' || n_long, ',' ORDER BY n_long DESC, class) FILTER (n_long > 0), '') AS classes_long FROM tc GROUP BY topic""",
    "topic_class_counts": _MATCH + "SELECT topic, class, n, CAST(n_long AS BIGINT) AS n_long FROM tc",
    "topics_per_basket": _MATCH + ", c AS (SELECT bgc_id, count(*) AS k FROM longs WHERE long GROUP BY 1) SELECT coalesce(k, 0) AS n_topics, count(*) AS baskets FROM (SELECT CAST(s_suppkey AS VARCHAR) AS bgc_id FROM supplier) LEFT JOIN c USING (bgc_id) GROUP BY 1",
    "match_lengths": _MATCH + """, s AS (SELECT k.bgc_id, k.topic, CAST(sum(greatest(round_even(p, 0), 1)) AS INTEGER) AS len_match FROM kept k JOIN filtered f ON f.bgc_id = k.bgc_id AND f.topic = k.topic GROUP BY 1, 2),
        l AS (SELECT CAST(l_suppkey AS VARCHAR) AS bgc_id, CAST(count(*) % 7 AS INTEGER) AS len_bgc FROM lineitem GROUP BY 1)
        SELECT len_bgc, len_match, count(*) AS n FROM s JOIN l USING (bgc_id) GROUP BY 1, 2""",
    "known_overlap": _KNOWN + 'SELECT grp AS "group", overlap, CAST(n_overlap AS BIGINT) AS n_overlap, bgc_id, topic FROM known',
    "known_by_threshold": _KNOWN + ", best AS (SELECT grp, max(overlap) AS best FROM known GROUP BY 1) SELECT t AS threshold, (SELECT count(*) FROM best WHERE best >= t) AS found FROM (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS t)",
    "product_link": """
        WITH products AS (
          SELECT CAST(s_suppkey AS VARCHAR) AS np_id, lower(n_name || ' ') AS genus, lower(['BUILDING', 'machinery', 'Household'][s_suppkey % 3 + 1]) AS s1, s_suppkey % 2 = 0 AS two FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        tax AS (SELECT CAST(c_custkey AS VARCHAR) AS bgc, lower(n_name || ' ' || c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN ' T1' ELSE '' END) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT np_id, bgc, CASE WHEN contains(t, s1) AND (NOT two OR contains(t, 't1')) THEN 'exact' WHEN contains(t, s1) THEN 'species' ELSE 'genus' END AS level FROM products JOIN tax ON contains(t, genus)""",
    "hit_geometry": _HITS + """SELECT cluster_id || '_' || orf_num AS gene_key, domain,
        CAST(trunc((CASE WHEN ord % 2 = 0 THEN 3 * q_start ELSE 990 - 3 * q_start - 3 * (q_end - q_start) END) / 30.0) AS INTEGER) AS start,
        CAST(trunc(3 * (q_end - q_start) / 30.0) AS INTEGER) AS width, 24 AS height FROM hits""",
    "header_carry_forward": """WITH lines AS (SELECT event_id AS ord, event_type || ' ' || user_id AS line FROM events)
        SELECT ord, line, last_value(CASE WHEN starts_with(line, 'signup') THEN line END IGNORE NULLS) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM lines""",
    "gene_counts_window": "SELECT date_trunc('hour', ts) AS start, event_type AS gene, count(*) AS n FROM events GROUP BY 1, 2",
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
}
ORACLES["interaction_edges"] = (
    _COP.rstrip() + _NEAR[len(ORDERS):].rstrip() + _ADP[len(_NEAR):].rstrip().replace("par AS", "par2 AS").replace("FROM par)", "FROM par2)")
    + _by("co_p", "byc") + _by("ad_p", "bya")
    + f"SELECT g1, g2, round(min(pval), 6) AS pval FROM (SELECT * FROM ({_max2('byc', 'adj')}) UNION ALL SELECT * FROM ({_max2('bya', 'adj')})) GROUP BY 1, 2"
)

# All cliques of a graph e (g1 < g2, pval), grown gene by gene, and those that are maximal at their weakest edge.
_CLIQUES = """,
s AS (SELECT g1 AS a, g2 AS b, pval FROM e UNION ALL SELECT g2, g1, pval FROM e),
c AS (
  SELECT [g1, g2] AS l, pval AS w FROM e
  UNION ALL
  SELECT list_append(l, b), max(greatest(w, pval)) FROM c JOIN s ON list_contains(l, s.a) AND s.b > l[-1] GROUP BY l, w, b HAVING count(*) = len(l)),
grown AS (SELECT DISTINCT l, w, b FROM c JOIN s ON list_contains(l, s.a) AND s.pval <= w AND NOT list_contains(l, s.b) WHERE len(l) >= 3 GROUP BY l, w, b HAVING count(*) = len(l)),
found AS (SELECT l, w FROM c WHERE len(l) >= 3 AND NOT EXISTS (SELECT 1 FROM grown WHERE grown.l = c.l))
"""
ORACLES["modules_maximal"] = _WEAK.replace("WITH genes", "WITH RECURSIVE genes").rstrip() + _CLIQUES + "SELECT array_to_string(l, ',') AS genes, round(w, 6) AS strictest_pval FROM found"

_WORDS = r"""
WITH RECURSIVE texts AS (SELECT CAST(doc_id AS VARCHAR) AS bgc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
said AS (SELECT bgc_id, unnest(ws) AS gene, unnest(range(len(ws))) AS i FROM texts),
firsts AS (SELECT bgc_id, gene, min(i) AS i FROM said WHERE regexp_matches(gene, '^[dlu][a-z]{2}$') GROUP BY 1, 2),
often AS (SELECT gene FROM firsts GROUP BY gene HAVING count(*) >= 3),
masked AS (
  SELECT bgc_id, CAST(row_number() OVER (PARTITION BY bgc_id ORDER BY i) - 1 AS INTEGER) AS pos, CASE WHEN often.gene IS NULL THEN '-' ELSE firsts.gene END AS gene
  FROM firsts LEFT JOIN often USING (gene)),
genes AS (SELECT * FROM masked WHERE bgc_id IN (SELECT bgc_id FROM masked WHERE gene <> '-' GROUP BY 1 HAVING count(*) >= 2)),
baskets AS (SELECT bgc_id, list(gene ORDER BY pos) AS genes FROM genes GROUP BY bgc_id)
"""
# No word stands twice in a basket, so none lies between two of the same: adjacency has the tail of one kind of neighbour.
ORACLES["built_modules"] = (
    _WORDS.rstrip() + _COP[len(ORDERS):].rstrip() + _NEAR[len(ORDERS):].rstrip()
    + _COP[len(_COLOC):].rstrip().replace("par AS", "par2 AS").replace("FROM par)", "FROM par2)").replace("co_p AS", "ad_p AS").replace("co_pair", "adj_pair").replace("co_node", "adj_node").replace("(SELECT sum(len2) AS n FROM lens)", "(SELECT count(*) AS n FROM genes)")
    + _by("co_p", "byc") + _by("ad_p", "bya").rstrip()
    + f""",
e AS (SELECT g1, g2, min(pval) AS pval FROM (SELECT * FROM ({_max2('byc', 'adj')}) UNION ALL SELECT * FROM ({_max2('bya', 'adj')})) GROUP BY 1, 2 HAVING min(pval) <= 0.01)"""
    + _CLIQUES.rstrip()
    + """,
sets AS (SELECT bgc_id, list(gene) AS g FROM u GROUP BY 1)
SELECT row_number() OVER (ORDER BY w, array_to_string(l, ',')) AS module_id, array_to_string(l, ',') AS genes, round(w, 6) AS strictest_pval,
       (SELECT count(*) FROM sets WHERE list_has_all(g, l)) AS occurences, CAST(len(l) AS INTEGER) AS n_genes, CAST(len(l) AS INTEGER) AS n_domains
FROM found"""
)

ORACLES["unreadable_tables"] = (
    "SELECT cluster_id, count(*) AS hits FROM (" + ORACLES["domain_hits"] + ") WHERE CAST(cluster_id AS BIGINT) % 50 NOT IN (7, 8) GROUP BY 1"
)
ORACLES["genbank_records"] = """
WITH l AS (
  SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate, replace(p_name, ' ', '_')) AS n,
         count(*) OVER (PARTITION BY l_suppkey) AS total, l_partkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS q, replace(p_name, ' ', '-') AS gene
  FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (
  SELECT DISTINCT s, 's' || s || CASE WHEN s % 9 = 0 THEN '_final' ELSE '' END AS bgc,
         CASE WHEN s % 9 = 0 THEN 'excluded' WHEN s % 11 = 3 THEN 'failed' WHEN s % 7 = 0 THEN 'filtered' ELSE 'converted' END AS status FROM l)
SELECT bgc, status, CAST(n AS INTEGER) AS n,
       '>' || bgc || '_gid:' || gene || '_pid:P-' || l_partkey || '_loc:' || (l_partkey - 1) || ';' || (l_partkey + 3 * q) || ';' || CASE WHEN l_linenumber % 2 = 1 THEN '-' ELSE '+' END || '_' || n || '/' || total AS header, 'MK' AS sequence
FROM f JOIN l USING (s) WHERE status = 'converted'
UNION ALL SELECT bgc, status, 0, '', '' FROM f WHERE status <> 'converted'
"""
ORACLES["drawn_modules"] = """
SELECT replace(p_brand, '#', '_') AS bgc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3, p_size, p_partkey) AS INTEGER) AS place,
       CAST(p_partkey AS VARCHAR) AS module, replace(p_name, ' ', ',') AS genes
FROM part WHERE p_size BETWEEN 5 AND 29
"""
_BRANDS = """
WITH n AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS brand, replace(p_name, ' ', ';') AS gene, count(*) AS n FROM part GROUP BY 1, 2),
t AS (SELECT CAST(dense_rank() OVER (ORDER BY brand) - 1 AS INTEGER) AS topic, gene, n, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY brand) AS prob FROM n)
"""
ORACLES["term_topics"] = _BRANDS + "SELECT gene, topic, round(prob, 6) AS prob FROM t WHERE prob >= 0.001"
ORACLES["top_terms"] = _BRANDS.rstrip() + """,
every AS (SELECT topic, gene, coalesce(t.prob, 0) AS prob FROM (SELECT DISTINCT topic FROM t) CROSS JOIN (SELECT DISTINCT gene FROM t) LEFT JOIN t USING (topic, gene)),
r AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY prob DESC, gene) - 1 AS INTEGER) AS rank, gene FROM every)
SELECT * FROM r WHERE rank < 10"""
ORACLES["topic_vocabulary"] = ORDERS.rstrip() + """,
v AS (SELECT gene, count(DISTINCT bgc_id) AS n FROM genes GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n DESC, gene) - 1 AS INTEGER) AS place, gene FROM v WHERE n >= 5 AND n <= 0.07 * (SELECT count(*) FROM baskets)"""
