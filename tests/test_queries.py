"""Every query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from basketloom.plans.oracles import ORACLES
from basketloom.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple(round(float(x), 6) + 0.0 if isinstance(x, float) else str(x) for x in row))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_modules_of_any_size(spark, monkeypatch):
    """A module of four genes is counted, filtered, numbered and detected like one of three."""
    from itertools import combinations

    from basketloom.plans import queries

    edges = [(a, b, 0.01) for a, b in combinations("abcd", 2)] + [("c", "e", 0.05), ("d", "e", 0.05)]
    baskets = [("1", "abcd"), ("2", "dxcba"), ("3", "abc"), ("4", "cde"), ("5", "abcde"), ("6", "ce")]
    monkeypatch.setattr(queries, "_weak_edges", lambda *_: spark.createDataFrame(edges, "g1 string, g2 string, pval double"))
    monkeypatch.setattr(queries, "order_baskets", lambda *_: spark.createDataFrame([(i, list(g)) for i, g in baskets], "bgc_id string, genes array<string>"))
    wanted = ["abcd", "cde"]  # by p-value
    held = {m: [i for i, g in baskets if set(m) <= set(g)] for m in wanted}
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, "").collect()]
    assert sorted(run("module_occurrences")) == [(",".join(m), len(held[m])) for m in wanted]
    assert sorted(run("filtered_modules")) == [(k + 1, ",".join(m), p, len(held[m])) for k, (m, p) in enumerate(zip(wanted, (0.01, 0.05)))]
    assert sorted(run("detected_modules")) == sorted((i, ",".join(m)) for m in wanted for i in held[m])
    assert sorted(run("detected_module_ids")) == [("1", "1"), ("2", "1"), ("3", ""), ("4", "2"), ("5", "1,2"), ("6", "")]


def test_every_query_has_a_name():
    assert set(ORACLES) <= set(QUERIES)
