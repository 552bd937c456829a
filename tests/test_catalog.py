"""Every query of the catalog that has SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from netloom.plans import catalog, formats, oracles

QUERIES, ORACLES = catalog.QUERIES | formats.QUERIES, oracles.ORACLES | formats.ORACLES

DATA = os.environ.get("NETLOOM_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


def test_oracles_have_queries():
    assert not ORACLES.keys() - QUERIES.keys()


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        assert sorted(df.columns) == sorted(c[0] for c in want.description)
        assert got == rows([c[0] for c in want.description], want.fetchall())


def test_searches_cover_the_lattice(spark, tmp_path):
    """Searches of the visibility graph go beyond its tenth row."""
    cells = [(50 * y + x, 5 if (x + 3 * y) % 7 == 0 else 20, 1.0) for y in range(13) for x in range(4)]
    spark.createDataFrame(cells, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 3, 1.0), (2, 8, 1.0), (3, 20, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    filled = sorted(ref for ref, size, _ in cells if size > 10)
    for name in ("metric_global", "angular_global", "metric_depth", "angular_depth", "metric_depth_link_cost"):
        assert sorted(r.ref for r in QUERIES[name](spark, str(tmp_path)).collect()) == filled, name
    for name in ("metric_shortest_path", "angular_shortest_path"):
        assert {r.target for r in QUERIES[name](spark, str(tmp_path)).collect()} == {filled[-1]}, name
    for name in ("metric_global_distances", "metric_depth_lengths", "metric_depth_link_lengths", "visual_shortest_path"):
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLES[name])
        assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall()), name
