"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from tidewatch.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: repr(round(float(x), 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got or df.columns
        return
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


def test_components_link_all_lines(spark, tmp_path):
    """Labels against union-find over every line, of which few have a large quantity."""
    lines = [(p, s, q) for p, s, q in ((1, 5, 1.0), (1, 9, 2.0), (2, 9, 50.0), (2, 7, 3.0), (3, 4, 48.0), (3, 8, 49.0), (4, 6, 10.0), (5, 5, 50.0), (6, 3, 49.0), (6, 2, 1.0))]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    parent = {s: s for _, s, _ in lines}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for p, s, _ in lines:
        for q, t, _ in lines:
            if p == q and find(s) != find(t):
                parent[max(find(s), find(t))] = min(find(s), find(t))
    got = {r.vertex: r.component for r in registry.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == {s: find(s) for s in parent}
