import os

import pytest

from lexiweft.plans import registry

SF = "/root/testdata/sf0.001"
WHOLE = ["dependents_depth", "dead_symbols", "blast_radius", "callers"]


@pytest.mark.parametrize("name", WHOLE)
def test_sql_keeps_all_edges(name):
    assert "% 20" not in registry.ORACLES[name] and "% 3 " not in registry.ORACLES[name]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", WHOLE)
def test_whole_graph_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_whole_graph_equals_a_walk(spark):
    from lexiweft.plans import bindings as B

    back: dict = {}
    for r in B.imports(spark, SF).collect():
        back.setdefault(r.resolved_file, set()).add(r.source_file)
    seen, frontier = {}, back.get(1, set())
    for depth in range(4):
        seen |= dict.fromkeys(frontier, depth)
        frontier = {a for b in frontier for a in back.get(b, ())} - seen.keys()
    got = {r.file: r.depth for r in registry.QUERIES["dependents_depth"](spark, SF).collect()}
    assert got == seen and len(got) > 0
    parts = {r.p_partkey for r in B.read(spark, SF, "part").collect()}
    dead = {r.id for r in registry.QUERIES["dead_symbols"](spark, SF).collect() if r.classification == "dead"}
    assert dead <= parts and dead.isdisjoint(back)
