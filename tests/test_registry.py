import os

import pytest

from lexiweft.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["search_symbols_token_budget", "text_search_context", "dependents_depth", "path_tree", "change_detection", "file_summaries", "resolve_imports", "extract_symbols", "symbol_source", "detect_codebases", "delete_cascade"]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].values.tolist()))
    assert rows(got) == rows(want)
