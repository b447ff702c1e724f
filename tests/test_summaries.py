import os

import pytest

from lexiweft.plans import registry

SF = "/root/testdata/sf0.01"


def test_summaries_read_the_whole_text(spark, tmp_path):
    texts = ["A sentence that wraps\nover two lines. And more.", "\n\nAfter empty lines. More", "No end here\n@tag x. y", "One\n\nTwo. Three", None]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.summary for r in registry.QUERIES["summaries"](spark, str(tmp_path)).collect()}
    assert got == {"s/en/0": "A sentence that wraps over two lines.", "s/en/1": "After empty lines.", "s/en/2": "No end here", "s/en/3": "One"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_summaries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted((r.path, r.summary) for r in registry.QUERIES["summaries"](spark, SF).collect())
    assert got == sorted(db.execute(registry.ORACLES["summaries"]).fetchall())
