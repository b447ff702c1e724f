import pytest
from pyspark.sql import functions as F

from lexiweft.operators import formats, incremental, ingest, inspect, search, stats, textsearch

SYM = "id string, name string, qualified_name string, signature string, summary string, docstring string, keywords array<string>, file string, line long, kind string, language string, byte_length long"


def symbols(spark, *rows):
    return spark.createDataFrame([(f"i{k}", n, q, s, d, "", [], f"f{k}.py", k, "function", "python", 100) for k, (n, q, s, d) in enumerate(rows)], SYM)


@pytest.mark.parametrize("row, query, want", [
    (("AuthService", "AuthService", "", ""), "authservice", 20), (("handleLogin", "handleLogin", "", ""), "login", 10), (("login", "Auth.login", "", ""), "auth.login", 25),
    (("x", "x", "", "Handles user authentication"), "authentication", 5),
])
def test_scores(spark, row, query, want):
    found = search.search_symbols(symbols(spark, row), query, cap=None).collect()
    assert [r.score for r in found] == [want]


def test_no_score(spark):
    assert search.search_symbols(symbols(spark, ("calculator", "calculator", "", "")), "auth").count() == 0
    with pytest.raises(ValueError):
        search.query_words("a" * 501)


def test_budget_keeps_the_first(spark):
    s = symbols(spark, ("aa", "aa", "", ""), ("aa", "aa", "", ""))
    found = search.search_symbols(s, "aa")
    assert search.refine(found, token_budget=1).count() == 1 and search.refine(found, token_budget=50).count() == 2


def test_text(spark):
    body = "one\nauthentication A\nthree\nDatabase\nfive\nauthentication database\nseven\nAuthentication\nnine"
    files = spark.createDataFrame([("t.txt", body), ("e.txt", "")], "path string, content string")
    lines = textsearch.lines_of(files)
    assert [r.line for r in textsearch.text_search(lines, "authentication").collect()] == [2, 6, 8]
    assert [r.line for r in textsearch.text_search(lines, "database", case_sensitive=True).collect()] == [6]
    assert [r.line for r in textsearch.text_search(lines, "auth[a-z]+ d", regex=True).collect()] == [6]
    hit = textsearch.with_context(textsearch.text_search(lines, "Database", case_sensitive=True), lines, 2).first()
    assert hit.before == ["authentication A", "three"] and hit.after == ["five", "authentication database"]
    assert [(r.line, r.text) for r in textsearch.file_slice(lines, "t.txt", 8, 99).collect()] == [(8, "Authentication"), (9, "nine")]
    with pytest.raises(ValueError):
        textsearch.text_search(lines, "(a+)+", regex=True)


def test_changes_equal_a_rebuild(spark):
    schema = "path string, size long, mtime long, hash string"
    stored = spark.createDataFrame([("a", 1, 1, "h"), ("gone", 1, 1, "h"), ("mod", 1, 1, "h"), ("touched", 1, 1, "h")], schema)
    disk = spark.createDataFrame([("a", 1, 1, None), ("b", 1, 1, "n"), ("mod", 2, 2, "x"), ("touched", 1, 5, "h")], schema)
    changes = incremental.detect_changes(stored, disk)
    assert {tuple(r) for r in changes.collect()} == {("a", "unchanged"), ("b", "added"), ("gone", "deleted"), ("mod", "changed"), ("touched", "metadata_changed")}
    table = stored.select(F.col("path").alias("file"), "hash")
    fresh = disk.select(F.col("path").alias("file"), "hash")
    assert {r.file for r in incremental.apply_changes(table, fresh, changes).collect()} == {r.path for r in disk.collect()}
    assert incremental.plan_update(changes).first().mode == "rebuild"
    assert {r.path: r.mtime for r in incremental.update_times(stored, disk, changes).collect()}["touched"] == 5


def test_savings(spark):
    calls = spark.createDataFrame([("t", 10000, 2000), ("t", 100, 200), ("u", 500, 500), ("u", 0, 100)], "tool string, raw_bytes long, response_bytes long")
    assert [tuple(r) for r in stats.savings_by_tool(calls).collect()] == [("t", 1, 2000)]


def test_ingest(spark):
    tags = spark.createDataFrame([("f", "A", "A", "struct", "C++", "", "Holds. More.", 1, 9, 0), ("f", "go", "A.go", "function", "C++", "", "", 2, 3, 1), ("f", "go", "go", "function", "C++", "", "", 2, 3, 2), ("f", "go", "A.go", "function", "C++", "", "", 5, 6, 3)], "file string, name string, qualified_name string, kind string, language string, signature string, docstring string, line int, end_line int, seq int")
    rows = {r.id: r for r in ingest.build_symbols(tags).collect()}
    assert {"f::A#class", "f::A.go#method", "f::A.go#method~1"} <= set(rows)
    assert rows["f::A#class"].summary == "Holds." and rows["f::A.go#method"].summary == "Method go"


def test_sources_and_tables(spark):
    s = spark.createDataFrame([("i", "f", "n", 2, 2, 4, 5)], "id string, file string, name string, line int, end_line int, byte_offset int, byte_length int")
    c = spark.createDataFrame([("f", bytearray("né\nbody\nx".encode()))], "file string, content binary")
    assert inspect.sources(s, c).first().source == "body\n" and inspect.source_lines(s, c, 1).first().source == "né\nbody\nx"
    assert formats.as_table(s.limit(0)) == "(no results)" and formats.as_table(s.select("id", "name")).split("\n")[0] == "ID  NAME"
