import re

import pytest
from pyspark.sql import functions as F

from lexiweft.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_ids(spark):
    a, b, c = F.lit("plant/valve.py"), F.lit("Valve.open"), F.lit("method")
    assert one(spark, T.make_id(a, b, c, F.lit(0))) == "plant/valve.py::Valve.open#method"
    assert one(spark, T.make_id(a, b, c, F.lit(3))) == "plant/valve.py::Valve.open#method~3"


@pytest.mark.parametrize("doc, want", [
    ("Opens the valve. Closing is left to the caller.", "Opens the valve."), ("Waits until the tank\nis full. Then stops.", "Waits until the tank is full."),
    ("Reads a gauge.\n@returns bar", "Reads a gauge."), ("Pumps\n\nSlowly. Always.", "Pumps"),
    ("Needs 1.5 bar at least.", "Needs 1.5 bar at least."), ("", ""), (" \t ", ""), ("@see tank", ""), ("\n \n", ""),
    ("a" * 120, "a" * 120), ("a" * 121, "a" * 117 + "..."),
])
def test_summaries(spark, doc, want):
    assert one(spark, T.summarize(F.lit(doc))) == want


def test_keywords(spark):
    assert one(spark, T.keywords(F.lit("PumpRoom.openPumpValve_2nd"))) == ["pump", "room", "open", "valve", "2nd"]
    assert one(spark, T.keywords(F.lit("Q.z"))) == []


def test_languages_and_kinds(spark):
    for path, want in {"a/b.py": "python", "x.h": "cpp", "v.blade.php": "blade", "openapi.yaml": "openapi", "Makefile": "unknown", "a.QQ": "qq"}.items():
        assert one(spark, T.detect_language(F.lit(path))) == want
    assert [one(spark, T.normalize_kind(F.lit(k))) for k in ("struct", "member", "Field", "function", "odd")] == ["class", "method", "property", "function", "variable"]


def test_globs():
    hit = lambda g, p, **o: re.match(T.glob_to_regex(g, **o), p) is not None
    assert not hit("*.c", "src/foo.c") and hit("*.c", "src/foo.c", pathname=False)
    assert hit("**/*.c", "bar.c") and hit("**/*.c", "src/foo/bar.c")
    assert hit("[!a]*.c", "b.c") and not hit("[!a]*.c", "a.c")
    assert hit("\\*.c", "*.c") and not hit("\\*.c", "foo.c")


def test_regex_guard():
    assert T.check_regex("(a+)+") and T.check_regex("(a+)*") and T.check_regex("") and T.check_regex("a" * 201)
    assert T.check_regex("foo|bar") is None and T.check_regex("a{1,3}") is None


def test_end_lines_and_docs():
    lines = ["/** Adds.", " * Two. */", "@dec", "int f(int a) {", "  char c = '}'; // }", "  if (a) { return 1; }", "}", "x"]
    text = "\n".join(lines)
    assert T.block_end(text, 4, "function") == 7 and T.block_end(text, 4, "constant") == 4
    assert T.block_end("int f(int a, char *b = \"{\");\nint g;", 1, "function") == 1 and T.block_end("def f():\n  pass\n", 1, "function") == 3
    assert T.block_end("f() { /* }\n} */ `}`\n # }\n}\n", 1, "function") == 4
    assert T.docstring_above(lines, 4) == "Adds.\nTwo."
    assert T.docstring_above(["// a", "// b", "f()"], 3) == "a\nb"
