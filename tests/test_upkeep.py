"""Scopes, workspaces, codebase detection, single-file indexing, hints and detail levels."""

from pyspark.sql import functions as F

from lexiweft.functions import text as T
from lexiweft.operators import formats, hints, incremental, search
from lexiweft.sources import files, scopes

JAVA = """package a;
/** Keeps things. Forever. */
public class Box {
  // a lid }
  class Lid {
    int x;
  }
  String s = "}";
}
class Other { }"""
RUBY = "module Shop\n  # Sells it.\n  class Till\n    def ring!\n      1\n    end\n  end\nend\ndef free\nend"
PYTHON = "# Top.\nclass A:\n    LIMIT = 3\n    class B:\n        def f(\n            self,\n        ):\n            return 1\n\n    def g(self): pass\n\n\ndef h():\n    '''Says h.'''\n"


def tags(text, language):
    found = {"java": [(3, "Box", "class"), (5, "Lid", "class"), (10, "Other", "class")], "ruby": [(1, "Shop", "namespace"), (3, "Till", "class"), (4, "ring!", "method"), (9, "free", "method")], "python": [(2, "A", "class"), (3, "LIMIT", "constant"), (4, "B", "class"), (5, "f", "function"), (10, "g", "function"), (13, "h", "function")]}[language]
    rows = [{"line": n, "name": s, "kind": k, "signature": ""} for n, s, k in found]
    return {t["qualified_name"]: (t["line"], t["end_line"], t["docstring"]) for t in scopes.scoped(text, language, rows)}


def test_scopes():
    assert tags(JAVA, "java") == {"Box": (3, 9, "Keeps things. Forever."), "Box.Lid": (5, 7, "a lid }"), "Other": (10, 10, "")}
    assert tags(RUBY, "ruby") == {"Shop": (1, 8, ""), "Shop.Till": (3, 7, "Sells it."), "Shop.Till.ring!": (4, 6, ""), "free": (9, 10, "")}
    assert tags(PYTHON, "python") == {"A": (2, 10, "Top."), "A.LIMIT": (3, 3, ""), "A.B": (4, 8, ""), "A.B.f": (5, 8, ""), "A.g": (10, 10, ""), "h": (13, 14, "Says h.")}
    assert scopes.scoped("", "python", []) == []


def test_symbols_of_nothing(spark):
    lines = spark.createDataFrame([], "path string, language string, line long, text string")
    assert scopes.symbols_of(lines, spark.createDataFrame([], "file string, content binary")).count() == 0


def test_hash_marks():
    assert T.docstring_above(["#include <a.h>", "int f();"], 2, hashes=False) == "" and T.docstring_above(["# A note.", "f()"], 2) == "A note."


def test_workspaces(spark):
    texts = {
        "package.json": '{"name": "x", "workspaces": {"nohoist": [], "packages": ["packages/*", "./tools/cli/", "!packages/old"]}}',
        "Cargo.toml": '[package]\nname = "x"\n[workspace]\nresolver = "2"\nmembers = [\n  "engine",\n  \'plug-ins/*\',\n]\n[dependencies]\nmembers = ["no"]\n',
        "go.work": "go 1.22\nuse ./single\nuse (\n\t./alpha\n\t// ./gone\n\t./beta/x\n)\n",
        "pom.xml": "<project><modules>\n<module> core </module><module>web</module></modules><module>no</module></project>",
        "settings.gradle.kts": 'rootProject.name = "no"\ninclude(":app", ":lib:deep")\ninclude \'plain\'\n',
        "sub/package.json": '{"workspaces": ["no"]}',
    }
    tree = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary")
    got = {}
    for r in files.workspaces(tree).collect():
        got.setdefault(r.manifest, set()).add(r.folder)
    assert got == {"package.json": {"packages/*", "tools/cli"}, "Cargo.toml": {"engine", "plug-ins/*"}, "go.work": {"single", "alpha", "beta/x"}, "pom.xml": {"core", "web"}, "settings.gradle.kts": {"app", "lib/deep", "plain"}}
    more = spark.createDataFrame([(p, bytearray()) for p in ("web/pom.xml", "theirs/package.json", "engine/Cargo.toml")], "path string, content binary")
    assert {r.folder for r in files.third_party(tree.unionByName(more)).collect()} == {"sub", "theirs"}


def test_codebases(spark):
    rows = {
        "root": ["Makefile", "x/go.mod"], "below": ["a/b/go.mod", "a/b/c/pom.xml", "vendor/package.json", ".hid/Gemfile"], "deep": ["a/b/c/go.mod"], "dotted": ["a/.x.sln", "One.csproj"],
        "source": [".git/HEAD", *(f"s{i}.py" for i in range(5))], "few": [".git/HEAD", *(f"s{i}.py" for i in range(4)), "build/t.py", "A.PY"], "bare": [f"s{i}.py" for i in range(9)],
    }
    listing = spark.createDataFrame([(p, f) for p, own in rows.items() for f in own], "project string, path string")
    got = {r.project: (r.detection, r.ecosystems, r.action) for r in files.detect_codebases(listing, spark.createDataFrame([("root",)], "project string")).collect()}
    none = ("none", [], "skip")
    assert got == {"root": ("manifest-root", ["c/cpp"], "ready"), "below": ("manifest-subdir", ["go"], "index:create"), "deep": none, "dotted": ("manifest-root", ["dotnet"], "index:create"), "source": ("heuristic", [], "index:create"), "few": none, "bare": none}
    assert files.detect_codebases(listing.limit(0), listing.limit(0).select("project")).count() == 0


def test_one_file_is_indexed_again(spark):
    f = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "path string, hash string")
    s = spark.createDataFrame([("a.py", "old"), ("b.py", "kept")], "file string, name string")
    schema = "import_id long, source_file string, target_name string, import_type string, language string, resolved_file string"
    i = spark.createDataFrame([(1, "b.py", "a", "import", "", "a.py"), (2, "a.py", "b", "import", "", "b.py"), (3, "b.py", "c", "import", "", "")], schema)
    same = incremental.reindex_file(f, s, i, f.where("path = 'a.py'"), s.limit(0), i.limit(0))
    assert same[0] is False and same[3].count() == 3
    one = spark.createDataFrame([("a.py", "9")], "path string, hash string")
    fresh = spark.createDataFrame([("a.py", "new")], "file string, name string")
    changed, f2, s2, i2 = incremental.reindex_file(f, s, i, one, fresh, i.limit(0))
    assert changed and {tuple(r) for r in f2.collect()} == {("a.py", "9"), ("b.py", "2")} and {r.name for r in s2.collect()} == {"new", "kept"}
    assert {(r.import_id, r.resolved_file) for r in i2.collect()} == {(1, "a.py"), (3, "")}
    # A new file takes what led nowhere.
    _, _, _, i3 = incremental.reindex_file(f, s, i, spark.createDataFrame([("c.py", "3")], "path string, hash string"), s.limit(0), i.limit(0))
    assert {(r.import_id, r.resolved_file) for r in i3.collect()} == {(1, "a.py"), (2, "b.py"), (3, "c.py")}


def test_heads_and_summaries(spark):
    meta = spark.createDataFrame([("p", "x"), ("q", "y"), ("r", None), ("s", "z")], "project string, git_head string")
    heads = spark.createDataFrame([("p", "x"), ("q", "other"), ("r", "w")], "project string, head string")
    assert {tuple(r) for r in incremental.stale_heads(meta, heads).collect()} == {("p", False), ("q", True), ("r", False), ("s", False)}
    f = spark.createDataFrame([("a", "1 class"), ("b", "")], "path string, summary string")
    assert {tuple(r) for r in incremental.update_summaries(f, spark.createDataFrame([("b", "2 methods")], "path string, summary string")).collect()} == {("a", "1 class"), ("b", "2 methods")}


def test_hints(spark):
    schema = "tool string, n int, id string, file string, action string, changed int, error string, stale boolean"
    rows = [("inspect_bundle", 1, "i", "f", None, None, None, False), ("search_text", 0, None, None, None, None, None, True), ("codebase_detect", None, None, None, "ready", None, None, None), ("index_update", 0, None, None, None, 0, None, False), ("stats", None, None, None, None, None, "no_index", True)]
    got = {r.tool: r.next for r in hints.next_steps(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"inspect_bundle": ["find_callers i", "find_importers f"], "search_text": [hints.STALE], "codebase_detect": ["search_symbols or inspect_tree to explore"], "index_update": [], "stats": [hints.NO_INDEX]}


def test_detail(spark):
    s = spark.createDataFrame([(1, "n", "n", "class", "f.C", 1, 1, 0, 2, "Class n", "", 3.0, 2), (2, "m", "n.m", "method", "f.C", 2, 2, 3, 2, "Does.", "m()", 2.0, 2)], "id int, name string, qualified_name string, kind string, file string, line int, end_line int, byte_offset int, byte_length int, summary string, signature string, score double, x int")
    assert search.detail(s, "compact").columns == search.DETAIL["compact"]
    assert [(r.qualified_name, r.summary) for r in search.detail(s).orderBy("id").collect()] == [(None, None), ("n.m", "Does.")]
    c = spark.createDataFrame([("f.C", bytearray(b"n1\nm1"))], "file string, content binary")
    assert [r.source for r in search.detail(s, "full", c).orderBy("id").collect()] == ["n1", "m1"]


def test_bonus_minds_the_case(spark):
    names = ["a.c", "a.C", "a.h", "a.py", "py", "a.b/c"]
    got = spark.createDataFrame([(n,) for n in names], "file string").select(search.bonus(F.col("file")).alias("b")).collect()
    assert [r.b for r in got] == [2.0, 0.0, 0.5, 1.0, 0.0, 0.0]


def test_regex_guard_reads_classes_and_escapes():
    for fine in ("([+])*", r"(a\+)*", "(a|b)*", "(a)(b+)", "[(+]", "(x(y+)z)*", "a+b*c{2,3}"):
        assert T.check_regex(fine) is None, fine
    for bad in ("(a+)+", "(?:a+){2,}", "((a)b*)+", "([a]+)*"):
        assert T.check_regex(bad) == "nested quantifier", bad


def test_tables_say_that_they_are_cut(spark):
    assert formats.as_table(spark.range(3), most_rows=2).endswith("\n...") and not formats.as_table(spark.range(2), most_rows=2).endswith("...")
