import random

import pytest
from pyspark.sql import functions as F

from lexiweft.operators import graph, resolve

FOLDERS, PER_FOLDER = ["ingest", "model", "report"], 6
FILES = [f"{folder}/step{k}.py" for folder in FOLDERS for k in range(PER_FOLDER)]


def random_edges(seed: int, n: int) -> list[tuple[str, str, str]]:
    rng = random.Random(seed)
    return sorted({(rng.choice(FILES), rng.choice(FILES), f"name{rng.randrange(5)}") for _ in range(n)})


def edges(spark, rows):
    return spark.createDataFrame([(a, b, n, n, 1) for a, b, n in rows], "source_file string, resolved_file string, imported_name string, target_name string, line long")


def reached(rows, start: str, most: int = 99) -> dict[str, int]:
    """Files that import start, over any number of others, with how many lie between."""
    depth, now = {}, {start}
    for d in range(most):
        now = {a for a, b, _ in rows if b in now} - set(depth)
        depth |= dict.fromkeys(now, d)
    return depth


@pytest.mark.parametrize("seed,n", [(1, 14), (2, 22), (3, 34)])
def test_cycles_equal_mutual_reach(spark, seed, n):
    rows = random_edges(seed, n)
    before = {f: reached(rows, f) for f in FILES}
    groups = {tuple(sorted({f} | {g for g in before[f] if f in before[g]})) for f in FILES if f in before[f]}
    got = {tuple(r.files): (r.cycle, r.length, r.cross_dir) for r in graph.cycles(edges(spark, rows)).collect()}
    assert got == {g: (g[0], len(g), len({f.split("/")[0] for f in g}) > 1) for g in groups}


def test_both_ways_to_strong_components_agree(spark):
    rng = random.Random(7)
    pairs = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(45)], "a long, b long")
    assert {tuple(r) for r in graph.strong_components(pairs).collect()} == {tuple(r) for r in graph.strong_components(pairs, most_edges=0).collect()}


def test_dependents_equal_a_walk(spark):
    rows = random_edges(4, 26)
    start = max(FILES, key=lambda f: len(reached(rows, f)))
    want = {f: d for f, d in reached(rows, start, 4).items()}
    got = {r.file: r.depth for r in graph.dependents(edges(spark, rows), start).collect()}
    assert len(want) > 5 and {f: d for f, d in got.items() if f != start} == {f: d for f, d in want.items() if f != start}


def test_dead_symbols(spark):
    rows = random_edges(5, 12)
    symbols = [(f, f"name{k}") for f in FILES for k in range(5)] + [(FILES[0], "execute"), (FILES[1], "test_that")]
    s = spark.createDataFrame([(f, n, "function", "python", i, f"{f}::{n}") for i, (f, n) in enumerate(symbols)], "file string, name string, kind string, language string, line int, id string")
    imported, named = {b for _, b, _ in rows}, {(b, n) for _, b, n in rows}
    want = {(f, n): "unreferenced" if f in imported else "dead" for f, n in symbols if n.startswith("name") and (f, n) not in named}
    got = {(r.file, r.name): r.classification for r in graph.dead_symbols(s, edges(spark, rows), limit=None).withColumn("file", F.substring_index("id", "::", 1)).withColumn("name", F.substring_index("id", "::", -1)).collect()}
    assert got == want and len(set(got.values())) == 2


# files | source | specifier | type | expected
CASES = [
    # a path as it stands; system headers and unknown packages lead nowhere; no file is found by its own name
    ("core/loop.c core/clock.h", "core/loop.c", "core/clock.h", "include", "core/clock.h"), ("core/loop.c sys/time.h", "core/loop.c", "time.h", "system_include", ""),
    ("jobs/nightly.py", "jobs/nightly.py", "numpy.linalg", "import", ""), ("jobs/nightly.py", "jobs/nightly.py", "nightly", "import", ""), ("web/kernel.php", "web/kernel.php", "Acme\\Mailer\\Queue", "use", ""),
    # relative paths, with and without an extension, up, and to a folder's index
    ("ui/shell.ts ui/palette.ts", "ui/shell.ts", "./palette", "import", "ui/palette.ts"), ("ui/deep/tile.ts ui/palette.ts", "ui/deep/tile.ts", "../palette", "import", "ui/palette.ts"),
    ("ui/shell.ts ui/icons/index.tsx", "ui/shell.ts", "./icons", "import", "ui/icons/index.tsx"), ("ui/shell.js ui/theme.scss", "ui/shell.js", "./theme.scss", "import", "ui/theme.scss"),
    ("bin/start.rb bin/banner.rb", "bin/start.rb", "./banner", "require_relative", "bin/banner.rb"), ("views/top.ts model/row.shape.ts", "views/top.ts", "../model/row.shape", "import", "model/row.shape.ts"),
    # dotted and back-slashed names by their last parts
    ("web/kernel.php Mail/Queue.php", "web/kernel.php", "Acme\\Mail\\Queue", "use", "Mail/Queue.php"), ("jobs/nightly.py jobs/lib/ledger.py", "jobs/nightly.py", "lib.ledger", "import", "jobs/lib/ledger.py"),
    ("jobs/nightly.py jobs/rates/__init__.py", "jobs/nightly.py", "rates", "import", "jobs/rates/__init__.py"), ("app/Boot.java app/org/acme/Vault.java", "app/Boot.java", "org.acme.Vault", "import", "app/org/acme/Vault.java"),
    ("engine/lib.rs engine/gears.rs", "engine/lib.rs", "gears", "mod", "engine/gears.rs"), ("tool/run.go net/dial.go", "tool/run.go", "net/dial", "import", "net/dial.go"), ("svc/Host.cs svc/Store/Shelf.cs", "svc/Host.cs", "Store.Shelf", "using", "svc/Store/Shelf.cs"),
    # a neighbour wins over a namesake elsewhere; among namesakes elsewhere none does
    ("jobs/nightly.py jobs/dates.py lib/dates.py", "jobs/nightly.py", "dates", "import", "jobs/dates.py"), ("cli/entry.py jobs/dates.py lib/dates.py", "cli/entry.py", "dates", "import", ""),
    # extensions that compete: in the order of the list
    ("ui/shell.ts ui/grid.ts ui/grid.js", "ui/shell.ts", "./grid", "import", "ui/grid.js"), ("web/page.php web/menu.php web/menu.blade.php", "web/page.php", "./menu", "include", "web/menu.blade.php"),
    ("ui/shell.ts ui/grid.tsx ui/grid.mts", "ui/shell.ts", "./grid", "import", "ui/grid.tsx"), ("ui/shell.ts ui/set/index.tsx ui/set/index.js", "ui/shell.ts", "./set", "import", "ui/set/index.js"),
]


def test_resolution(spark):
    # Each case in a folder of its own would change its suffixes, so cases run one by one in few jobs.
    for files, source, target, kind, want in CASES:
        f = spark.createDataFrame([(p,) for p in files.split()], "path string")
        i = spark.createDataFrame([(1, source, target, kind, "")], "import_id long, source_file string, target_name string, import_type string, language string")
        assert resolve.resolve_imports(i, f).first().resolved_file == want, (source, target)


def test_blast(spark):
    rows = [("model/fit.py", "ingest/clean.py", "trim"), ("report/plot.py", "ingest/clean.py", "trim"), ("report/mail.py", "report/plot.py", "draw")]
    texts = spark.createDataFrame([("model/fit.py", "x = trim(a); y = trim(b)"), ("report/plot.py", "trimmed = 1"), ("report/mail.py", "draw()")], "file string, text string")
    got = {r.file: (r.depth, r.refs, r.status) for r in graph.blast_radius(edges(spark, rows), texts, "ingest/clean.py", "trim").collect()}
    assert got == {"model/fit.py": (0, 2, "confirmed"), "report/plot.py": (0, 0, "potential"), "report/mail.py": (1, 0, "potential")}


def test_scopes_and_references(spark):
    rows = random_edges(6, 20)
    e = edges(spark, rows)
    one = rows[0][0]
    assert {r.file for r in graph.scope_files(e, imports_of_file=one).collect()} == {one} | {b for a, b, _ in rows if a == one}
    assert graph.references(e, "NAME3").count() == sum(n == "name3" for _, _, n in rows)
    importers = {f: len({a for a, b, _ in rows if b == f}) for f in FILES}
    assert graph.most_imported(e).first().importers == max(importers.values())
