"""Registered queries of the source tree, of inspection and of upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, hints, incremental, inspect, resolve, search, stats, textsearch
from ..sources import extract, files, scopes
from . import bindings as B
from .registry import DOC_SYMBOLS, FILES, FOREST, LINES, _FOUND, FOUND, query, ranked_sql, _snapshots, _SNAP

TREE = "tre AS (SELECT source || '/' || lang || '/d' || doc_id || ['.py', '.ts', '.js', '.c', ''][1 + doc_id % 5] AS path, text AS content, doc_id, source, lang FROM documents)"
TREE_IMPORTS = TREE + """, imp AS (SELECT doc_id AS import_id, path AS source_file, source || '/' || lang AS folder, lang, [np, './d' || k, '../' || lang || '/d' || k, source || '.' || lang || '.d' || k, 'd' || k, 'pkg.' || lang || '.d' || k, 'vendor/unknown', np][1 + doc_id % 8] AS t, doc_id % 8 = 7 AS system
FROM (SELECT *, lead(path) OVER w AS np, lead(doc_id) OVER w AS k FROM tre WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)) WHERE k IS NOT NULL)"""
TREE_SYMBOLS = TREE + ", sym AS (SELECT doc_id AS id, lang AS name, lang || '.d' || doc_id AS qualified_name, '' AS signature, CASE doc_id % 2 WHEN 0 THEN 'Class ' || lang ELSE 'document of ' || source END AS summary, '' AS docstring, [lang] AS keywords, path AS file, CAST(1 AS BIGINT) AS line, 'class' AS kind, lang AS language, CAST(100 AS BIGINT) AS byte_length FROM tre)"
_TRIED = ["", ".blade.php", ".html.twig", ".php", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".vue", ".py", ".java", ".kt", ".scala", ".rb", ".go", ".rs", ".cs", ".swift", ".hs", ".c", ".h", ".cpp", ".hpp", ".cc"]


@query("resolve_imports", f"""WITH {TREE_IMPORTS}, ext(i, e) AS (VALUES {', '.join(f"({i}, '{e}')" for i, e in enumerate(_TRIED))}),
keys AS (SELECT DISTINCT path, array_to_string(string_split(p, '/')[j:], '/') AS key FROM (SELECT path, unnest([lower(path), lower(regexp_replace(path, '[.][^./]*$', ''))]) AS p FROM tre) q, (VALUES (1), (2), (3)) v(j)),
sfx AS (SELECT key, min(path) AS path FROM keys GROUP BY key HAVING count(*) = 1),
asked AS (SELECT * FROM imp WHERE NOT system), rel AS (SELECT import_id, CASE WHEN starts_with(t, '../') THEN regexp_replace(folder, '/[^/]*$', '') || t[3:] ELSE folder || t[2:] END AS p FROM asked WHERE starts_with(t, '.')),
parts AS (SELECT import_id, string_split(lower(CASE WHEN contains(t, '/') THEN t ELSE replace(t, '.', '/') END), '/') AS p FROM asked WHERE NOT starts_with(t, '.')),
cand AS (SELECT import_id, 0 AS prio, path FROM asked JOIN tre ON path = t UNION ALL SELECT import_id, 100 + i, path FROM rel, ext, tre WHERE path = p || e
UNION ALL SELECT import_id, 200 + i, path FROM asked, ext, tre WHERE NOT contains(t, '/') AND path = folder || '/' || t || e
UNION ALL SELECT import_id, 300 + 100 * j + i, path FROM parts, (VALUES (1), (2), (3)) v(j), ext, sfx WHERE j <= len(p) AND key = array_to_string(p[j:], '/') || e)
SELECT imp.import_id, source_file, t AS target_name, coalesce(best, '') AS resolved_file FROM imp LEFT JOIN (SELECT import_id, arg_min(path, prio) AS best FROM cand GROUP BY 1) USING (import_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_imports(B.tree_imports(spark, d), B.tree(spark, d).select("path")).select("import_id", "source_file", "target_name", "resolved_file")


_BONUS = "CASE regexp_extract(sym.file, '[.]([^.]*)$', 1) WHEN 'c' THEN 2.0 WHEN 'py' THEN 1.0 WHEN 'ts' THEN 1.0 WHEN 'js' THEN 1.0 ELSE 0.0 END"


@query("search_extension_bonus", f"WITH {ranked_sql('en', views=TREE_SYMBOLS, extra=_BONUS.replace('sym.file', 'scored.file'))} SELECT {_FOUND} FROM ranked")
def _(spark, d):
    return search.search_symbols(B.tree_symbols(spark, d), "en", file_bonus=True).select(FOUND)


@query("search_glob", f"WITH {ranked_sql('en', views=TREE_SYMBOLS, cap=None, where='regexp_matches(file, ' + chr(39) + '^src1.*/d[0-9]*[13].*[.](py|js)$' + chr(39) + ')')} SELECT count(*) AS n, min(id) AS first FROM ranked")
def _(spark, d):
    s = B.tree_symbols(spark, d)
    found = [search.search_symbols(s, "en", file_glob=f"SRC1*/d*[13]*.{e}", cap=None) for e in ("py", "js")]
    return found[0].unionByName(found[1]).where(F.col("file").rlike("/d[0-9]*[13]")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("search_detail", f"WITH {ranked_sql('en', views=TREE_SYMBOLS, extra=_BONUS.replace('sym.file', 'scored.file'))} SELECT id, name, kind, file, line, byte_length, qualified_name, signature, CASE WHEN summary <> 'Class ' || name THEN summary END AS summary, score FROM ranked")
def _(spark, d):
    return search.detail(search.search_symbols(B.tree_symbols(spark, d), "en", file_bonus=True))


def _contents(spark, d):
    return B.files(spark, d).select(F.col("path").alias("file"), F.col("content").cast("binary").alias("content"))


@query("symbol_source", f"WITH {DOC_SYMBOLS} SELECT id, sha256(lin.text) AS hash, true AS verified FROM dsy JOIN lin ON lin.path = file AND lin.line = dsy.line")
def _(spark, d):
    lines = B.lines(spark, d)
    at = textsearch.line_offsets(lines).join(lines.select("path", "line", F.sha2("text", 256).alias("content_hash")), ["path", "line"]).select(F.col("path").alias("file"), "line", "byte_offset", (F.col("byte_length") - 1).alias("byte_length"), "content_hash")
    return inspect.sources(B.doc_symbols(spark, d).select("id", "file", "line").join(at, ["file", "line"]), _contents(spark, d), verify=True).select("id", F.sha2("source", 256).alias("hash"), "verified")


@query("symbol_source_context", f"WITH {DOC_SYMBOLS}, whole AS (SELECT path, string_split(content, chr(10)) AS ls FROM fil) SELECT id, md5(array_to_string(ls[greatest(line - 2, 1):line + 2], chr(10))) AS hash FROM dsy JOIN whole ON path = file")
def _(spark, d):
    s = B.doc_symbols(spark, d).withColumn("end_line", F.col("line"))
    return inspect.source_lines(s, _contents(spark, d), 2).select("id", F.md5(F.col("source").cast("binary")).alias("hash"))


@query("file_slice", f"WITH {LINES} SELECT path, line, text FROM lin WHERE path = (SELECT max(path) FROM fil) AND line >= 2 AND line <= 100000")
def _(spark, d):
    return textsearch.file_slice(B.lines(spark, d), B.files(spark, d).agg(F.max("path")).first()[0], 2, 100000)


@query("hierarchy", f"WITH {FOREST}, r AS (SELECT id FROM f WHERE parent_id IS NULL ORDER BY id LIMIT 200) SELECT r.id, coalesce(string_agg(k.id || ':' || k.role, ',' ORDER BY k.id, k.role), '') AS children FROM r LEFT JOIN f k ON k.parent_id = r.id GROUP BY r.id")
def _(spark, d):
    s = B.forest(spark, d).select("id", "parent_id", F.floor(F.col("id") / 1000).alias("file"), (F.col("id") % 1000).alias("line"), F.col("role").alias("name"), F.when(F.col("parent_id").isNull(), "class").otherwise("method").alias("kind"))
    return inspect.hierarchy(s).select("id", F.array_join(F.transform("children", lambda c: F.concat(c["child"].cast("string"), F.lit(":"), c["name"])), ",").alias("children"))


_STEP = "stp AS (SELECT path AS a, lead(path) OVER (PARTITION BY split_part(path, '/', 1), language ORDER BY doc_id) AS b FROM fil)"


@query("bundle", f"WITH {DOC_SYMBOLS}, {_STEP}, ask AS (SELECT * FROM dsy ORDER BY id LIMIT 5) SELECT ask.id, lin.text AS source, (SELECT string_agg(line || ':' || kind || ':' || name, ',' ORDER BY line) FROM dsy s WHERE s.file = ask.file) AS outline, (SELECT string_agg(b, ',') FROM stp WHERE a = ask.file) AS imports, (SELECT string_agg(a, ',') FROM stp WHERE b = ask.file) AS importers FROM ask JOIN lin ON lin.path = ask.file AND lin.line = ask.line")
def _(spark, d):
    s = B.doc_symbols(spark, d).withColumn("end_line", F.col("line"))
    f = B.files(spark, d)
    step = f.selectExpr("path as source_file", "lead(path) over (partition by substring_index(path, '/', 1), language order by doc_id) as resolved_file").where("resolved_file is not null").withColumn("target_name", F.col("resolved_file"))
    ids = [r.id for r in s.orderBy("id").limit(5).collect()]
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    out = inspect.bundle(s, _contents(spark, d), step, ids, full=True)
    outline = F.array_join(F.transform("outline", lambda x: F.concat_ws(":", x["line"].cast("string"), x["kind"], x["name"])), ",")
    return out.select("id", "source", outline.alias("outline"), joined(F.col("imports")).alias("imports"), joined(F.col("importers")).alias("importers"))


_CODE = """VALUES (0, 'C#', 'C#', 'class', 1, 4, 'Holds.'), (0, 'run', 'C#.run', 'method', 3, 4, 'Method run'), (0, 'go', 'go', 'function', 6, 7, 'Function go'), (1, 'W#', 'W#', 'class', 3, 5, 'Draws it.'), (1, 'f#', 'f#', 'function', 6, 8, 'Function f#'),
(2, 'z', 'z', 'constant', 1, 1, 'Constant z'), (2, 'g#', 'g#', 'function', 2, 4, 'Function g#'), (3, 'SIZE', 'SIZE', 'constant', 3, 3, 'Constant SIZE'), (3, 's#', 's#', 'class', 4, 6, 'Class s#')"""


@query("extract_symbols", f"WITH {TREE}, code(m, name, qualified_name, kind, line, end_line, summary) AS ({_CODE}) SELECT path || '::' || replace(qualified_name, '#', doc_id::VARCHAR) || '#' || kind AS id, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, replace(summary, '#', doc_id::VARCHAR) AS summary, CASE WHEN name <> qualified_name THEN path || '::C' || doc_id || '#class' END AS parent_id FROM tre JOIN code ON m = doc_id % 5")
def _(spark, d):
    c = B.sample_contents(spark, d)
    lines = textsearch.lines_of(c).join(c.select("path", "language"), "path")
    rows = scopes.symbols_of(lines, c.select(F.col("path").alias("file"), F.col("content").cast("binary").alias("content")))
    return rows.select("id", F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "summary", "parent_id")


@query("extract_imports", f"WITH {TREE}, i(m, target, name, kind, line) AS (VALUES (1, './m#', 'a#', 'import', 1), (2, 'q#', 'module', 'require', 1), (3, 'stdio.h', 'module', 'system_include', 1), (3, 'h#.h', 'module', 'include', 2)) SELECT path AS source_file, replace(target, '#', doc_id::VARCHAR) AS target_name, replace(name, '#', doc_id::VARCHAR) AS imported_name, kind AS import_type, CAST(line AS BIGINT) AS line FROM tre JOIN i ON m = doc_id % 5")
def _(spark, d):
    c = B.sample_contents(spark, d)
    lines = textsearch.lines_of(c).join(c.select("path", "language"), "path")
    return extract.extract_imports(lines).select("source_file", "target_name", "imported_name", "import_type", "line")


@query("files_relation", f"WITH {TREE} SELECT path, sha256(content) AS hash, ['python', 'typescript', 'javascript', 'c', 'unknown'][1 + doc_id % 5] AS language, CAST(strlen(content) AS BIGINT) AS size_bytes FROM tre")
def _(spark, d):
    t = B.tree(spark, d).select("path", F.col("content").cast("binary").alias("content"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("mtime"))
    return files.files_of(t).drop("mtime")


_PLACES = "['node_modules/' || path, path || '.png', source || '/.env', source || '/' || lang || '/yarn.lock', source || '/id_rsa', path, path, path][1 + doc_id % 8]"


@query("discover", f"WITH {TREE}, p AS (SELECT {_PLACES} AS path, doc_id FROM tre WHERE doc_id % 8 >= 5) SELECT path, doc_id FROM p WHERE NOT starts_with(path, 'src3/') AND NOT ends_with(path, '.c') AND NOT starts_with(path, 'src5/en/') AND strlen((SELECT text FROM documents x WHERE x.doc_id = p.doc_id)) <= 1048576")
def _(spark, d):
    place = B.by_id(F.concat(F.lit("node_modules/"), "path"), F.concat("path", F.lit(".png")), F.concat("source", F.lit("/.env")), F.concat_ws("/", "source", "lang", F.lit("yarn.lock")), F.concat("source", F.lit("/id_rsa")), F.col("path"), F.col("path"), F.col("path"))
    t = B.tree(spark, d).withColumns({"path": place, "size_bytes": F.octet_length("content").cast("long"), "content": F.col("content").cast("binary")})
    return files.discover(t, rules=files.parse_ignore("# built\nsrc3/\n*.c\n/src5/en\n")).select("path", "doc_id")


@query("symbol_roles", """SELECT doc_id, ['test_a.py', 'a_spec.ts', 'a.test.js', 'latest.c', 'contest/x.go'][1 + doc_id % 5] AS path, doc_id % 5 <= 2 AS is_test, doc_id % 6 <= 3 AS is_entry, ['low', 'high', 'medium', 'high'][1 + doc_id % 4] AS confidence FROM documents""")
def _(spark, d):
    doc = B.read(spark, d, "documents")
    path, name, language = B.by_id("test_a.py", "a_spec.ts", "a.test.js", "latest.c", "contest/x.go"), B.by_id("main", "test_x", "Testing", "tearDown", "attest", "teardown"), B.by_id("php", "go", "python", "c")
    return doc.select("doc_id", path.alias("path"), T.is_test_file(path).alias("is_test"), T.is_entry_point(name).alias("is_entry"), T.confidence(language).alias("confidence"))


@query("symbol_descriptions", "SELECT p_partkey AS id, p_name || ': ' || p_type AS signature, ['Class', 'Method', 'Property', 'Function', 'Variable'][1 + p_size % 5] || ' ' || p_name AS fallback, ['class', 'method', 'property', 'function', 'variable'][1 + p_size % 5] AS kind FROM part")
def _(spark, d):
    p = B.read(spark, d, "part")
    kind = T.normalize_kind(F.array(*map(F.lit, ("struct", "member", "Field", "function", "odd")))[(F.col("p_size") % 5).cast("int")])
    return p.select(F.col("p_partkey").alias("id"), T.signature_of(F.concat(F.lit("/^  "), "p_name", F.lit("$/;\"")), F.col("p_type")).alias("signature"), T.fallback_summary(kind, F.col("p_name")).alias("fallback"), kind.alias("kind"))


@query("upsert", f"WITH {TREE} SELECT path, CASE WHEN lang = 'en' THEN 'new' ELSE md5(content) END AS hash FROM tre UNION ALL SELECT path || '.new', 'new' FROM tre WHERE lang = 'de'")
def _(spark, d):
    t = B.tree(spark, d)
    fresh = t.where("lang in ('en', 'de')").select(F.when(F.col("lang") == "de", F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.lit("new").alias("hash"))
    return incremental.upsert(t.select("path", F.md5(F.col("content").cast("binary")).alias("hash")), fresh, "path")


@query("delete_cascade", f"WITH {DOC_SYMBOLS}, kept AS (SELECT path FROM fil WHERE language <> 'de') SELECT 'files' AS name, count(*) AS n FROM kept UNION ALL SELECT 'symbols', count(*) FROM dsy JOIN kept ON path = file UNION ALL SELECT 'lines', count(*) FROM lin JOIN kept USING (path)")
def _(spark, d):
    f = B.files(spark, d)
    left = incremental.delete_cascade({"files": (f.select("path"), "path"), "symbols": (B.doc_symbols(spark, d).select("file"), "file"), "lines": (B.lines(spark, d).select("path"), "path")}, f.where("language = 'de'"))
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("set_metadata", "SELECT source AS project, lang AS key, CASE lang WHEN 'en' THEN 'set' ELSE CAST(count(*) AS VARCHAR) END AS value FROM documents WHERE lang <> 'de' GROUP BY source, lang")
def _(spark, d):
    m = B.read(spark, d, "documents").groupBy(F.col("source").alias("project"), F.col("lang").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return incremental.set_metadata(m, m.where("key in ('en', 'de')").withColumn("value", F.when(F.col("key") == "en", "set")))


@query("update_times", f"WITH {_SNAP} SELECT st.path, st.size, CASE WHEN di.mtime <> st.mtime AND di.hash = st.hash THEN di.mtime ELSE st.mtime END AS mtime, st.hash FROM st LEFT JOIN di ON st.path = di.path")
def _(spark, d):
    stored, listed = _snapshots(spark, d)
    return incremental.update_times(stored, listed, incremental.detect_changes(stored, listed)).select("path", "size", "mtime", "hash")


_AGES = "m AS (SELECT source AS project, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, current_date - CAST(count(*) % 15 AS INTEGER) AS day, md5(source) AS head FROM documents GROUP BY source)"


@query("projects", f"WITH {_AGES}, {DOC_SYMBOLS}, s AS (SELECT split_part(file, '/', 1) AS project, count(*) AS symbols FROM dsy GROUP BY 1) SELECT project, left(head, 8) AS git_head, files, bytes, symbols, CAST(files % 15 AS BIGINT) AS age_days, files % 15 >= 7 AS stale FROM m LEFT JOIN s USING (project)")
def _(spark, d):
    f = B.files(spark, d).select(F.substring_index("path", "/", 1).alias("project"), "size_bytes")
    meta = f.groupBy("project").agg(F.count("*").alias("n")).select("project", F.md5(F.col("project").cast("binary")).alias("git_head"), F.concat(F.date_sub(F.current_date(), (F.col("n") % 15).cast("int")).cast("string"), F.lit("T12:00:00Z")).alias("indexed_at"))
    s = B.doc_symbols(spark, d).select(F.substring_index("file", "/", 1).alias("project"))
    return stats.projects(meta, f, s).select("project", "git_head", "files", "bytes", "symbols", F.col("age_days").cast("long").alias("age_days"), "stale")


@query("stale_heads", f"WITH {_AGES} SELECT project, files % 2 = 0 AS stale FROM m")
def _(spark, d):
    n = B.read(spark, d, "documents").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n"))
    head = F.md5(F.col("project").cast("binary"))
    return incremental.stale_heads(n.select("project", head.alias("git_head")), n.select("project", F.when(F.col("n") % 2 == 0, "other").otherwise(head).alias("head")))


_LISTED = "lst AS (SELECT source AS project, CASE WHEN doc_id % 150 = 0 THEN 'package.json' WHEN doc_id % 60 = 7 THEN lang || '/x/go.mod' WHEN doc_id % 60 = 9 THEN lang || '/App.csproj' WHEN doc_id % 40 = 11 THEN '.git/HEAD' WHEN doc_id % 40 = 12 THEN 'vendor/pom.xml' ELSE lang || '/d' || doc_id || ['.py', '.ts', '.js', '.c', ''][1 + doc_id % 5] END AS path FROM documents)"


@query("detect_codebases", f"""WITH {_LISTED}, facts AS (SELECT project, bool_or(path = 'package.json') AS root, bool_or(ends_with(path, '.csproj')) AS one, bool_or(ends_with(path, 'go.mod')) AS two, bool_or(starts_with(path, '.git/')) AS git, count(*) FILTER (WHERE regexp_matches(path, '^[a-z]+/d[0-9]+[.](py|ts|js|c)$')) AS n FROM lst GROUP BY 1),
found AS (SELECT project, CASE WHEN root THEN 'manifest-root' WHEN one OR two THEN 'manifest-subdir' WHEN git AND n >= 5 THEN 'heuristic' ELSE 'none' END AS detection, CASE WHEN root THEN 'node' WHEN one THEN 'dotnet' WHEN two THEN 'go' ELSE '' END AS ecosystems FROM facts)
SELECT *, CASE WHEN detection = 'none' THEN 'skip' WHEN project LIKE '%2' THEN 'ready' ELSE 'index:create' END AS action FROM found""")
def _(spark, d):
    i, name = F.col("doc_id"), F.concat(F.lit("/d"), F.col("doc_id").cast("string"), B.by_id(*B.TREE_EXTENSIONS))
    path = F.when(i % 150 == 0, "package.json").when(i % 60 == 7, F.concat("lang", F.lit("/x/go.mod"))).when(i % 60 == 9, F.concat("lang", F.lit("/App.csproj"))).when(i % 40 == 11, ".git/HEAD").when(i % 40 == 12, "vendor/pom.xml").otherwise(F.concat(F.col("lang"), name))
    listing = B.read(spark, d, "documents").select(F.col("source").alias("project"), path.alias("path"))
    return files.detect_codebases(listing, listing.where("project like '%2'")).withColumn("ecosystems", F.array_join("ecosystems", ","))


@query("next_steps", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'index_create — no index exists yet' ELSE concat_ws('|', CASE WHEN value < 10 THEN 'index_update — index is stale' END, CASE WHEN value < 20 THEN 'search_text for full-text fallback' ELSE 'inspect_symbol s' || event_id END, CASE WHEN value >= 20 THEN 'inspect_bundle s' || event_id END) END AS next FROM events")
def _(spark, d):
    few = F.col("value") < 20
    calls = B.read(spark, d, "events").select("event_id", F.lit("search_symbols").alias("tool"), F.when(few, 0).otherwise(1).alias("n"), F.when(~few, F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("id"), F.lit(None).cast("string").alias("file"), F.lit("").alias("action"), F.lit(0).alias("changed"), F.when(F.col("event_type") == "error", "no_index").alias("error"), (F.col("value") < 10).alias("stale"))
    return hints.next_steps(calls).select(F.col("event_id").alias("id"), F.array_join("next", "|").alias("next"))


@query("dead_tree_symbols", f"WITH {TREE_SYMBOLS}, firsts AS (SELECT arg_min(path, doc_id) AS path FROM tre GROUP BY source, lang) SELECT id, CASE WHEN file IN (SELECT path FROM firsts) THEN 'dead' ELSE 'unreferenced' END AS classification, 'low' AS confidence FROM sym WHERE name <> 'en' OR file IN (SELECT path FROM firsts)")
def _(spark, d):
    folder = "lead(path) over (partition by source, lang order by doc_id)"
    step = B.tree(spark, d).selectExpr("path as source_file", f"{folder} as resolved_file", "'en' as imported_name", "'en' as target_name", "0L as line").where("resolved_file is not null")
    return graph.dead_symbols(B.tree_symbols(spark, d), step, limit=None).select("id", "classification", "confidence")
