"""The registered queries and their SQL, by the names of the survey's build plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, incremental, ingest, inspect, search, stats, textsearch
from ..operators.search import EXTENSION_BONUS, query_words, threshold
from . import bindings as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The views of bindings.py in SQL.
SYMBOLS = "sym AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS signature, p_type || ' ' || p_name AS summary, '' AS docstring, string_split(p_name, ' ') AS keywords, p_brand AS file, CAST(p_size AS BIGINT) AS line, p_type AS kind, lower(p_type) AS language, CAST(p_size * 10 AS BIGINT) AS byte_length FROM part)"
IMPORTS = """pairs AS (SELECT DISTINCT a AS source_file, b AS resolved_file FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b),
imp AS (SELECT source_file, resolved_file, p_name AS imported_name, p_brand AS target_name, CAST(0 AS BIGINT) AS line FROM pairs JOIN part ON p_partkey = resolved_file)"""
FILES = "fil AS (SELECT source || '/' || lang || '/' || doc_id AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS size_bytes, md5(text) AS hash, text AS content, doc_id FROM documents)"
LINES = FILES + ", lin AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (SELECT path, string_split(content, chr(10)) AS ls FROM fil WHERE content IS NOT NULL))"
DOC_SYMBOLS = LINES + ", dsy AS (SELECT *, CASE WHEN length(name) > 4 THEN 'class' ELSE 'function' END AS kind, file || ':' || line AS id, string_split(file, '/')[2] AS language FROM (SELECT path AS file, line, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS name, CAST(strlen(text) AS BIGINT) AS bytes FROM lin) WHERE name <> '')"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scorer_sql(q: str) -> str:
    """The score parts of a query as SQL columns over sym."""
    q, words = q.lower(), query_words(q)
    has = lambda col, w: f"contains(lower({col}), {_quoted(w)})"
    n = lambda col: " + ".join(f"CAST({has(col, w)} AS INT)" for w in words)
    kw = "list_filter(keywords, lambda x: contains(lower(x), %s))" % _quoted(q)
    own = " OR ".join(f"contains(x, {_quoted(w)})" for w in words)
    text = "concat_ws(chr(10), name, qualified_name, summary, signature, array_to_string(keywords, chr(10)))"
    m = " + ".join(f"CAST({has(text, w)} AS INT)" for w in words)
    return f"""CASE WHEN lower(name) = {_quoted(q)} OR lower(qualified_name) = {_quoted(q)} THEN 20 WHEN {has('name', q)} THEN 10 ELSE 5 * len(list_filter(regexp_split_to_array(lower(name), '[ _.]+'), lambda x: x <> '' AND ({own}))) END AS s_name,
CASE WHEN {has('signature', q)} THEN 8 ELSE 2 * ({n('signature')}) END AS s_signature, CASE WHEN {has('summary', q)} THEN 5 ELSE {n('summary')} END AS s_summary,
3 * len({kw}) AS s_keywords, {n('docstring')} AS s_docstring, CASE WHEN {len(words)} >= 2 AND ({m}) >= 2 THEN 5 * (({m}) - 1) ELSE 0 END AS s_several"""


def ranked_sql(q: str, where: str = "true", cap: int | None = 50, views: str = SYMBOLS, extra: str = "0.0", joins: str = "") -> str:
    """CTEs that end in `ranked`: sym with its score parts and score, capped."""
    total = "s_name + s_signature + s_summary + s_keywords + s_docstring + s_several"
    tail = f"ORDER BY score DESC, id LIMIT {cap}" if cap else ""
    return f"{views}, parts AS (SELECT sym.*, {scorer_sql(q)} FROM sym WHERE {where}), scored AS (SELECT *, CAST({total} AS DOUBLE) AS base FROM parts WHERE {total} >= {threshold(q)}), ranked AS (SELECT scored.*, round(base + {extra}, 6) AS score FROM scored {joins} {tail})"


RED = "red bolt"
FOUND = ["id", "name", "file", "line", "score"]
_FOUND = "id, name, file, line, score"


@query("search_symbols_exact_multi", f"WITH {ranked_sql(RED)} SELECT {_FOUND} FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.search_symbols(B.symbols(spark, d), RED).select(FOUND)


@query("search_symbols_kind_path_filter", f"WITH {ranked_sql(RED, where='kind IN (' + chr(39) + 'MEDIUM' + chr(39) + ',' + chr(39) + 'LARGE' + chr(39) + ')')} SELECT {_FOUND} FROM ranked WHERE contains(lower(file), 'brand#1') AND NOT contains(lower(file), 'brand#12')")
def _(spark, d):
    return search.refine(search.search_symbols(B.symbols(spark, d), RED, kinds=["MEDIUM", "LARGE"]), "brand#1", "Brand#12").select(FOUND)


@query("search_symbols_unique_sorted", f"WITH {ranked_sql('bolt', cap=200)} SELECT {_FOUND} FROM (SELECT *, row_number() OVER (PARTITION BY file, line, name ORDER BY score DESC, id) AS n FROM ranked) WHERE n = 1 ORDER BY lower(name), id LIMIT 40")
def _(spark, d):
    return search.refine(search.search_symbols(B.symbols(spark, d), "bolt", cap=200), unique=True, sort="name", limit=40).select(FOUND)


@query("search_symbols_token_budget", f"WITH {ranked_sql(RED)} SELECT {_FOUND}, CAST(used AS BIGINT) AS used_bytes FROM (SELECT *, sum(byte_length) OVER o AS used, row_number() OVER o AS n FROM ranked WINDOW o AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)) WHERE used <= 4 * 700 OR n = 1")
def _(spark, d):
    return search.refine(search.search_symbols(B.symbols(spark, d), RED), token_budget=700).select(*FOUND, "used_bytes")


PARTS = ["s_name", "s_signature", "s_summary", "s_keywords", "s_docstring", "s_several"]


@query("search_symbols_debug", f"WITH {ranked_sql('small ring.bolt')} SELECT id, {', '.join(f'CAST({p} AS BIGINT) AS {p}' for p in PARTS)}, score FROM ranked")
def _(spark, d):
    return search.search_symbols(B.symbols(spark, d), "small ring.bolt").select("id", *[F.col(p).cast("long").alias(p) for p in PARTS], "score")


@query("search_symbols_count", f"WITH {ranked_sql('bolt', cap=None)} SELECT count(*) AS n FROM ranked")
def _(spark, d):
    return search.search_symbols(B.symbols(spark, d), "bolt", cap=None).agg(F.count("*").alias("n"))


@query("search_symbols_regex", f"WITH {SYMBOLS} SELECT id, name, file, line, 1.0::DOUBLE AS score FROM sym WHERE contains(lower(name), 'd bo') OR contains(lower(qualified_name), 'd bo') OR contains(lower(signature), 'd bo') ORDER BY id LIMIT 50")
def _(spark, d):
    return search.search_symbols(B.symbols(spark, d), "d bo", regex=True).select(FOUND)


_EXT = "CASE " + " ".join(f"WHEN lower(regexp_extract(sym2, '[.]([^.]*)$', 1)) IN ({', '.join(map(_quoted, v))}) THEN {k}" for k, v in EXTENSION_BONUS.items()) + " ELSE 0.0 END"
PART_SYMBOLS = SYMBOLS.replace("p_brand AS file", "p_partkey AS file")


@query("search_symbols_fts_gate", "WITH " + IMPORTS + ", cen AS (SELECT resolved_file AS f, round(ln(1 + count(DISTINCT source_file)), 6) AS c FROM imp GROUP BY 1), " + ranked_sql("red bol", views=PART_SYMBOLS, where="len(list_filter(regexp_extract_all(lower(concat_ws(' ', name, qualified_name, signature, summary)), '[\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'red') OR starts_with(t, 'bol'))) > 0", extra="floor(coalesce(c, 0) * 1000) / 1000 * 0.3", joins="LEFT JOIN cen ON f = scored.file") + " SELECT id, name, score FROM ranked")
def _(spark, d):
    s = B.part_symbols(spark, d)
    return search.search_symbols(s, "red bol", use_gate=True, centrality=graph.centrality(B.imports(spark, d)), index=search.postings(s)).select("id", "name", "score")


@query("search_scope_imports", f"WITH {IMPORTS}, {ranked_sql('bolt', views=PART_SYMBOLS, cap=200)} SELECT id, name, score FROM ranked WHERE file = 5 OR file IN (SELECT resolved_file FROM imp WHERE source_file = 5)")
def _(spark, d):
    return search.refine(search.search_symbols(B.part_symbols(spark, d), "bolt", cap=200), scope=graph.scope_files(B.imports(spark, d), imports_of_file=5)).select("id", "name", "score")


@query("search_scope_importers", f"WITH {IMPORTS}, {ranked_sql('bolt', views=PART_SYMBOLS, cap=200)} SELECT id, name, score FROM ranked WHERE file = 5 OR file IN (SELECT source_file FROM imp WHERE resolved_file = 5)")
def _(spark, d):
    return search.refine(search.search_symbols(B.part_symbols(spark, d), "bolt", cap=200), scope=graph.scope_files(B.imports(spark, d), importers_of_file=5)).select("id", "name", "score")


# The first part named "small ring"; its words are small, ring, small, ring.
_RING = "(SELECT min(p_partkey) FROM part WHERE p_name = 'small ring')"


@query("search_similar", f"WITH {IMPORTS}, {ranked_sql('small ring small ring', views=PART_SYMBOLS, where='kind = (SELECT p_type FROM part WHERE p_partkey = ' + _RING + ')', cap=21)}, a AS (SELECT source_file, count(*) AS n FROM imp WHERE resolved_file = {_RING} GROUP BY 1), sh AS (SELECT resolved_file AS f, sum(n) AS shared FROM imp JOIN a USING (source_file) WHERE resolved_file <> {_RING} GROUP BY 1) SELECT id, name, score + 1.5 * coalesce(shared, 0) AS score FROM ranked LEFT JOIN sh ON f = file WHERE id <> {_RING} ORDER BY score DESC, id LIMIT 20")
def _(spark, d):
    s = B.part_symbols(spark, d)
    ring = s.where("name = 'small ring'").agg(F.min("id")).first()[0]
    return search.search_similar(s, B.imports(spark, d), ring).select("id", "name", "score")


@query("search_cooccurrence", f"WITH {DOC_SYMBOLS} SELECT a.file, a.id AS id_a, a.name AS name_a, a.line AS line_a, b.id AS id_b, b.name AS name_b, b.line AS line_b FROM dsy a JOIN dsy b ON a.file = b.file AND a.id <> b.id WHERE a.name ILIKE '%the%' AND b.name ILIKE '%er%' ORDER BY a.file, line_a, line_b, id_a, id_b LIMIT 50")
def _(spark, d):
    return search.cooccurrence(B.doc_symbols(spark, d), "the", "er")


_CLIP = "CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 200 THEN left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 200) || '...' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END"


@query("text_search", f"WITH {LINES} SELECT path, line, {_CLIP} AS text FROM lin WHERE contains(lower(text), 'license') OR contains(lower(text), 'token =') ORDER BY path, line LIMIT 100")
def _(spark, d):
    return textsearch.text_search(B.lines(spark, d), "license | token =")


@query("text_search_regex", f"WITH {LINES} SELECT path, line, {_CLIP} AS text FROM lin WHERE regexp_matches(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AND contains(lower(path), '/en/') ORDER BY path, line LIMIT 100")
def _(spark, d):
    return textsearch.text_search(B.lines(spark, d), "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", regex=True, case_sensitive=True, wanted="/en/")


@query("text_search_context", f"WITH {LINES}, hit AS (SELECT path, line, {_CLIP} AS text FROM lin WHERE contains(lower(text), 'license') ORDER BY path, line LIMIT 100) SELECT h.path, h.line, h.text, coalesce((SELECT string_agg(l.text, '|' ORDER BY l.line) FROM lin l WHERE l.path = h.path AND l.line BETWEEN h.line - 2 AND h.line - 1), '') AS before, coalesce((SELECT string_agg(l.text, '|' ORDER BY l.line) FROM lin l WHERE l.path = h.path AND l.line BETWEEN h.line + 1 AND h.line + 2), '') AS after FROM hit h")
def _(spark, d):
    lines = B.lines(spark, d)
    out = textsearch.with_context(textsearch.text_search(lines, "license"), lines, 2)
    return out.withColumns({"before": F.array_join("before", "|"), "after": F.array_join("after", "|")})


@query("text_search_group", f"WITH {LINES}, hit AS (SELECT path, line FROM lin WHERE contains(lower(text), 'the') ORDER BY path, line LIMIT 500) SELECT path, count(*) AS hits FROM hit GROUP BY path")
def _(spark, d):
    return textsearch.grouped(textsearch.text_search(B.lines(spark, d), "the", most=500))


@query("text_search_count", f"WITH {LINES} SELECT count(*) AS hits FROM lin WHERE contains(text, 'The') OR contains(text, 'Les')")
def _(spark, d):
    return textsearch.count_hits(B.lines(spark, d), "The|Les", case_sensitive=True)


@query("line_offsets", f"WITH {LINES} SELECT path, line, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, CAST(strlen(text) + 1 AS BIGINT) AS byte_length FROM lin")
def _(spark, d):
    return textsearch.line_offsets(B.lines(spark, d))


@query("importers", f"WITH {IMPORTS} SELECT source_file, target_name, imported_name, line FROM imp WHERE resolved_file = 3")
def _(spark, d):
    return graph.importers(B.imports(spark, d), 3)


@query("importer_counts", f"WITH {IMPORTS} SELECT resolved_file, count(DISTINCT source_file) AS importers FROM imp GROUP BY 1")
def _(spark, d):
    return graph.importer_counts(B.imports(spark, d))


@query("most_imported", f"WITH {IMPORTS} SELECT resolved_file, count(DISTINCT source_file) AS importers FROM imp GROUP BY 1 ORDER BY importers DESC, resolved_file LIMIT 10")
def _(spark, d):
    return graph.most_imported(B.imports(spark, d))


@query("centrality", f"WITH {IMPORTS} SELECT resolved_file AS file, round(ln(1 + count(DISTINCT source_file)), 6) AS score FROM imp GROUP BY 1")
def _(spark, d):
    return graph.centrality(B.imports(spark, d))


@query("has_importers", f"WITH {IMPORTS} SELECT p_partkey AS file, p_partkey IN (SELECT resolved_file FROM imp) AS has_importers FROM part")
def _(spark, d):
    return graph.has_importers(B.read(spark, d, "part").select(F.col("p_partkey").alias("file")), B.imports(spark, d))


@query("references", f"WITH {IMPORTS} SELECT * FROM imp WHERE imported_name ILIKE '%red b%' OR target_name ILIKE '%red b%'")
def _(spark, d):
    return graph.references(B.imports(spark, d), "red b")


@query("reference_check", f"WITH {IMPORTS}, {SYMBOLS} SELECT *, import_count > 0 OR symbol_count > 0 AS is_referenced FROM (SELECT (SELECT count(*) FROM imp WHERE imported_name ILIKE '%bolt%' OR target_name ILIKE '%bolt%') AS import_count, (SELECT count(*) FROM sym WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', name, qualified_name, signature, summary)), '[a-z0-9]+'), 'bolt')) AS symbol_count)")
def _(spark, d):
    return graph.reference_check(B.imports(spark, d), B.symbols(spark, d), "bolt")


@query("shared_importers", f"WITH {IMPORTS} SELECT b.resolved_file, count(*) AS shared FROM imp a JOIN imp b ON a.source_file = b.source_file WHERE a.resolved_file = 0 AND b.resolved_file <> 0 GROUP BY 1")
def _(spark, d):
    return graph.shared_importers(B.imports(spark, d), 0)


_WHOLE = f"{IMPORTS}, few AS (SELECT source_file, resolved_file FROM imp)"


@query("dependents_depth", f"WITH RECURSIVE {_WHOLE}, r AS (SELECT source_file AS file, 0 AS depth FROM few WHERE resolved_file = 1 UNION SELECT few.source_file, r.depth + 1 FROM few JOIN r ON few.resolved_file = r.file WHERE r.depth < 3) SELECT file, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY file")
def _(spark, d):
    return graph.dependents(B.imports(spark, d), 1, 3)


@query("dead_symbols", f"WITH {_WHOLE}, nm AS (SELECT f.resolved_file AS file, p_name AS name FROM few f JOIN part ON p_partkey = f.resolved_file), {PART_SYMBOLS}, s2 AS (SELECT * FROM sym WHERE name NOT LIKE 'test\\_%' ESCAPE '\\') SELECT id, classification, 'low' AS confidence FROM (SELECT id, 'dead' AS classification FROM s2 WHERE NOT EXISTS (SELECT 1 FROM few WHERE resolved_file = s2.file) UNION ALL SELECT id, 'unreferenced' FROM s2 WHERE EXISTS (SELECT 1 FROM few WHERE resolved_file = s2.file) AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.file = s2.file AND nm.name = s2.name))")
def _(spark, d):
    return graph.dead_symbols(B.part_symbols(spark, d), B.imports(spark, d), limit=None).select("id", "classification", "confidence")


@query("blast_radius", f"WITH RECURSIVE {_WHOLE}, r AS (SELECT source_file AS file, 0 AS depth FROM few WHERE resolved_file = 1 UNION SELECT few.source_file, r.depth + 1 FROM few JOIN r ON few.resolved_file = r.file WHERE r.depth < 1), m AS (SELECT file, min(depth) AS depth FROM r WHERE file <> 1 GROUP BY file ORDER BY depth, file LIMIT 500), c AS (SELECT m.file, m.depth, sum(coalesce(len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda t: t = 'the')), 0)) AS refs FROM m LEFT JOIN documents ON doc_id = m.file GROUP BY m.file, m.depth) SELECT file, CAST(depth AS BIGINT) AS depth, CAST(refs AS BIGINT) AS refs, CASE WHEN refs > 0 THEN 'confirmed' ELSE 'potential' END AS status FROM c")
def _(spark, d):
    return graph.blast_radius(B.imports(spark, d), B.read(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"), 1, "the", 2)


@query("callers", f"WITH {_WHOLE}, {PART_SYMBOLS}, near AS (SELECT * FROM sym WHERE file = 1 OR file IN (SELECT source_file FROM few WHERE resolved_file = 1)) SELECT near.id, CAST(2 AS BIGINT) AS phase FROM near JOIN documents ON doc_id = near.id WHERE near.id <> 1 AND len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda t: t = 'of')) > 0 ORDER BY near.file, line, near.id LIMIT 50")
def _(spark, d):
    s = B.part_symbols(spark, d).withColumn("name", F.when(F.col("id") == 1, "of").otherwise(F.col("name")))
    return graph.callers(s, B.imports(spark, d), B.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), 1).select("id", F.col("phase").cast("long").alias("phase"))


@query("word_counts", f"WITH {FILES} SELECT path, len(list_filter(regexp_split_to_array(content, '[^A-Za-z0-9_]+'), lambda t: t = 'the')) AS refs FROM fil")
def _(spark, d):
    return B.files(spark, d).select("path", T.word_hits(F.col("content"), "the").alias("refs"))


@query("cycles", "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), g AS (SELECT k, c, sum(CASE WHEN before = 'P' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT min(k) AS cycle, count(*) AS length FROM g GROUP BY c, run HAVING count(*) > 1")
def _(spark, d):
    edges = B.edges_sparse(spark, d).select(F.col("a").alias("source_file"), F.col("b").alias("resolved_file"))
    return graph.cycles(edges).select("cycle", "length")


@query("outline_tree", f"WITH {DOC_SYMBOLS} SELECT id, name, kind, line FROM dsy WHERE file = (SELECT min(file) FROM dsy)")
def _(spark, d):
    s = B.doc_symbols(spark, d).withColumn("parent_id", F.lit(None).cast("string"))
    first = s.agg(F.min("file")).first()[0]
    return inspect.outline(s, first).select("id", "name", "kind", "line")


FOREST = "f AS (SELECT DISTINCT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent_id, role FROM conversations)"


@query("hierarchy_children", f"WITH {FOREST} SELECT r.id, count(k.id) AS n_children, coalesce(string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.id), '') AS children FROM (SELECT id FROM f WHERE parent_id IS NULL) r LEFT JOIN f k ON k.parent_id = r.id GROUP BY r.id")
def _(spark, d):
    return inspect.children_of(B.forest(spark, d))


@query("path_tree", f"WITH {FILES}, p AS (SELECT string_split(path, '/') AS p FROM fil), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p) SELECT array_to_string(p[1:i - 1], '/') AS parent, p[i] AS name, bool_and(i = len(p)) AS is_file, count(*) AS files FROM n GROUP BY 1, 2")
def _(spark, d):
    return inspect.path_tree(B.files(spark, d))


@query("stats_languages", f"WITH {FILES} SELECT language, count(*) AS n FROM fil GROUP BY 1")
def _(spark, d):
    return stats.count_by(B.files(spark, d), "language")


@query("stats_dirs", f"WITH {FILES} SELECT string_split(path, '/')[1] || '/' AS folder, count(*) AS n FROM fil GROUP BY 1")
def _(spark, d):
    return stats.files_by_folder(B.files(spark, d))


@query("stats_kinds", f"WITH {SYMBOLS} SELECT kind, language, count(*) AS n FROM sym GROUP BY 1, 2")
def _(spark, d):
    return stats.count_by(B.symbols(spark, d), "kind", "language")


@query("stats_totals", f"WITH {FILES}, {SYMBOLS} SELECT (SELECT count(*) FROM fil) AS files, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM fil) AS bytes, (SELECT count(*) FROM sym) AS symbols")
def _(spark, d):
    return stats.totals(B.files(spark, d), B.symbols(spark, d))


@query("suggest_keywords", f"WITH {DOC_SYMBOLS} SELECT lower(name) AS keyword, count(*) AS n FROM dsy WHERE length(name) > 2 AND lower(name) NOT IN ({', '.join(map(_quoted, stats.STOP_NAMES))}) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20")
def _(spark, d):
    return stats.suggest_keywords(B.doc_symbols(spark, d))


@query("suggest_languages", f"WITH {DOC_SYMBOLS} SELECT language, count(DISTINCT file) AS n FROM dsy GROUP BY 1")
def _(spark, d):
    return stats.files_by_language(B.doc_symbols(spark, d))


@query("file_summaries", f"WITH {DOC_SYMBOLS}, n AS (SELECT file, kind, count(*) AS n FROM dsy GROUP BY 1, 2) SELECT file, string_agg(n || ' ' || kind || CASE WHEN n = 1 THEN '' WHEN ends_with(kind, 's') THEN 'es' ELSE 's' END, ', ' ORDER BY n DESC, kind) AS summary FROM n GROUP BY file")
def _(spark, d):
    return stats.file_summaries(B.doc_symbols(spark, d))


@query("overload_ids", f"WITH {DOC_SYMBOLS}, k AS (SELECT file, line, file || '::' || name || '#' || kind AS p FROM dsy), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY line) - 1 AS n FROM k) SELECT file, line, CASE WHEN n > 0 THEN p || '~' || n ELSE p END AS id FROM r")
def _(spark, d):
    return ingest.with_ids(B.doc_symbols(spark, d).drop("id").withColumns({"qualified_name": F.col("name"), "seq": F.lit(0)})).select("file", "line", "id")


@query("dedup_longest", "SELECT file, line, kind, first(qualified_name ORDER BY length(qualified_name) DESC, seq) AS qualified_name FROM (SELECT p_brand AS file, CAST(p_size AS BIGINT) AS line, p_type AS kind, p_name AS qualified_name, p_partkey AS seq FROM part) GROUP BY 1, 2, 3")
def _(spark, d):
    s = B.symbols(spark, d).select("file", "line", "kind", F.col("name").alias("qualified_name"), F.col("id").alias("seq"))
    return ingest.dedup_longest(s).select("file", "line", "kind", "qualified_name")


@query("keywords", f"WITH {SYMBOLS} SELECT id, array_to_string(list_filter(string_split(lower(name), ' '), lambda x: length(x) > 1), ',') AS keywords FROM sym")
def _(spark, d):
    return B.symbols(spark, d).select("id", F.array_join(T.keywords(F.initcap("name")), ",").alias("keywords"))


@query("summaries", f"WITH {LINES}, j AS (SELECT path, string_agg(trim(text, ' ' || chr(9) || chr(13)), ' ' ORDER BY line) AS t FROM lin WHERE line <= 1 GROUP BY path), s AS (SELECT path, CASE WHEN regexp_extract(t, '^(.*?[.])\\s', 1) <> '' THEN regexp_extract(t, '^(.*?[.])\\s', 1) ELSE t END AS s FROM j) SELECT path, CASE WHEN length(s) > 120 THEN left(s, 117) || '...' ELSE s END AS summary FROM s")
def _(spark, d):
    return B.files(spark, d).where("content is not null").select("path", T.summarize(F.col("content")).alias("summary"))


_SNAP = f"{FILES}, st AS (SELECT CASE doc_id % 7 WHEN 0 THEN path || '.old' ELSE path END AS path, size_bytes AS size, doc_id AS mtime, hash FROM fil), di AS (SELECT CASE doc_id % 11 WHEN 0 THEN path || '.new' ELSE path END AS path, size_bytes AS size, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS mtime, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE hash END AS hash FROM fil)"


def _snapshots(spark, d):
    f = B.files(spark, d).select("path", F.col("size_bytes").alias("size"), F.col("doc_id").alias("mtime"), "hash", "doc_id")
    named = lambda n, end: F.when(F.col("doc_id") % n == 0, F.concat("path", F.lit(end))).otherwise(F.col("path"))
    stored = f.withColumn("path", named(7, ".old")).drop("doc_id")
    listed = f.withColumns({"path": named(11, ".new"), "mtime": F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")), "hash": F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("hash"))}).drop("doc_id")
    return stored, listed


@query("change_detection", f"WITH {_SNAP} SELECT coalesce(st.path, di.path) AS path, CASE WHEN st.path IS NULL THEN 'added' WHEN di.path IS NULL THEN 'deleted' WHEN st.size = di.size AND st.mtime = di.mtime THEN 'unchanged' WHEN st.hash = di.hash THEN 'metadata_changed' ELSE 'changed' END AS change FROM st FULL JOIN di ON st.path = di.path")
def _(spark, d):
    return incremental.detect_changes(*_snapshots(spark, d))


@query("apply_changes", f"WITH {_SNAP}, c AS (SELECT di.path FROM di LEFT JOIN st ON st.path = di.path WHERE st.path IS NULL OR ((st.size <> di.size OR st.mtime <> di.mtime) AND st.hash <> di.hash)) SELECT path, size, mtime, hash FROM st WHERE path IN (SELECT path FROM di) AND path NOT IN (SELECT path FROM c) UNION ALL SELECT path, size, mtime, hash FROM di WHERE path IN (SELECT path FROM c)")
def _(spark, d):
    stored, listed = _snapshots(spark, d)
    return incremental.apply_changes(stored, listed, incremental.detect_changes(stored, listed), "path")


@query("multi_get", f"WITH {SYMBOLS}, i AS (SELECT * FROM (VALUES (0, 7), (1, 999999999), (2, 3)) t(pos, id)) SELECT CAST(i.pos AS BIGINT) AS pos, CAST(i.id AS BIGINT) AS id, name, sym.id IS NOT NULL AS found FROM i LEFT JOIN sym ON sym.id = i.id")
def _(spark, d):
    ids = spark.createDataFrame([(0, 7), (1, 999999999), (2, 3)], "pos long, id long")
    return inspect.by_ids(B.symbols(spark, d), ids).select("pos", "id", "name", "found")


@query("savings_by_tool", "WITH c AS (SELECT event_type AS tool, greatest(0, CAST(floor((CAST(floor(value * 100) AS BIGINT) - CAST(json_extract_string(props, '$.k') AS BIGINT)) / 4) AS BIGINT)) AS s FROM events) SELECT tool, count(*) AS calls, CAST(sum(s) AS BIGINT) AS tokens_saved FROM c WHERE s > 0 GROUP BY tool")
def _(spark, d):
    return stats.savings_by_tool(B.calls(spark, d))
