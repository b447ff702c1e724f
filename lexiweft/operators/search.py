"""Ranked symbol search: candidate gate, integer scorer, bonuses, order, cap, then filters, in that order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_ci, glob_to_regex, is_fallback_summary, path_filter

MOST_QUERY_CHARS = 500
DEFAULT_CAP, MOST_CAP = 50, 200
# The weights of the scorer.
EXACT, IN_NAME, NAME_WORD = 20, 10, 5
IN_SIGNATURE, SIGNATURE_WORD, IN_SUMMARY, SUMMARY_WORD, KEYWORD, DOC_WORD, SEVERAL = 8, 2, 5, 1, 3, 1, 5
CENTRALITY_SHARE = 0.3
EXTENSION_BONUS = {2.0: ["c", "cpp", "cc"], 0.5: ["h", "hpp"], 1.0: ["py", "java", "go", "rs", "php", "rb", "ts", "js", "cs", "swift"]}
TEXT = ["name", "qualified_name", "signature", "summary", "docstring"]


def query_words(query: str) -> list[str]:
    if len(query) > MOST_QUERY_CHARS:
        raise ValueError("query too long")
    return [w for w in re.split(r"[\s_.]+", query.lower()) if w]


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p.cast("int")
    return out


def score_parts(query: str) -> dict[str, Column]:
    """The score of each field, by name; their sum is the score before bonuses."""
    q, words = query.lower(), query_words(query)
    name, qname, signature, summary, doc = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in TEXT)
    kw = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda x: F.lower(x))
    own = F.filter(F.split(name, "[ _.]+"), lambda x: (x != "") & _any([F.contains(x, F.lit(w)) for w in words]))
    fields = F.concat_ws("\n", name, qname, summary, signature, F.concat_ws("\n", kw))
    m = _sum([F.contains(fields, F.lit(w)) for w in words])
    return {
        "s_name": F.when((name == q) | (qname == q), EXACT).when(F.contains(name, F.lit(q)), IN_NAME).otherwise(NAME_WORD * F.size(own)),
        "s_signature": F.when(F.contains(signature, F.lit(q)), IN_SIGNATURE).otherwise(SIGNATURE_WORD * _sum([F.contains(signature, F.lit(w)) for w in words])),
        "s_summary": F.when(F.contains(summary, F.lit(q)), IN_SUMMARY).otherwise(SUMMARY_WORD * _sum([F.contains(summary, F.lit(w)) for w in words])),
        "s_keywords": KEYWORD * F.size(F.filter(kw, lambda x: F.contains(x, F.lit(q)))),
        "s_docstring": DOC_WORD * _sum([F.contains(doc, F.lit(w)) for w in words]),
        "s_several": F.when(F.lit(len(words) >= 2) & (m >= 2), SEVERAL * (m - 1)).otherwise(0),
    }


def threshold(query: str) -> int:
    n = len(query_words(query))
    return 5 if n <= 2 else 5 * ((n + 1) // 2)


def postings(symbols: DataFrame) -> DataFrame:
    """id, token: the word index that the gate reads; write it once, clustered by token."""
    text = F.lower(F.concat_ws(" ", "name", "qualified_name", "signature", "summary"))
    return symbols.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1))).alias("token"))


def gate(symbols: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """Symbols with a token that begins with a word of the query; all of them if the query has no word."""
    words = [w for w in query_words(query) if re.search(r"[^\W_]", w)]
    if not words:
        return symbols
    if index is None:  # the same test on the row, without a join
        tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "qualified_name", "signature", "summary")), F.lit(r"([\p{L}\p{N}]+)"), 1)
        return symbols.where(F.exists(tokens, lambda t: _any([F.startswith(t, F.lit(w)) for w in words])))
    return symbols.join(index.where(_any([F.startswith("token", F.lit(w)) for w in words])).select("id"), "id", "left_semi")


def bonus(file: Column, query: str = "") -> Column:
    """Of the file's extension, in its exact case."""
    ext = F.regexp_extract(F.substring_index(file, "/", -1), r"\.([^.]*)$", 1)
    out = F.lit(0.0)
    for value, names in EXTENSION_BONUS.items():
        out = F.when(ext.isin(*names), value).otherwise(out)
    return out


def search_symbols(symbols: DataFrame, query: str, kinds: list[str] | None = None, language: str | None = None, file_glob: str | None = None, regex: bool = False, use_gate: bool = False, centrality: DataFrame | None = None, index: DataFrame | None = None, cap: int | None = DEFAULT_CAP, file_bonus: bool = False) -> DataFrame:
    """symbols with score (and its parts), best first, at most cap rows (None: all, for counts). Ties go by id.

    file_bonus: with the bonus of the file's extension, in every mode; with centrality it is always there.
    """
    words = query_words(query)
    rows = symbols
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if language:
        rows = rows.where(F.col("language") == language)
    if file_glob:
        rows = rows.where(F.col("file").rlike(glob_to_regex(file_glob, pathname=False)))
    if regex:
        rows = rows.where(_any([contains_ci(F.col(c), query) for c in ("name", "qualified_name", "signature")])).withColumn("score", F.lit(1.0))
    elif not words:
        rows = rows.withColumn("score", F.lit(1.0))
    else:
        if use_gate:
            rows = gate(rows, query, index)
        parts = score_parts(query)
        total = F.lit(0)
        for p in parts:
            total = total + F.col(p)
        rows = rows.withColumns(parts).withColumn("score", total.cast("double")).where(F.col("score") >= threshold(query))
    if centrality is not None:
        rows = rows.join(centrality.select(F.col("file"), F.col("score").alias("_c")), "file", "left")
        rows = rows.withColumn("score", F.round(F.col("score") + F.floor(F.coalesce("_c", F.lit(0.0)) * 1000) / 1000 * CENTRALITY_SHARE, 6)).drop("_c")
    if file_bonus or centrality is not None:
        rows = rows.withColumn("score", F.round(F.col("score") + bonus(F.col("file").cast("string")), 6))
    return rows if cap is None else rows.orderBy(F.desc("score"), "id").limit(min(cap, MOST_CAP))


def refine(found: DataFrame, wanted: str | None = None, unwanted: str | None = None, scope: DataFrame | None = None, unique: bool = False, sort: str = "score", token_budget: int | None = None, limit: int | None = None) -> DataFrame:
    """What follows the cap: path filters, scope (column file), one row a file, line and name, order, budget, limit."""
    rows = found.where(path_filter(F.col("file"), wanted, unwanted))
    if scope is not None:
        rows = rows.join(scope.select("file").distinct(), "file", "left_semi")
    if unique:
        first = Window.partitionBy("file", "line", "name").orderBy(F.desc("score"), "id")
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = {"score": [F.desc("score"), "id"], "name": [F.lower("name"), "id"], "file": ["file", "line", "id"], "kind": ["kind", "name", "id"]}[sort]
    if token_budget is not None:
        # The capped result has at most MOST_CAP rows, so one task holds it.
        used = F.sum(F.coalesce("byte_length", F.lit(100))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumns({"used_bytes": used, "_n": F.row_number().over(Window.orderBy(*order))}).where((F.col("used_bytes") <= 4 * token_budget) | (F.col("_n") == 1)).drop("_n")
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


DETAIL = {"compact": ["id", "name", "kind", "file", "line", "byte_length"]}
DETAIL["standard"] = DETAIL["compact"] + ["qualified_name", "signature", "summary", "score"]


def detail(found: DataFrame, level: str = "standard", contents: DataFrame | None = None) -> DataFrame:
    """compact: what finds the symbol. standard: with what describes it. full: all columns, and with contents the source.

    A qualified name equal to the name, and a summary that only repeats kind and name, are null. contents: file, content BINARY.
    """
    if level == "compact":
        return found.select(DETAIL[level])
    named = found.withColumns({
        "qualified_name": F.when(F.col("qualified_name") != F.col("name"), F.col("qualified_name")),
        "summary": F.when(~is_fallback_summary(F.col("summary"), F.col("kind"), F.col("name")), F.col("summary")),
    })
    if level != "full":
        return named.select(DETAIL["standard"])
    if contents is None:
        return named
    from .inspect import sources

    return sources(named, contents)


def similar_words(name: str, summary: str) -> list[str]:
    """Up to five words of a symbol: parts of its name of three letters or more, then of its summary after the first."""
    parts = [p for p in re.split(r"_+|(?<=[a-z])(?=[A-Z])|\s+", name) if len(p) >= 3]
    return (parts + [w for w in summary.split()[1:] if len(w) >= 4])[:5]


def search_similar(symbols: DataFrame, edges: DataFrame, id: object, limit: int = 20, compat: bool = False) -> DataFrame:
    """Symbols like the one of the given id, of its kind; pairs of shared importers of their files add 1.5 each."""
    target = symbols.where(F.col("id") == F.lit(id)).limit(1).collect()
    if not target:
        return symbols.limit(0).withColumn("score", F.lit(0.0))
    t = target[0]
    words = similar_words(t.name, t.summary or "")
    found = search_symbols(symbols, (" or " if compat else " ").join(words), kinds=[t.kind], cap=limit + 1).where(F.col("id") != F.lit(id))
    from .graph import shared_importers

    shared = shared_importers(edges, t.file).select(F.col("resolved_file").alias("file"), "shared")
    return found.join(shared, "file", "left").withColumn("score", F.col("score") + 1.5 * F.coalesce("shared", F.lit(0))).drop("shared").orderBy(F.desc("score"), "id").limit(limit)


def cooccurrence(symbols: DataFrame, first: str, second: str, language: str | None = None, limit: int = 50) -> DataFrame:
    """Pairs of symbols of one file whose names contain the two words, ordered by file, lines and ids."""
    like = lambda w: F.col("name").ilike(f"%{w}%")
    a = symbols.where(like(first))
    a = a.where(F.col("language") == language) if language else a
    a = a.select("file", F.col("id").alias("id_a"), F.col("name").alias("name_a"), F.col("line").alias("line_a"))
    b = symbols.where(like(second)).select("file", F.col("id").alias("id_b"), F.col("name").alias("name_b"), F.col("line").alias("line_b"))
    return a.join(b, "file").where("id_a <> id_b").orderBy("file", "line_a", "line_b", "id_a", "id_b").limit(limit)
