"""Inspection: outlines, source slices, trees, hierarchies, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

MINOR_KINDS = ["variable", "constant"]
CLASS_KINDS = ["class", "interface", "trait", "enum", "type", "namespace"]
MOST_BUNDLE, MOST_SOURCE_CONTEXT = 20, 50
# How import lines begin, by language.
IMPORT_LINES = {
    "python": ["import ", "from "], "javascript": ["import ", "const ", "require("], "typescript": ["import ", "export "], "go": ["import ", "\t\""], "rust": ["use ", "mod ", "extern crate "], "c": ["#include"], "cpp": ["#include"],
    "java": ["import "], "kotlin": ["import "], "scala": ["import "], "php": ["use ", "require", "include"], "ruby": ["require", "load "], "csharp": ["using "], "swift": ["import "], "haskell": ["import "],
    "julia": ["using ", "import "], "gleam": ["import "], "dart": ["import "], "elixir": ["import ", "alias ", "use "], "lua": ["require", "local "],
}


def outline(symbols: DataFrame, file: object, kinds: list[str] | str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols of a file by line, with the depth-0 or -1 place in its tree. kinds: None leaves minor ones out, "*" takes all."""
    rows = symbols.where(F.col("file") == F.lit(file))
    rows = rows.where(~F.col("kind").isin(*MINOR_KINDS)) if kinds is None else rows if kinds == "*" else rows.where(F.col("kind").isin(*kinds))
    known = rows.select(F.col("id").alias("parent_id"), F.lit(1).alias("_has"))
    # Orphans become roots.
    rows = rows.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("_has") == 1, F.col("parent_id"))).drop("_has").orderBy("line", "id")
    return rows.limit(limit) if limit else rows


def by_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (pos, id) with the symbol's columns, and found; input order is kept by pos."""
    return ids.join(symbols.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def sources(symbols: DataFrame, contents: DataFrame, verify: bool = False) -> DataFrame:
    """symbols with source, the slice of bytes, and, to verify, whether its hash is the stored one. contents: file, content BINARY."""
    out = symbols.join(contents, "file").withColumn("source", F.expr("cast(substring(content, cast(byte_offset + 1 as int), cast(byte_length as int)) as string)")).drop("content")
    return out.withColumn("verified", F.sha2(F.col("source").cast("binary"), 256) == F.col("content_hash")) if verify else out


def source_lines(symbols: DataFrame, contents: DataFrame, context: int = 0) -> DataFrame:
    """symbols with source: their lines, and context lines on either side."""
    context = min(context, MOST_SOURCE_CONTEXT)
    first = F.greatest(F.col("line") - context, F.lit(1)).cast("int")
    lines = F.split(F.col("content").cast("string"), "\n")
    return symbols.join(contents, "file").withColumn("source", F.array_join(F.slice(lines, first, (F.col("end_line") + context - first + 1).cast("int")), "\n")).drop("content")


def path_tree(files: DataFrame, depth: int | None = None, language: str | None = None) -> DataFrame:
    """parent, name, is_file, files: the trie of paths; deeper than depth, folders are not opened."""
    rows = files.where(F.col("language") == language) if language else files
    parts = F.split("path", "/")
    rows = rows.select(parts.alias("p"))
    last = F.size("p") if depth is None else F.least(F.size("p"), F.lit(depth + 1))
    nodes = rows.select("p", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    return nodes.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "/").alias("parent"), F.get("p", F.col("i") - 1).alias("name")).agg(F.bool_and(F.col("i") == F.size("p")).alias("is_file"), F.count("*").alias("files"))


def hierarchy(symbols: DataFrame, file: object = None, language: str | None = None, limit: int = 200) -> DataFrame:
    """Roots with one level of children: of a file, or class-like ones of a language. children: ordered array of structs."""
    rows = symbols.where(F.col("file") == F.lit(file)) if file is not None else symbols.where(F.col("kind").isin(*CLASS_KINDS))
    rows = rows.where(F.col("language") == language) if language else rows
    roots = rows.where(F.col("parent_id").isNull()).orderBy("file", "line", "id").limit(limit)
    kids = symbols.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"), F.struct("line", F.col("id").alias("child"), "name", "kind").alias("k"))
    own = kids.join(roots.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("children"))
    return roots.join(own, "id", "left").withColumn("children", F.coalesce("children", F.array().cast(own.schema["children"].dataType)))


def children_of(forest: DataFrame) -> DataFrame:
    """id, parent_id pairs to id, n_children, children (ordered ids, comma-joined)."""
    own = forest.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("children"))
    return forest.where("parent_id is null").select("id").join(own, "id", "left").select("id", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("children", F.lit("")).alias("children"))


def import_lines(lines: DataFrame, languages: DataFrame) -> DataFrame:
    """Lines (path, line, text) that import, by how import lines begin in the file's language (path, language)."""
    starts = F.create_map(*[x for k, v in IMPORT_LINES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return lines.join(languages, "path").where(F.exists(F.coalesce(starts[F.col("language")], F.array().cast("array<string>")), lambda s: F.startswith(F.col("text"), s))).select("path", "line", "text")


def bundle(symbols: DataFrame, contents: DataFrame, edges: DataFrame, ids: list, full: bool = False) -> DataFrame:
    """A row a symbol: its columns, source, imports, outline of siblings, and, if full, importers."""
    ids = list(dict.fromkeys(ids))[:MOST_BUNDLE]
    own = source_lines(symbols.where(F.col("id").isin(*ids)), contents)
    files = own.select("file").distinct()
    around = symbols.where(~F.col("kind").isin(*MINOR_KINDS)).join(files, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("outline"))
    imports = edges.select(F.col("source_file").alias("file"), "target_name").join(files, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set("target_name")).alias("imports"))
    out = own.join(around, "file", "left").join(imports, "file", "left")
    if full:
        back = graph.resolved(edges).select(F.col("resolved_file").alias("file"), "source_file").join(files, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set("source_file")).alias("importers"))
        out = out.join(back, "file", "left")
    return out
