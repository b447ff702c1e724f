"""Keeping an index up to date: change detection, and applying changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import resolve_imports

#: Beyond this share of affected files a full rebuild is cheaper.
MOST_INCREMENTAL = 0.10


def detect_changes(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """path, change: added, deleted, unchanged, metadata_changed or changed.

    Both have path, size, mtime, hash; the listing's hash only counts where size or time differ, and may be null
    (unreadable: changed).
    """
    s, d = stored.alias("s"), listing.alias("d")
    same = (F.col("s.size") == F.col("d.size")) & (F.col("s.mtime") == F.col("d.mtime"))
    change = (
        F.when(F.col("s.path").isNull(), "added")
        .when(F.col("d.path").isNull(), "deleted")
        .when(same, "unchanged")
        .when(F.col("s.hash") == F.col("d.hash"), "metadata_changed")
        .otherwise("changed")
    )
    return s.join(d, F.col("s.path") == F.col("d.path"), "full_outer").select(F.coalesce("s.path", "d.path").alias("path"), change.alias("change"))


def plan_update(changes: DataFrame) -> DataFrame:
    """One row: affected, discovered, mode (none, incremental or rebuild)."""
    counts = changes.agg(F.count_if(F.col("change").isin("added", "changed", "deleted")).alias("affected"), F.count_if(F.col("change") != "deleted").alias("discovered"))
    return counts.withColumn("mode", F.when(F.col("affected") == 0, "none").when(F.col("affected") <= F.floor(F.col("discovered") * MOST_INCREMENTAL), "incremental").otherwise("rebuild"))


def apply_changes(table: DataFrame, fresh: DataFrame, changes: DataFrame, file: str = "file") -> DataFrame:
    """table without the rows of deleted and changed files, and with those of fresh (of added and changed ones)."""
    gone = changes.where(F.col("change").isin("deleted", "changed")).select(F.col("path").alias(file))
    come = changes.where(F.col("change").isin("added", "changed")).select(F.col("path").alias(file))
    return table.join(gone, file, "left_anti").unionByName(fresh.join(come, file, "left_semi").select(*table.columns))


def upsert(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The last writer wins."""
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], paths: DataFrame) -> dict[str, DataFrame]:
    """All the tables, each given with its column of paths, without the rows of the files in paths (column path)."""
    gone = paths.select("path").distinct()
    return {name: table.join(gone.withColumnRenamed("path", column), column, "left_anti").select(table.columns) for name, (table, column) in tables.items()}


def set_metadata(metadata: DataFrame, values: DataFrame) -> DataFrame:
    """metadata (project, key, value) with values over it; a null value takes the key away."""
    return metadata.join(values.select("project", "key"), ["project", "key"], "left_anti").unionByName(values.where("value is not null"))


def update_summaries(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """files with the summaries (path, summary) where there are any."""
    fresh = summaries.select("path", F.col("summary").alias("_fresh"))
    return files.join(fresh, "path", "left").withColumn("summary", F.coalesce("_fresh", "summary")).select(files.columns)


def reindex_file(files: DataFrame, symbols: DataFrame, imports: DataFrame, one: DataFrame, its_symbols: DataFrame, its_imports: DataFrame) -> tuple[bool, DataFrame, DataFrame, DataFrame]:
    """(changed, files, symbols, imports) after one file (a row of files) is indexed again; the same hash changes nothing.

    The file's rows are replaced, and all imports that lead to it, come from it or led nowhere are resolved again.
    """
    path, hash_ = one.select("path", "hash").first()
    if files.where((F.col("path") == path) & (F.col("hash") == hash_)).limit(1).count():
        return False, files, symbols, imports
    place = one.select("path")
    left = delete_cascade({"files": (files, "path"), "symbols": (symbols, "file"), "imports": (imports, "source_file")}, place)
    files = left["files"].unionByName(one.select(files.columns))
    rows = left["imports"].unionByName(its_imports.withColumn("resolved_file", F.lit("")).select(imports.columns))
    again = (F.col("source_file") == path) | F.col("resolved_file").isin("", path)
    return True, files, left["symbols"].unionByName(its_symbols.select(symbols.columns)), rows.where(~again).unionByName(resolve_imports(rows.where(again), files).select(imports.columns))


def stale_heads(metadata: DataFrame, heads: DataFrame) -> DataFrame:
    """project, stale: whether the commit now checked out (heads: project, head) is another than the indexed git_head.

    Without a commit on either side nothing is known, and the project isn't stale.
    """
    return metadata.join(heads, "project", "left").select("project", F.coalesce(F.col("head") != F.col("git_head"), F.lit(False)).alias("stale"))


def update_times(files: DataFrame, listing: DataFrame, changes: DataFrame) -> DataFrame:
    """files with size and mtime of the listing where only these changed."""
    touched = changes.where("change = 'metadata_changed'").select("path").join(listing.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime")), "path")
    return files.join(touched, "path", "left").withColumns({"size": F.coalesce("_size", "size"), "mtime": F.coalesce("_mtime", "mtime")}).drop("_size", "_mtime")


def stale_sample(files: DataFrame, listing: DataFrame, indexed_at: int, n: int = 10, seed: int = 0) -> DataFrame:
    """Of n random files, those changed since indexing (seconds)."""
    return files.select("path").orderBy(F.rand(seed)).limit(n).join(listing.select("path", "mtime"), "path").where(F.col("mtime") > indexed_at)
