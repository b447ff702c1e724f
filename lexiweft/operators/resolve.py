"""Import resolution: specifiers to files by a chain of lookups, the first hit of which wins.

All candidate keys of an import are made at once, with their priority; three equi-joins against unambiguous lookup tables
and one aggregate then find the best. A key that several files share leads nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname

# Extensions in the order in which they are tried, and index files.
EXTENSIONS = [".blade.php", ".html.twig", ".php", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".vue", ".py", ".java", ".kt", ".scala", ".rb", ".go", ".rs", ".cs", ".swift", ".hs", ".c", ".h", ".cpp", ".hpp", ".cc"]
INDEX_FILES = ["/index.ts", "/index.js", "/index.tsx", "/index.jsx", "/index.py"]


def _suffixes(path: Column) -> Column:
    """a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.array(parts), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/")))[0]


def _unambiguous(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().groupBy("key").agg(F.count("*").alias("n"), F.first("path").alias("path")).where("n = 1").select("key", "path")


def lookup_tables(files: DataFrame) -> DataFrame:
    """map (exact, suffix, dir), key, path. Only keys of one file."""
    low = F.lower("path")
    exact = files.select(F.col("path").alias("key"), "path")
    bare = F.regexp_replace(low, r"(?<=[^/])\.[^./]*$", "")
    suffix = files.select(F.explode(F.array_distinct(F.concat(_suffixes(low), _suffixes(bare)))).alias("key"), "path")
    folder = files.where(F.instr("path", "/") > 0).select(F.explode(_suffixes(F.lower(dirname(F.col("path"))))).alias("key"), "path")
    tables = [("exact", exact), ("suffix", suffix), ("dir", folder)]
    out = None
    for name, t in tables:
        t = _unambiguous(t).select(F.lit(name).alias("map"), "key", "path")
        out = t if out is None else out.unionByName(t)
    return out


def _collapse(path: Column) -> Column:
    """Resolve . and .. parts."""
    return F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/"
    )


def candidates(imports: DataFrame) -> DataFrame:
    """imports (with import_id) exploded to prio, map, key."""
    t, source = F.col("target_name"), F.col("source_file")
    folder = dirname(source)
    here = F.when(folder == "", t).otherwise(F.concat(folder, F.lit("/"), t))
    relative = _collapse(here)
    slashed = F.regexp_replace(F.regexp_replace(t, r"\\", "/"), "::", "/")
    normal = F.lower(F.when(F.contains(t, F.lit("/")), slashed).otherwise(F.regexp_replace(slashed, r"\.", "/")))
    is_relative = t.startswith("./") | t.startswith("../")
    plain = ~t.rlike(r"[/\\]")

    def step(prio: int, name: str, key: Column, ends: list[str]) -> Column:
        return F.array(*[F.struct(F.lit(prio * 1000 + i).alias("prio"), F.lit(name).alias("map"), F.concat(key, F.lit(e)).alias("key")) for i, e in enumerate(ends)])

    def stripped(prio: int, name: str, key: Column, ends: list[str]) -> Column:
        """Leading parts taken off one after another."""
        return F.flatten(F.transform(F.slice(_suffixes(key), F.lit(2), F.greatest(F.size(_suffixes(key)) - 1, F.lit(0))), lambda s, i: F.array(*[F.struct((F.lit(prio * 1000) + i * 50 + k).alias("prio"), F.lit(name).alias("map"), F.concat(s, F.lit(e)).alias("key")) for k, e in enumerate(ends)])))

    none = F.array().cast("array<struct<prio:int,map:string,key:string>>")
    tries = F.concat(
        step(1, "exact", t, [""]),
        F.when(is_relative, step(2, "exact", relative, ["", *EXTENSIONS, *INDEX_FILES])).otherwise(none),
        F.when(plain, step(3, "exact", here, ["", *EXTENSIONS])).otherwise(none),
        F.when(~is_relative, F.concat(step(4, "suffix", normal, ["", *EXTENSIONS, "/__init__.py"]), stripped(5, "suffix", normal, ["", *EXTENSIONS]), step(95, "dir", F.lower(t), [""]), step(96, "dir", normal, [""]), stripped(97, "dir", normal, [""]))).otherwise(none),
    )
    return imports.select("import_id", "source_file", F.explode(tries).alias("c")).select("import_id", "source_file", "c.*")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with resolved_file ('' where nothing is found). imports: import_id, source_file, target_name, import_type, language."""
    standard = (F.col("import_type") == "system_include") | ((F.col("language") == "go") & ~F.contains("target_name", F.lit("/")) & ~F.contains("target_name", F.lit(".")))
    open_ones = imports.where(~F.coalesce(standard, F.lit(False)))
    hits = candidates(open_ones).join(lookup_tables(files), ["map", "key"])
    best = hits.groupBy("import_id", "source_file").agg(F.min_by("path", F.struct("prio", "path")).alias("path")).where("path <> source_file").select("import_id", F.col("path").alias("resolved_file"))
    return imports.drop("resolved_file").join(best, "import_id", "left").withColumn("resolved_file", F.coalesce("resolved_file", F.lit("")))
