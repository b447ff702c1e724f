"""Project statistics and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that say nothing.
STOP_NAMES = (
    "self this ctx err error argv argc ptr len buf ret tmp key value name type size data result status config options args kwargs index count str msg val obj res req cmd fmt null nil true false none new get set "
    "__construct __destruct __call __get __set __isset __unset __tostring __invoke up down run boot register handle fillable casts rules messages setup teardown test invoke tostring "
    "default export import module require constructor prototype undefined"
).split()
STALE_DAYS = 7


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def top_folder(path: Column) -> Column:
    """Up to the first slash, with it; a path without one is its own."""
    return F.when(F.instr(path, "/") > 0, F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise(path)


def files_by_folder(files: DataFrame) -> DataFrame:
    return files.groupBy(top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))


def totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    one = files.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    return one.join(F.broadcast(symbols.agg(F.count("*").alias("symbols"))), F.lit(True))  # one row each


def suggest_keywords(symbols: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent names of over two letters that say something."""
    low = F.lower("name").alias("keyword")
    return symbols.select(low).where((F.length("keyword") > 2) & ~F.col("keyword").isin(*STOP_NAMES)).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(limit)


def files_by_language(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("language").agg(F.count_distinct("file").alias("n"))


def file_summaries(symbols: DataFrame) -> DataFrame:
    """file, summary: "3 methods, 1 class", the most frequent kinds first."""
    n = count_by(symbols, "file", "kind")
    plural = F.concat(F.col("kind"), F.when(F.col("n") == 1, "").when(F.col("kind").endswith("s"), "es").otherwise("s"))
    part = F.struct((-F.col("n")).alias("o"), F.col("kind"), F.concat(F.col("n").cast("string"), F.lit(" "), plural).alias("t"))
    return n.select("file", part.alias("p")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), ", ").alias("summary"))


def age_warning(metadata: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """metadata with age_days and stale. metadata: project, indexed_at (RFC 3339)."""
    age = F.datediff(F.current_date(), F.to_date(F.to_timestamp("indexed_at")))
    return metadata.withColumn("age_days", age).withColumn("stale", F.col("age_days") >= days)


def projects(metadata: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row a project: counts, size, first eight characters of the commit, newest index first. files and symbols have project."""
    f = files.groupBy("project").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    s = symbols.groupBy("project").agg(F.count("*").alias("symbols"))
    return age_warning(metadata).join(f, "project", "left").join(s, "project", "left").withColumn("git_head", F.left("git_head", F.lit(8))).orderBy(F.desc("indexed_at"), "project")


def savings_tokens(raw_bytes: Column, response_bytes: Column) -> Column:
    """Tokens (four bytes) that a response saves against the files it stands for."""
    return F.greatest(F.lit(0).cast("long"), F.expr("0L") + F.floor((raw_bytes - response_bytes) / 4))


def savings_by_tool(calls: DataFrame) -> DataFrame:
    """tool, calls, tokens_saved over the calls that save something. calls: tool, raw_bytes, response_bytes."""
    saved = calls.select("tool", savings_tokens(F.col("raw_bytes"), F.col("response_bytes")).alias("saved")).where("saved > 0")
    return saved.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("saved").alias("tokens_saved"))
