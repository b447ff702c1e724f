"""Text search over the lines of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import check_regex, clip, glob_to_regex, path_filter

DEFAULT_HITS, MOST_HITS, MOST_CONTEXT = 100, 500, 10


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 1), text: a trailing newline gives a last, empty line. files: path, content."""
    return files.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n", -1)).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "text")


def matches(text: Column, query: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Any of the literals separated by |, or one regular expression."""
    if regex:
        if why := check_regex(query):
            raise ValueError(f"regular expression refused: {why}")
        return text.rlike(query if case_sensitive else f"(?i){query}")
    out = F.lit(False)
    for part in (p.strip() for p in query.split("|")):
        if part:
            out = out | (F.contains(text, F.lit(part)) if case_sensitive else F.contains(F.lower(text), F.lit(part.lower())))
    return out


def text_search(lines: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, file_glob: str | None = None, wanted: str | None = None, unwanted: str | None = None, most: int = DEFAULT_HITS) -> DataFrame:
    """path, line, text of the first hits in the order of path and line."""
    rows = lines.where(F.col("path").rlike(glob_to_regex(file_glob))) if file_glob else lines
    rows = rows.where(path_filter(F.col("path"), wanted, unwanted)).where(matches(F.col("text"), query, regex, case_sensitive))
    return rows.orderBy("path", "line").limit(min(most, MOST_HITS)).select("path", "line", clip(F.col("text")).alias("text"))


def with_context(hits: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """hits with before and after: up to n lines on either side, clipped at the file's ends.

    Hits are few; their neighbours are looked up by path and line, so no file is gathered whole.
    """
    n = max(0, min(n, MOST_CONTEXT))
    if n == 0:
        none = F.array().cast("array<string>")
        return hits.withColumns({"before": none, "after": none})
    near = hits.select("path", F.col("line").alias("hit"), F.explode(F.sequence(F.col("line") - n, F.col("line") + n)).alias("line")).where("line <> hit")
    found = lines.join(near, ["path", "line"]).groupBy("path", "hit").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("near"))
    side = lambda keep: F.transform(F.filter("near", keep), lambda x: x["text"])
    out = hits.join(found.withColumnRenamed("hit", "line"), ["path", "line"], "left")
    empty = F.array().cast("array<string>")
    return out.select("path", "line", "text", F.coalesce(side(lambda x: x["line"] < F.col("line")), empty).alias("before"), F.coalesce(side(lambda x: x["line"] > F.col("line")), empty).alias("after"))


def grouped(hits: DataFrame) -> DataFrame:
    """Hits of each file among the (capped) hits, most first."""
    return hits.groupBy("path").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "path")


def count_hits(lines: DataFrame, query: str, **options) -> DataFrame:
    return lines.where(matches(F.col("text"), query, **options)).agg(F.count("*").alias("hits"))


def file_slice(lines: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Lines first to last of one file; the end is clamped."""
    if first > last or first < 1:
        raise ValueError("bad range")
    return lines.where((F.col("path") == path) & F.col("line").between(first, last)).orderBy("line")


def line_offsets(lines: DataFrame) -> DataFrame:
    """path, line, byte_offset, byte_length of each line with its newline."""
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    size = (F.octet_length("text") + 1).cast("long")
    return lines.select("path", "line", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("byte_offset"), size.alias("byte_length"))
