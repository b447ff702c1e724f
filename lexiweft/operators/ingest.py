"""From extracted tags to the symbols relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def dedup_longest(tags: DataFrame) -> DataFrame:
    """One row a file, line and kind: that of the longest qualified name, the first (by seq) of equals."""
    best = Window.partitionBy("file", "line", "kind").orderBy(F.desc(F.length("qualified_name")), "seq")
    return tags.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def with_ids(tags: DataFrame) -> DataFrame:
    """tags with id; the k-th repeat of an id in the order of lines gets ~k."""
    plain = T.make_id(F.col("file"), F.col("qualified_name"), F.col("kind"))
    repeat = Window.partitionBy("_id").orderBy("line", "seq")
    return tags.withColumn("_id", plain).withColumn("_n", F.row_number().over(repeat) - 1).withColumn("id", F.when(F.col("_n") > 0, F.concat("_id", F.lit("~"), F.col("_n").cast("string"))).otherwise(F.col("_id"))).drop("_id", "_n")


def build_symbols(tags: DataFrame) -> DataFrame:
    """tags (file, name, qualified_name, kind, language, signature, docstring, line, end_line, seq) to symbols."""
    scoped = F.col("qualified_name") != F.col("name")
    kind = T.normalize_kind(F.col("kind"))
    inside = tags.select("file", F.col("qualified_name").alias("_scope"), T.normalize_kind(F.col("kind")).alias("_k")).where(F.col("_k").isin("class", "interface", "trait", "enum")).distinct()
    rows = tags.withColumn("_scope", F.when(scoped, F.regexp_replace("qualified_name", r"\.[^.]*$", ""))).withColumns({"kind": kind, "language": T.normalize_language(F.col("language"))})
    rows = rows.join(inside.groupBy("file", "_scope").agg(F.lit(True).alias("_in")), ["file", "_scope"], "left")
    rows = rows.withColumn("kind", F.when((F.col("kind") == "function") & F.coalesce("_in", F.lit(False)), "method").otherwise(F.col("kind"))).drop("_scope", "_in")
    rows = with_ids(dedup_longest(rows))
    summary = T.summarize(F.coalesce("docstring", F.lit("")))
    return rows.withColumns({"keywords": T.keywords(F.col("qualified_name")), "summary": F.when(summary == "", T.fallback_summary(F.col("kind"), F.col("name"))).otherwise(summary), "decorators": F.array().cast("array<string>")})
