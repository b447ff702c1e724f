"""The driver's tables seen as files, symbols, imports, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> F.Column:
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(doc_path().alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("text").alias("content"), "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.textsearch import lines_of

    return lines_of(files(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.col("p_type").alias("signature"), F.concat("p_type", F.lit(" "), "p_name").alias("summary"),
        F.lit("").alias("docstring"), F.split("p_name", " ").alias("keywords"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("line"), F.col("p_type").alias("kind"), F.lower("p_type").alias("language"), (F.col("p_size") * 10).cast("long").alias("byte_length"),
    )


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose file is the part itself, as the imports have it."""
    return symbols(spark, sf_dir).withColumn("file", F.col("id"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each part to the next of the same order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_file"), F.lead("l_partkey").over(order).alias("resolved_file")).where("resolved_file is not null and source_file <> resolved_file").distinct()
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("resolved_file"), F.col("p_name").alias("imported_name"), F.col("p_brand").alias("target_name"))
    return pairs.join(names, "resolved_file").select("source_file", "resolved_file", "imported_name", "target_name", F.lit(0).cast("long").alias("line"))


def edges_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, one to the next; and back where the order is pending."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    step = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(order).alias("b"), "o_orderstatus").where("b is not null")
    return step.select("a", "b").unionByName(step.where("o_orderstatus = 'P'").select(F.col("b").alias("a"), F.col("a").alias("b")))


def doc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a capitalized ASCII word."""
    word = F.regexp_extract("text", "^([A-Z][a-z]+)", 1)
    return lines(spark, sf_dir).select(F.col("path").alias("file"), "line", word.alias("name"), F.octet_length("text").cast("long").alias("bytes")).where("name <> ''").withColumns({"kind": F.when(F.length("name") > 4, "class").otherwise("function"), "id": F.concat("file", F.lit(":"), F.col("line").cast("string")), "language": F.element_at(F.split("file", "/"), 2)})


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations; a turn's parent is the first of its conversation."""
    c = read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"), "role").distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("tool"), F.floor(F.col("value") * 100).alias("raw_bytes"), F.get_json_object("props", "$.k").cast("long").alias("response_bytes"), "ts")


#: Extensions that the documents get as files of a source tree, by doc_id.
TREE_EXTENSIONS = [".py", ".ts", ".js", ".c", ""]


def by_id(*values) -> F.Column:
    """One of the values for each document, in turn."""
    return F.array(*[v if isinstance(v, F.Column) else F.lit(v) for v in values])[(F.col("doc_id") % len(values)).cast("int")]


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a source tree: path with an extension, content, doc_id, source, lang."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), by_id(*TREE_EXTENSIONS))
    return read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", name).alias("path"), F.col("text").alias("content"), "doc_id", "source", "lang")


def tree_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of the next file of the folder from each one, spelled in eight ways in turn."""
    folder = Window.partitionBy("source", "lang").orderBy("doc_id")
    t = tree(spark, sf_dir).withColumns({"next": F.lead("path").over(folder), "k": F.concat(F.lit("d"), F.lead("doc_id").over(folder).cast("string"))}).where("k is not null")
    spelled = by_id(F.col("next"), F.concat(F.lit("./"), "k"), F.concat(F.lit("../"), "lang", F.lit("/"), "k"), F.concat_ws(".", "source", "lang", "k"), F.col("k"), F.concat_ws(".", F.lit("pkg"), "lang", "k"), "vendor/unknown", F.col("next"))
    return t.select(F.col("doc_id").alias("import_id"), F.col("path").alias("source_file"), spelled.alias("target_name"), by_id(*["import"] * 7, "system_include").alias("import_type"), F.lit("").alias("language"))


def tree_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each file, named by its language; every other one has a summary that says no more than that."""
    summary = by_id(F.concat(F.lit("Class "), "lang"), F.concat(F.lit("document of "), "source"))
    return tree(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.concat("lang", F.lit(".d"), F.col("doc_id").cast("string")).alias("qualified_name"), F.lit("").alias("signature"), summary.alias("summary"), F.lit("").alias("docstring"), F.array("lang").alias("keywords"), F.col("path").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("class").alias("kind"), F.col("lang").alias("language"), F.lit(100).cast("long").alias("byte_length"))


#: A source text for each extension of the tree; K stands for the document's id.
SAMPLES = [
    'class CK:\n    """Holds. More."""\n    def run(self):\n        return 1\n\ndef go():\n    pass',
    "import { aK } from './mK';\n/** Draws it. */\nclass WK {\n  // none\n}\nfunction fK() {\n  return '}';\n}",
    "const z = require('qK');\nfunction gK(x) {\n  if (x) { return `}`; }\n}",
    '#include <stdio.h>\n#include "hK.h"\n#define SIZE 4\nstruct sK {\n  int a;\n};',
    "no code, K",
]


def sample_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content: the tree with these texts."""
    text = F.replace(by_id(*SAMPLES), F.lit("K"), F.col("doc_id").cast("string"))
    return tree(spark, sf_dir).select("path", by_id("python", "typescript", "javascript", "c", "unknown").alias("language"), text.alias("content"))
