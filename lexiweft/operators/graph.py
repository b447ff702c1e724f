"""The import graph. edges: source_file, target_name, resolved_file ('' if unresolved), imported_name, line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from ..functions.text import confidence, dirname, is_entry_point, is_test_file, path_filter, word_hits

MOST_DEPTH, MOST_BLAST_DEPTH, MOST_BLAST_FILES = 10, 3, 500


def resolved(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("resolved_file").cast("string") != "")


def importers(edges: DataFrame, file: object) -> DataFrame:
    """The files that import one, each with its first import of it."""
    hit = edges.where(F.col("resolved_file") == F.lit(file))
    first = F.min(F.struct("line", "target_name", "imported_name"))
    return hit.groupBy("source_file").agg(first.alias("f")).select("source_file", "f.target_name", "f.imported_name", "f.line").orderBy("source_file")


def importer_counts(edges: DataFrame) -> DataFrame:
    return resolved(edges).groupBy("resolved_file").agg(F.count_distinct("source_file").alias("importers"))


def most_imported(edges: DataFrame, limit: int = 10) -> DataFrame:
    return importer_counts(edges).orderBy(F.desc("importers"), "resolved_file").limit(limit)


def centrality(edges: DataFrame) -> DataFrame:
    """file, score = ln(1 + importers)."""
    return importer_counts(edges).select(F.col("resolved_file").alias("file"), F.round(F.log1p("importers"), 6).alias("score"))


def has_importers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files with has_importers."""
    known = resolved(edges).select(F.col("resolved_file").alias("file")).distinct().withColumn("has_importers", F.lit(True))
    return files.join(known, "file", "left").withColumn("has_importers", F.coalesce("has_importers", F.lit(False)))


def imports_of(edges: DataFrame, file: object) -> DataFrame:
    return resolved(edges).where(F.col("source_file") == F.lit(file)).select("resolved_file").distinct()


def references(edges: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Imports whose imported name or specifier contains the text; % and _ are wildcards."""
    hit = edges.where(F.col("imported_name").ilike(f"%{name}%") | F.col("target_name").ilike(f"%{name}%")).orderBy("source_file", "resolved_file", "line")
    return hit.limit(limit) if limit else hit


def reference_check(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """import_count, symbol_count, is_referenced: one row."""
    word = name.lower()
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "qualified_name", "signature", "summary")), F.lit(r"([\p{L}\p{N}]+)"), 1)
    a = references(edges, name).agg(F.count("*").alias("import_count"))
    b = symbols.where(F.array_contains(tokens, word)).agg(F.count("*").alias("symbol_count"))
    counts = a.select(F.col("import_count"), F.lit(0).cast("long").alias("symbol_count")).union(b.select(F.lit(0).cast("long"), "symbol_count"))
    return counts.agg(F.sum("import_count").alias("import_count"), F.sum("symbol_count").alias("symbol_count")).withColumn("is_referenced", F.expr("import_count > 0 or symbol_count > 0"))


def scope_files(edges: DataFrame, imports_of_file: object = None, importers_of_file: object = None) -> DataFrame:
    """file: what a file imports, or what imports it, and itself."""
    if (imports_of_file is None) == (importers_of_file is None):
        raise ValueError("one of the two scopes must be given")
    spark = edges.sparkSession
    if imports_of_file is not None:
        found, own = imports_of(edges, imports_of_file).select(F.col("resolved_file").alias("file")), imports_of_file
    else:
        found, own = resolved(edges).where(F.col("resolved_file") == F.lit(importers_of_file)).select(F.col("source_file").alias("file")), importers_of_file
    return found.union(spark.range(1).select(F.lit(own).alias("file"))).distinct()


def shared_importers(edges: DataFrame, file: object) -> DataFrame:
    """resolved_file, shared: pairs of imports by a common importer. Counted per importer first, so no pairs are made."""
    mine = edges.where(F.col("resolved_file") == F.lit(file)).groupBy("source_file").agg(F.count("*").alias("a"))
    theirs = resolved(edges).where(F.col("resolved_file") != F.lit(file)).groupBy("source_file", "resolved_file").agg(F.count("*").alias("b"))
    return theirs.join(mine, "source_file").groupBy("resolved_file").agg(F.sum(F.col("a") * F.col("b")).alias("shared"))


def dependents(edges: DataFrame, file: object, depth: int = 3, most_files: int | None = None) -> DataFrame:
    """file, depth: all that reach the file by imports, direct importers at depth 0, at most depth + 1 hops.

    A frontier a round, of new files only. A frontier is joined, not collected, so it may be of any size.
    """
    back = materialize(resolved(edges).select("source_file", "resolved_file").distinct(), "edges")
    start = back.where(F.col("resolved_file") == F.lit(file)).select(F.col("source_file").alias("file")).distinct().withColumn("depth", F.lit(0).cast("long"))
    seen = frontier = materialize(start, "frontier")
    for d in range(1, min(depth, MOST_DEPTH) + 1):
        if frontier.limit(1).count() == 0 or most_files is not None and seen.count() >= most_files:
            break
        step = back.join(frontier.select(F.col("file").alias("resolved_file")), "resolved_file").select(F.col("source_file").alias("file")).distinct()
        frontier = materialize(step.join(seen, "file", "left_anti").withColumn("depth", F.lit(d).cast("long")), "frontier")
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "file")


def dead_symbols(symbols: DataFrame, edges: DataFrame, kinds: list[str] | None = None, language: str | None = None, wanted: str | None = None, unwanted: str | None = None, exclude_tests: bool = False, limit: int | None = 100) -> DataFrame:
    """Symbols of files that nothing imports (dead), and of imported files that no import names (unreferenced)."""
    used = resolved(edges)
    files = used.select(F.col("resolved_file").alias("file")).distinct()
    names = used.select(F.col("resolved_file").alias("file"), F.col("imported_name").alias("name")).distinct()
    rows = symbols.where(~is_entry_point(F.col("name"))).where(path_filter(F.col("file"), wanted, unwanted))
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    rows = rows.where(F.col("language") == language) if language else rows
    rows = rows.where(~is_test_file(F.col("file"))) if exclude_tests else rows
    dead = rows.join(files, "file", "left_anti").withColumn("classification", F.lit("dead"))
    unnamed = rows.join(files, "file", "left_semi").join(names, ["file", "name"], "left_anti").withColumn("classification", F.lit("unreferenced"))
    out = dead.unionByName(unnamed).withColumn("confidence", confidence(F.col("language"))).orderBy("classification", "file", "line", "id")
    return out.limit(limit) if limit else out


def callers(symbols: DataFrame, edges: DataFrame, bodies: DataFrame, id: object, limit: int = 50) -> DataFrame:
    """Symbols in the target's file and its importers that name it: first in the signature, then in the body.

    bodies: id, body.
    """
    target = symbols.where(F.col("id") == F.lit(id)).limit(1).collect()
    if not target:
        return symbols.limit(0).withColumn("phase", F.lit(1))
    t = target[0]
    near = symbols.join(scope_files(edges, importers_of_file=t.file), "file", "left_semi")
    first = near.where(F.col("signature").ilike(f"%{t.name}%")).orderBy("file", "line", "id").limit(limit).withColumn("phase", F.lit(1))
    out = first
    if len(t.name) >= 2:
        body = near.where(F.col("id") != F.lit(id)).join(first.select("id"), "id", "left_anti").join(bodies, "id").where(word_hits(F.col("body"), t.name) > 0).drop("body")
        out = first.unionByName(body.select(*near.columns).withColumn("phase", F.lit(2)))
    return out.orderBy("phase", "file", "line", "id").limit(limit)


def blast_radius(edges: DataFrame, contents: DataFrame, file: object, name: str, depth: int = 2) -> DataFrame:
    """file, depth, refs, status: what reaches the file, confirmed where its text has the name as a word. contents: file, text."""
    reach = dependents(edges, file, min(depth, MOST_BLAST_DEPTH) - 1, MOST_BLAST_FILES).where(F.col("file") != F.lit(file))
    reach = reach.orderBy("depth", "file").limit(MOST_BLAST_FILES)
    refs = reach.join(contents.select("file", word_hits(F.col("text"), name).alias("refs")), "file", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("long")))
    return refs.groupBy("file", "depth").agg(F.sum("refs").alias("refs")).withColumn("status", F.when(F.col("refs") > 0, "confirmed").otherwise("potential"))


def weak_components(pairs: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached, directions aside) of pairs (a, b)."""
    both = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = materialize(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels")
        jumped = hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        labels = materialize(jumped.select("node", F.coalesce("next", "label").alias("label"), "old"), "labels")
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))


def _tarjan(edges: list[tuple]) -> Iterator[list]:
    """Strongly connected components of a graph in memory, without recursion."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, on, stack, n = {}, {}, set(), [], 0
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = n
        n += 1
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    own = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        own.append(w)
                        if w == v:
                            break
                    yield own


def _scc_spread(pairs: DataFrame) -> DataFrame:
    """node, scc of a graph too large for a task: trim, colour forward, reach back, take out, again."""
    left, found = materialize(pairs.select("a", "b"), "scc"), None
    while left.limit(1).count():
        while True:  # nodes without a way in or a way out are alone
            kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
            kept = materialize(kept, "scc")
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.limit(1).count() == 0:
            break
        nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = materialize(nodes.select("node", F.col("node").alias("c")), "colour")
        while True:
            came = left.join(colour.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("c").alias("n"))
            step = materialize(colour.join(came, colour["node"] == came["b"], "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), F.col("c").alias("old")), "colour")
            colour = step.select("node", "c")
            if step.where("c <> old").limit(1).count() == 0:
                break
        inside = materialize(left.join(colour.withColumnsRenamed({"node": "a", "c": "ca"}), "a").join(colour.withColumnsRenamed({"node": "b", "c": "cb"}), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "inside")
        reach = frontier = materialize(colour.where("node = c"), "reach")
        while frontier.limit(1).count():
            step = inside.join(frontier.select(F.col("node").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct()
            frontier = materialize(step.join(reach, ["node", "c"], "left_anti"), "reach")
            reach = reach.unionByName(frontier)
        reach = materialize(reach, "reach")
        found = reach if found is None else found.unionByName(reach)
        gone = reach.select("node")
        left = materialize(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "scc")
    none = pairs.select(F.col("a").alias("node"), F.col("a").alias("c")).limit(0)
    return (none if found is None else found).select("node", F.col("c").alias("scc"))


def strong_components(edges: DataFrame, most_edges: int = 500_000) -> DataFrame:
    """node, scc (its least node) of all nodes on a cycle. edges: a, b.

    Weakly connected parts of up to most_edges edges are dealt into buckets of about that many, each solved at once; larger
    ones are solved step by step over all tasks.
    """
    pairs = materialize(edges.select("a", "b").distinct(), "pairs")
    part = weak_components(pairs).withColumnsRenamed({"node": "a", "component": "part"})
    placed = materialize(pairs.join(part, "a"), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > most_edges), "large")
    kind = placed.schema["a"].dataType.simpleString()

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        pairs_here = list(zip(own["a"].tolist(), own["b"].tolist()))
        loops = {a for a, b in pairs_here if a == b}
        rows = [(v, min(scc)) for scc in _tarjan(pairs_here) if len(scc) > 1 or scc[0] in loops for v in scc]
        return pd.DataFrame(rows, columns=["node", "scc"])

    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(edges.sparkSession.sparkContext.defaultParallelism, -(-total // max(1, most_edges)))
    dealt = placed.join(large, "part", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    small = dealt.groupBy("bucket").applyInPandas(solve, f"node {kind}, scc {kind}")
    return small if large.limit(1).count() == 0 else small.unionByName(_scc_spread(placed.join(large, "part", "left_semi")))


def cycles(edges: DataFrame, files: DataFrame | None = None, cross_dir: bool = False, min_length: int = 1) -> DataFrame:
    """cycle (its least file), length, cross_dir, files: import cycles, and files that import themselves."""
    pairs = resolved(edges).select(F.col("source_file").alias("a"), F.col("resolved_file").alias("b")).distinct()
    if files is not None:
        pairs = pairs.join(files.select(F.col("path").alias("a")), "a", "left_semi")
    found = strong_components(pairs)
    folder = dirname(F.col("node").cast("string"))
    out = found.groupBy("scc").agg(F.count("*").alias("length"), (F.min(folder) != F.max(folder)).alias("cross_dir"), F.array_sort(F.collect_list("node")).alias("files")).withColumnRenamed("scc", "cycle")
    out = out.where("cross_dir") if cross_dir else out
    return out.where(F.col("length") >= min_length)
