"""Scopes of extracted symbols: where each one ends, what stands above it, and within which others it lies.

Symbols of one file are nested by their lines, so a file, whose size discovery bounds, is one row of one Pandas UDF call.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SINGLE_LINE_KINDS, block_end, docstring_above, line_starts
from ..operators import ingest
from .extract import extract_symbols

#: Languages whose blocks end by indentation, by an end line of the same indentation, and which have no blocks.
INDENTED, ENDED, FLAT = ["python", "gdscript", "verse"], ["ruby", "julia"], ["assembly", "openapi", "twig", "blade", "ejs", "xml", "nix"]
#: Languages in which # begins a directive, or nothing, but no comment.
NO_HASHES = ["c", "cpp", "objc", "csharp", "java", "kotlin", "scala", "go", "rust", "javascript", "typescript", "vue", "swift", "assembly", "autohotkey", "razor"]
#: What can hold other symbols.
SCOPE_KINDS = ["class", "interface", "trait", "enum", "namespace", "type"]
SCOPES = "array<struct<line:int,name:string,kind:string,signature:string,end_line:int,docstring:string,qualified_name:string,seq:int>>"


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _end_by_indent(lines: list[str], line: int) -> int:
    """The last line with text before one that is indented no deeper than the first."""
    own, last = _indent(lines[line - 1]), line
    for n in range(line, len(lines)):
        if not lines[n].strip():
            continue
        if _indent(lines[n]) <= own and not lines[n].lstrip().startswith((")", "]", "}")):
            break
        last = n + 1
    return last


def _end_by_word(lines: list[str], line: int) -> int:
    """The line that is only "end", as deep as the first; the last line if there is none."""
    own = _indent(lines[line - 1])
    for n in range(line, len(lines)):
        if _indent(lines[n]) == own and re.match(r"end\b", lines[n].strip()):
            return n + 1
    return len(lines)


def _string_below(lines: list[str], line: int) -> str:
    """The string that begins a Python block, without quotes and indentation."""
    m = re.match(r'\s*[rRuU]?("""|\'\'\')(.*?)\1', "\n".join(lines[line : line + 200]), re.S)
    return "\n".join(x.strip() for x in m[2].strip().split("\n")) if m else ""


def scoped(text: str, language: str, symbols: list) -> list[dict]:
    """Symbols (line, name, kind, signature) of a text, in the order of lines, with end_line, docstring and qualified_name."""
    lines, begin, out, around = text.split("\n"), line_starts(text), [], []
    for seq, s in enumerate(sorted(symbols, key=lambda s: (s["line"], s["kind"], s["name"]))):
        line, kind = s["line"], s["kind"]
        if kind in ("constant", "variable", "property", "directive") or language in FLAT:
            end = line
        elif language in INDENTED:
            end = _end_by_indent(lines, line)
        elif language in ENDED:
            end = _end_by_word(lines, line)
        else:
            end = block_end(text, line, "class" if kind in SINGLE_LINE_KINDS else kind, begin=begin)
        while around and around[-1][1] < line:
            around.pop()
        holder = next((a for a in reversed(around) if a[1] >= end and a[2] < line), None)
        doc = docstring_above(lines, line, language not in NO_HASHES) or (_string_below(lines, line) if language == "python" else "")
        qualified = f"{holder[0]}.{s['name']}" if holder else s["name"]
        if kind in SCOPE_KINDS and end > line:
            around.append((qualified, end, line))
        out.append({"line": line, "name": s["name"], "kind": kind, "signature": s["signature"], "end_line": end, "docstring": doc, "qualified_name": qualified, "seq": seq})
    return out


def _scoped(text: pd.Series, language: pd.Series, symbols: pd.Series) -> pd.Series:
    return pd.Series([scoped(t, g, list(s)) for t, g, s in zip(text, language, symbols)])


def with_scopes(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """Tags for ingest.build_symbols. symbols: file, name, kind, language, line, signature; contents: file, content BINARY."""
    s = F.struct(F.col("line").cast("int").alias("line"), "name", "kind", "signature")
    own = symbols.groupBy("file", "language").agg(F.collect_list(s).alias("symbols"))  # of one file, bounded by its lines
    rows = own.join(contents.select("file", F.col("content").cast("string").alias("text")), "file")
    return rows.select("file", "language", F.explode(F.pandas_udf(_scoped, SCOPES)("text", "language", "symbols")).alias("s")).select("file", "language", "s.*")


def symbols_of(lines: DataFrame, contents: DataFrame) -> DataFrame:
    """The symbols relation of source text, methods under their classes, with the parent's id where there is one."""
    rows = ingest.build_symbols(with_scopes(extract_symbols(lines), contents))
    parents = rows.where(F.col("kind").isin(*SCOPE_KINDS)).groupBy("file", F.col("qualified_name").alias("_scope")).agg(F.min("id").alias("parent_id"))
    scope = F.when(F.col("qualified_name") != F.col("name"), F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    return rows.withColumn("_scope", scope).join(parents, ["file", "_scope"], "left").drop("_scope")
