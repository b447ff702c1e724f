"""Sinks: JSON, JSON lines, text tables, Markdown bundles, call logs. Tables and Markdown are for results of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One compact JSON object a row, without nulls."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(calls: DataFrame, path: str) -> None:
    """calls: ts, event, tool, args, project, duration_ms, success, error."""
    calls.write.mode("append").json(path)


def as_table(df: DataFrame, widest: int = 60, most_rows: int = 1000) -> str:
    """Aligned columns under upper-case heads; long cells end in an ellipsis, and so does a table of more than most_rows rows."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(most_rows + 1).collect()]
    if not rows:
        return "(no results)"
    more, rows = rows[most_rows:], rows[:most_rows]
    cut = lambda s: s if len(s) <= widest else s[: widest - 3] + "..."
    rows = [[cut(c) for c in r] for r in rows]
    heads = [c.upper() for c in df.columns]
    width = [max(len(x) for x in col) for col in zip(heads, *rows)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in [heads, *rows]) + ("\n..." if more else "")


def as_markdown(bundles: DataFrame) -> str:
    """Bundles as Markdown: definition, imports, outline, importers."""
    out = []
    for r in bundles.limit(20).collect():
        out += [f"# {r.name}", "", f"`{r.file}:{r.line}`", "", "## Definition", "", "```", r.source or "", "```"]
        if r.imports:
            out += ["", "## Imports", "", *(f"- `{x}`" for x in r.imports)]
        if r.outline:
            out += ["", "## File Outline", "", *(f"- {x.line}: {x.kind} `{x.name}`" for x in r.outline)]
        if "importers" in r.asDict() and r.importers:
            out += ["", "## Importers", "", *(f"- `{x}`" for x in r.importers)]
        out.append("")
    return "\n".join(out)
