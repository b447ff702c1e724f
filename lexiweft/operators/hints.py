"""What to do after a call: a table of rules from a tool and facts of its result to suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALWAYS = "true"
FOUND_ID, FOUND_FILE, NOTHING = "n > 0 and id is not null", "n > 0 and file is not null", "n = 0"

# Tool, condition over the facts of a result, suggestion; {id} and {file} are those of the first result.
RULES = [
    ("codebase_detect", "action = 'index:create'", "index_create to build the index"), ("codebase_detect", "action <> 'index:create'", "search_symbols or inspect_tree to explore"),
    ("index_create", ALWAYS, "search_symbols to find code"), ("index_create", ALWAYS, "stats for index info"), ("index_file", ALWAYS, "search_symbols to find code"), ("index_file", ALWAYS, "stats for index info"),
    ("index_update", "changed > 0", "search_symbols to find updated code"),
    ("search_symbols", FOUND_ID, "inspect_symbol {id}"), ("search_symbols", FOUND_ID, "inspect_bundle {id}"), ("search_symbols", NOTHING, "search_text for full-text fallback"),
    ("search_text", FOUND_FILE, "inspect_outline {file}"),
    ("inspect_outline", "id is not null", "inspect_symbol {id}"), ("inspect_outline", "id is not null", "inspect_bundle {id}"),
    ("inspect_symbol", "id is not null", "inspect_bundle {id}"), ("inspect_symbol", "id is not null", "find_callers {id}"),
    ("inspect_bundle", "id is not null", "find_callers {id}"), ("inspect_bundle", "file is not null", "find_importers {file}"),
    ("find_importers", FOUND_FILE, "inspect_dependencies {file}"), ("find_callers", FOUND_ID, "inspect_symbol {id}"),
    ("inspect_dependencies", ALWAYS, "inspect_cycles to check for circular imports"), ("find_dead", FOUND_ID, "inspect_symbol {id}"),
    ("inspect_blast_radius", "n > 0 and file is not null", "inspect_file {file}"),
]
STALE, NO_INDEX = "index_update — index is stale", "index_create — no index exists yet"


def next_steps(calls: DataFrame) -> DataFrame:
    """calls with next, the ordered suggestions (empty where there are none).

    calls: tool; n, id, file (results, and the first one's; of a blast radius the confirmed ones); action, changed; error; stale.
    Without an index only its creation is suggested; a stale index comes before what the tool suggests.
    """
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("{id}"), F.coalesce("id", F.lit(""))), F.lit("{file}"), F.coalesce("file", F.lit("")))
    rules = [F.when((F.col("tool") == tool) & F.expr(condition), filled(text)) for tool, condition, text in RULES]
    own = F.array_compact(F.array(F.when(F.col("stale"), F.lit(STALE)), *rules))
    return calls.withColumn("next", F.when(F.col("error") == "no_index", F.array(F.lit(NO_INDEX))).otherwise(own))
