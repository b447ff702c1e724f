"""Extractors: imports and symbols of source text, as line patterns by language.

Patterns run as JVM regular expressions over lines, so extraction needs no Python. A language is a list of (kind, pattern);
group 1 is the name. Quality differs from a real parser's: nesting is not followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENT = r"([A-Za-z_$][A-Za-z0-9_$]*)"
#: Symbols by language: (kind, pattern of a trimmed line).
SYMBOLS: dict[str, list[tuple[str, str]]] = {
    "python": [("class", rf"^class\s+{IDENT}"), ("function", rf"^(?:async\s+)?def\s+{IDENT}"), ("constant", r"^([A-Z][A-Z0-9_]+)\s*=")],
    "javascript": [("class", rf"^(?:export\s+(?:default\s+)?)?class\s+{IDENT}"), ("function", rf"^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\*?\s+{IDENT}"), ("constant", rf"^(?:export\s+)?const\s+{IDENT}\s*(?::[^=]+)?=\s*(?!(?:async\s*)?(?:function|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>))")],
    "go": [("function", rf"^func\s+(?:\([^)]*\)\s*)?{IDENT}"), ("type", rf"^type\s+{IDENT}"), ("constant", rf"^const\s+{IDENT}")],
    "rust": [("function", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+{IDENT}"), ("class", rf"^(?:pub\s+)?struct\s+{IDENT}"), ("enum", rf"^(?:pub\s+)?enum\s+{IDENT}"), ("trait", rf"^(?:pub\s+)?trait\s+{IDENT}")],
    "java": [("class", rf"^(?:[a-z]+\s+)*class\s+{IDENT}"), ("interface", rf"^(?:[a-z]+\s+)*interface\s+{IDENT}"), ("enum", rf"^(?:[a-z]+\s+)*enum\s+{IDENT}")],
    "php": [("class", rf"^(?:abstract\s+|final\s+)*class\s+{IDENT}"), ("function", rf"^(?:[a-z]+\s+)*function\s+{IDENT}"), ("interface", rf"^interface\s+{IDENT}"), ("trait", rf"^trait\s+{IDENT}")],
    "ruby": [("class", rf"^class\s+{IDENT}"), ("namespace", rf"^module\s+{IDENT}"), ("method", r"^def\s+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[?!]?)")],
    "c": [("constant", rf"^#\s*define\s+{IDENT}"), ("class", rf"^(?:typedef\s+)?struct\s+{IDENT}"), ("enum", rf"^(?:typedef\s+)?enum\s+{IDENT}")],
    "hcl": [("class", r'^(?:resource|module|provider)\s+(?:"[^"]*"\s+)?"([^"]+)"'), ("variable", r'^variable\s+"([^"]+)"'), ("property", r'^(?:output|data)\s+(?:"[^"]*"\s+)?"([^"]+)"')],
    "graphql": [("class", rf"^(?:extend\s+)?(?:type|union|input|scalar)\s+{IDENT}"), ("interface", rf"^interface\s+{IDENT}"), ("enum", rf"^enum\s+{IDENT}"), ("function", rf"^(?:query|mutation|subscription|fragment)\s+{IDENT}")],
    "julia": [("function", r"^(?:function|macro)\s+([A-Za-z_][A-Za-z0-9_!]*)"), ("class", rf"^(?:(?:mutable\s+)?struct|abstract\s+type|module)\s+{IDENT}"), ("constant", rf"^const\s+{IDENT}")],
    "gdscript": [("function", rf"^(?:static\s+)?func\s+{IDENT}"), ("class", rf"^class(?:_name)?\s+{IDENT}"), ("property", rf"^signal\s+{IDENT}"), ("enum", rf"^enum\s+{IDENT}"), ("constant", rf"^const\s+{IDENT}"), ("variable", rf"^(?:@export\S*\s+|export\S*\s+)var\s+{IDENT}")],
    "gleam": [("function", rf"^(?:pub\s+)?fn\s+{IDENT}"), ("type", rf"^(?:pub\s+)?(?:opaque\s+)?type\s+{IDENT}"), ("constant", rf"^(?:pub\s+)?const\s+{IDENT}"), ("namespace", r"^import\s+([a-z_/]+)")],
    "verse": [("class", rf"^{IDENT}\s*(?:<[^>]*>)?\s*:=\s*class"), ("function", rf"^{IDENT}\s*(?:<[^>]*>)?\([^)]*\)\s*(?:<[^>]*>)*\s*:"), ("variable", rf"^var\s+{IDENT}")],
    "ejs": [("directive", r"<%-?\s*include\(?\s*['\"]([^'\"]+)")],
    "blade": [("directive", r"@(?:extends|include|includeIf|includeWhen|component|section|yield|livewire|each|push|stack|slot)\(\s*['\"]([^'\"]+)"), ("directive", r"<x-([A-Za-z0-9.:_-]+)")],
    "twig": [("directive", r"\{%-?\s*(?:extends|include|embed|block|import|from|use)\s+['\"]?([^'\"\s%]+)"), ("method", rf"\{{%-?\s*macro\s+{IDENT}"), ("variable", rf"\{{%-?\s*set\s+{IDENT}"), ("constant", r"\bid=['\"]([^'\"{]+)")],
    "razor": [("directive", r"^@((?:page|model|using|inject|inherits|layout|section)\b)"), ("constant", r"\bid=['\"]([^'\"@]+)"), ("method", rf"^(?:public|private|protected|internal)\s+(?:[\w<>\[\]?]+\s+)+{IDENT}\s*\(")],
    "vue": [("function", rf"^(?:const\s+)?{IDENT}\s*=\s*(?:computed|watch)\("), ("property", r"define(?:Props|Emits|Expose)\b[^'\"]*['\"]([^'\"]+)"), ("variable", rf"^const\s+{IDENT}\s*=\s*(?:ref|reactive|shallowRef)\(")],
    "xml": [("constant", r"<[A-Za-z][^>]*?\b(?:id|name|key)=['\"]([^'\"]+)"), ("function", r"<(?:script|link)\b[^>]*?\b(?:src|href)=['\"]([^'\"]+)")],
    "nix": [("function", r"^([A-Za-z_][\w'.-]*)\s*=\s*(?:\{[^}]*\}|[A-Za-z_][\w'-]*)\s*:"), ("variable", r"^([A-Za-z_][\w'.-]*)\s*=(?!\s*(?:\{[^}]*\}|[A-Za-z_][\w'-]*)\s*:)")],
    "assembly": [("function", r"^([A-Za-z_.@][\w.@$]*):"), ("constant", r"^([A-Za-z_][\w.]*)\s+(?i:equ)\b|^(?i:\.(?:equ|set|define))\s+([A-Za-z_]\w*)"), ("class", r"^\.?(?i:section|segment)\s+\"?([\w.]+)")],
    "autohotkey": [("class", rf"^(?i:class)\s+{IDENT}"), ("function", rf"^{IDENT}\([^)]*\)\s*\{{"), ("constant", r"^([^\s:;][^\s:]*)::"), ("property", r"^(?i:#HotIf)\s+(.+)$")],
    "openapi": [("function", r"\"?operationId\"?\s*:\s*\"?([\w.-]+)"), ("class", r"^\"?title\"?\s*:\s*\"?([^\"]+)")],
}
ALSO = {"typescript": "javascript", "cpp": "c", "objc": "c", "kotlin": "java", "scala": "java", "csharp": "java"}

#: Imports by language family: (pattern of a trimmed line, group of the specifier, group of the name or 0, type).
IMPORTS: dict[str, list[tuple[str, int, int, str]]] = {
    "javascript": [(r"^(?:import|export)\s+(?:type\s+)?(?:[^'\"{]*\{\s*([A-Za-z_$][\w$]*)?[^}]*\}|[^'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]", 2, 1, "import"), (r"^import\s*['\"]([^'\"]+)['\"]", 1, 0, "import"), (r"(?<![\w$.])require\(\s*['\"]([^'\"]+)['\"]", 1, 0, "require"), (r"(?<![\w$.])import\(\s*['\"]([^'\"]+)['\"]", 1, 0, "dynamic_import")],
    "python": [(r"^from\s+([\w.]+)\s+import\s+\(?\s*([\w*]+)", 1, 2, "from"), (r"^import\s+([\w.]+)", 1, 0, "import")],
    "go": [(r"^(?:import\s+)?(?:[\w.]+\s+)?\"([\x21-\x7e]+)\"$", 1, 0, "import")],
    "rust": [(r"^(?:pub\s+)?use\s+((?:\w+::)*(\w+))", 1, 2, "use"), (r"^(?:pub\s+)?mod\s+(\w+)\s*;", 1, 0, "mod")],
    "c": [(r"^#\s*include\s*\"([^\"]+)\"", 1, 0, "include"), (r"^#\s*include\s*<([^>]+)>", 1, 0, "system_include")],
    "java": [(r"^import\s+(?:static\s+)?([\w.]*?(\w+|\*));?$", 1, 2, "import")],
    "php": [(r"^use\s+((?:\w+\\)*(\w+))", 1, 2, "use"), (r"^(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)", 1, 0, "require")],
    "ruby": [(r"^require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)", 1, 0, "require")],
    "csharp": [(r"^using\s+(?:static\s+)?([\w.]+)\s*;", 1, 0, "using")],
    "twig": [(r"\{%-?\s*(extends|include|embed|import|from|use)\s+['\"]([^'\"]+)['\"]", 2, 0, "include")],
    "blade": [(r"@(?:extends|include\w*|component|livewire|each|use)\(\s*['\"]([^'\"]+)", 1, 0, "include"), (r"<x-([A-Za-z0-9.:_-]+)", 1, 0, "component")],
    "swift": [(r"^import\s+(?:qualified\s+)?([\w.]+)", 1, 0, "import")],
}
IMPORTS_ALSO = {"typescript": "javascript", "vue": "javascript", "cpp": "c", "objc": "c", "kotlin": "java", "scala": "java", "haskell": "swift"}


def _is(language: str, also: dict[str, str]) -> Column:
    return F.col("language").isin(language, *(k for k, v in also.items() if v == language))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """file, name, kind, language, line, signature. lines: path, language, line, text."""
    t = F.btrim("text", F.lit(" \t\r"))
    rules = [F.when(_is(lang, ALSO), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(t, pattern, 1).alias("name"))) for lang, own in SYMBOLS.items() for kind, pattern in own]
    rows = lines.select(F.col("path").alias("file"), "language", "line", t.alias("signature"), F.explode(F.array_compact(F.array(*rules))).alias("s"))
    return rows.where("s.name <> ''").select("file", "s.name", "s.kind", "language", "line", "signature")


def extract_imports(lines: DataFrame) -> DataFrame:
    """source_file, target_name, imported_name (or module), import_type, language, line."""
    t = F.btrim("text", F.lit(" \t\r"))
    rules = []
    for lang, own in IMPORTS.items():
        for pattern, target, name, kind in own:
            named = F.regexp_extract(t, pattern, name) if name else F.lit("")
            rules.append(F.when(_is(lang, IMPORTS_ALSO) & t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, target).alias("target_name"), F.when((named == "") | (named == "*"), "module").otherwise(named).alias("imported_name"), F.lit(kind).alias("import_type"))))
    rows = lines.select(F.col("path").alias("source_file"), "language", "line", F.explode(F.array_compact(F.array(*rules))).alias("i"))
    return rows.where("i.target_name <> '' and i.target_name <> '_self'").select("source_file", "i.target_name", "i.imported_name", "i.import_type", "language", "line")


def strip_jinja(text: Column) -> Column:
    """Template marks blanked; newlines stay."""
    return F.regexp_replace(text, r"\{\{[^\n]*?\}\}|\{%[^\n]*?%\}|\{#[^\n]*?#\}", "")
