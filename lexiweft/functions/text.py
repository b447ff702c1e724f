"""Scalar functions of names, paths, documentation and source text, as column expressions.

The hot path stays in built-in expressions; only the scan of block_end needs Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical symbol kinds with their labels, the aliases of kinds, and kinds on a single line.
KINDS = {
    "function": "Function", "method": "Method", "class": "Class", "interface": "Interface", "trait": "Trait", "enum": "Enum", "constant": "Constant", "variable": "Variable",
    "property": "Property", "type": "Type", "namespace": "Namespace", "directive": "Directive", "chapter": "chapter", "section": "section", "subsection": "subsection",
}
KIND_ALIASES = {
    "func": "function", "subroutine": "function", "procedure": "function", "member": "method", "singletonmethod": "method", "struct": "class", "module": "namespace", "package": "namespace",
    "field": "property", "macro": "constant", "define": "constant", "enumerator": "constant", "typedef": "type", "union": "type", "alias": "type", "var": "variable", "local": "variable", "protocol": "interface",
}
SINGLE_LINE_KINDS = ["constant", "variable", "property", "namespace", "type", "directive"]
# Other spellings of languages.
LANGUAGE_ALIASES = {"sh": "bash", "c++": "cpp", "c#": "csharp", "emacslisp": "elisp", "systemverilog": "verilog"}
# Languages by extension.
EXTENSIONS = {
    "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust",
    "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "php": "php", "rb": "ruby", "cs": "csharp",
    "swift": "swift", "m": "objc", "sh": "bash", "bash": "bash", "pl": "perl", "pm": "perl", "lua": "lua", "r": "r", "jl": "julia", "hs": "haskell", "ex": "elixir", "exs": "elixir", "erl": "erlang",
    "clj": "clojure", "ml": "ocaml", "sql": "sql", "css": "css", "scss": "scss", "html": "html", "xml": "xml", "xul": "xml", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
    "vue": "vue", "twig": "twig", "ejs": "ejs", "cshtml": "razor", "razor": "razor", "gd": "gdscript", "gleam": "gleam", "graphql": "graphql", "gql": "graphql", "tf": "hcl", "hcl": "hcl", "nix": "nix",
    "asm": "assembly", "s": "assembly", "ahk": "autohotkey", "verse": "verse", "v": "verilog", "sv": "verilog", "el": "elisp", "dart": "dart", "zig": "zig",
}


def _choice(value: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value], other)


def normalize_kind(kind: Column) -> Column:
    """A canonical kind; what is unknown is a variable."""
    low = F.lower(kind)
    return F.when(low.isin(*KINDS), low).otherwise(_choice(low, KIND_ALIASES, F.lit("variable")))


def normalize_language(language: Column) -> Column:
    low = F.lower(language)
    return _choice(low, LANGUAGE_ALIASES, low)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """What follows the last dot of the basename; empty if there is none, or only a leading one."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def detect_language(path: Column) -> Column:
    """By special names first, then by extension; an unknown extension is its own language, none is unknown."""
    base, ext = F.lower(basename(path)), F.lower(extension(path))
    return (
        F.when(base.endswith(".blade.php"), "blade")
        .when(base.rlike(r"^(openapi|swagger)\.(json|ya?ml)$"), "openapi")
        .when(ext == "", "unknown")
        .otherwise(_choice(ext, EXTENSIONS, ext))
    )


def make_id(file: Column, qualified: Column, kind: Column, repeat: Column | None = None) -> Column:
    """file::qualified#kind, and ~k for the k-th repeat."""
    plain = F.concat(file, F.lit("::"), qualified, F.lit("#"), kind)
    return plain if repeat is None else F.when(repeat > 0, F.concat(plain, F.lit("~"), repeat.cast("string"))).otherwise(plain)


def keywords(name: Column) -> Column:
    """Parts of a name, cut at camel case, _ . and white space; lower-cased, without repeats and single letters."""
    cut = F.regexp_replace(name, r"(?<=[^_. \t])(?=[A-Z])", "_")
    # Runs of capitals stay together: cut only where a capital follows a small letter or a digit.
    cut = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.array_distinct(F.filter(F.transform(F.split(cut, r"[_. \t]+"), lambda x: F.lower(x)), lambda x: F.length(x) > 1))


def summarize(doc: Column) -> Column:
    """The first sentence of a documentation text: its lines up to a blank one or a tag, at most 120 characters."""
    lines = F.transform(F.split(F.btrim(doc, F.lit(" \t\r\n")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    stop = F.array_position(F.transform(lines, lambda x: (x == "") | x.startswith("@")), True)
    lead = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(lines)
    joined = F.array_join(lead, " ")
    sentence = F.regexp_extract(joined, r"^(.*?\.)\s", 1)
    text = F.when(sentence != "", sentence).otherwise(joined)
    return F.when(F.length(text) > 120, F.concat(F.left(text, F.lit(117)), F.lit("..."))).otherwise(text)


def fallback_summary(kind: Column, name: Column) -> Column:
    return F.concat(_choice(kind, KINDS, kind), F.lit(" "), name)


def is_fallback_summary(summary: Column, kind: Column, name: Column) -> Column:
    return (summary == "") | (summary == fallback_summary(kind, name))


def signature_of(pattern: Column, returns: Column) -> Column:
    """A tag pattern without its /^ and $/, with the return type where it names none."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(pattern, r"^/\^?", ""), r"\$?/(;\")?$", ""))
    return F.when((F.coalesce(returns, F.lit("")) != "") & ~bare.contains(":"), F.concat(bare, F.lit(": "), returns)).otherwise(bare)


def contains_ci(value: Column, part: str) -> Column:
    return F.contains(F.lower(value), F.lit(part.lower()))


def path_filter(path: Column, wanted: str | None = None, unwanted: str | None = None) -> Column:
    """Substrings separated by |, any of which a path must have (must not have); case does not matter."""
    out = F.lit(True)
    for text, keep in ((wanted, True), (unwanted, False)):
        parts = [p.strip() for p in (text or "").split("|") if p.strip()]
        if parts:
            hit = F.lit(False)
            for p in parts:
                hit = hit | contains_ci(path, p)
            out = out & (hit if keep else ~hit)
    return out


def glob_to_regex(glob: str, pathname: bool = True, fold: bool = True) -> str:
    """An anchored regular expression. With pathname, * and ? stop at / and ** crosses it."""
    out, i, own = "", 0, "[^/]" if pathname else "."
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and pathname:
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += own + "*"
        elif c == "?":
            out += own
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return ("(?is)^" if fold else "(?s)^") + out + "$"


#: What a pattern consists of: escapes and classes are one token each, so that signs in them repeat nothing.
REGEX_TOKEN = re.compile(r"""\\.|\[\^?\]?(?:\\.|[^\]\\])*\]?|\{[^}]*\}|[ \t]+|.""", re.S)


def _repeats_a_repeat(pattern: str) -> bool:
    """Whether a group that itself holds a repeat is repeated."""
    tokens = [t for t in REGEX_TOKEN.findall(pattern) if t.strip(" \t")]
    open_groups: list[bool] = []  # does the group hold a repeat
    for t, after in zip(tokens, [*tokens[1:], ""]):
        if t == "(":
            open_groups.append(False)
        elif t == ")":
            if open_groups and open_groups.pop() and after[:1] in ("+", "*", "{"):
                return True
        elif t[0] in "+*{" and open_groups:
            open_groups[-1] = True
    return False


def check_regex(pattern: str) -> str | None:
    """Why a pattern is refused, or None: empty, over 200 characters, a repeat of a repeat, or no regular expression."""
    if not pattern:
        return "empty"
    if len(pattern) > 200:
        return "too long"
    if _repeats_a_repeat(pattern):
        return "nested quantifier"
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def word_hits(text: Column, word: str) -> Column:
    """How often an identifier occurs as a word."""
    return F.size(F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda x: x == word)).cast("long")


def clip(text: Column, most: int = 200) -> Column:
    """Trimmed, and cut to so many characters with an ellipsis."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


def is_test_file(path: Column) -> Column:
    return basename(path).rlike(r"(?i)^(test|spec)|[_.](test|spec)([_.]|$)")


# Names that are called from outside.
ENTRY_NAMES = ["main", "__init__", "__main__", "setUp", "tearDown", "setup", "configure", "register", "boot", "init", "handle", "run", "execute", "__construct", "__destruct"]


def is_entry_point(name: Column) -> Column:
    return name.isin(*ENTRY_NAMES) | name.startswith("test_") | name.startswith("Test")


def confidence(language: Column) -> Column:
    """How sure an unused symbol is unused, by how static the language's imports are."""
    return F.when(language.isin("c", "c++", "go", "java", "kotlin", "rust"), "high").when(language.isin("javascript", "typescript", "python", ""), "medium").otherwise("low")


#: What a scan for braces must know: comments and strings are one token each, however many braces they hold.
CODE_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\n]*|^[ \t]*#[^\n]*|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[{}();]""", re.S | re.M)


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def block_end(text: str, line: int, kind: str, most: int = 50, begin: list[int] | None = None) -> int:
    """The line (from 1) on which the symbol that begins on a line ends: at its closing brace, or at a semicolon before any brace.

    Kinds of one line end where they begin. Without either end, the symbol is taken to have `most` lines more, as far as there are any.
    begin: line_starts(text), where they are known.
    """
    if kind in SINGLE_LINE_KINDS:
        return line
    begin = begin or line_starts(text)
    braces = brackets = 0
    for m in CODE_TOKEN.finditer(text, begin[line - 1]):
        t = m[0]
        brackets += (t == "(") - (t == ")")
        if brackets > 0:
            continue
        braces += (t == "{") - (t == "}")
        if t == "}" and braces <= 0 or t == ";" and braces == 0:
            return line + text.count("\n", begin[line - 1], m.start())
    return min(line + most, len(begin))


COMMENT_MARKS = ("///", "//", "##", "#", "--")


def docstring_above(lines: list[str], start: int, hashes: bool = True) -> str:
    """The comment that ends above line start (from 1), without its marks; decorators in between are passed over.

    hashes: whether # begins a comment in the language.
    """
    n = start - 2
    while n >= 0 and lines[n].strip().startswith(("@", "#[", "[")):
        n -= 1
    if n < 0:
        return ""
    last = lines[n].strip()
    if last.endswith("*/"):
        top = n
        while top > 0 and "/*" not in lines[top]:
            top -= 1
        body = [re.sub(r"^\s*(/\*+!?|\*(?!/))?\s?|\s*\*+/\s*$", "", x) for x in lines[top : n + 1]]
        return "\n".join(x.rstrip() for x in body).strip()
    marks = next((m for m in COMMENT_MARKS if last.startswith(m) and (hashes or m[0] != "#")), None)
    if not marks:
        return ""
    top = n
    while top > 0 and lines[top - 1].strip().startswith(marks):
        top -= 1
    return "\n".join(re.sub(r"^(/{2,}!?|#+|--+)\s?", "", x.strip()) for x in lines[top : n + 1]).strip()
