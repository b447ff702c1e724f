"""Sources: source trees as relations, discovery filters, Git heads."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_language, extension, glob_to_regex

# Folders that are passed over, extensions of binary files, lock and minified files, names of secrets.
SKIP_FOLDERS = [
    ".git", ".svn", ".hg", "node_modules", "vendor", "bower_components", "dist", "build", ".next", ".nuxt", ".svelte-kit", ".output", ".turbo", ".parcel-cache", ".angular", ".docusaurus", ".expo", ".wireit", "storybook-static",
    ".gradle", "DerivedData", ".build", ".cache", "__pycache__", ".tox", ".mypy_cache", ".venv", "venv", ".idea", ".vscode", "coverage", ".nyc_output", "__coverage__", "vendors", "app-assets", "codemirror", "ckeditor", "tinymce", "summernote",
]
BINARY_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "pdf", "zip", "gz", "tar", "7z", "rar", "exe", "dll", "so", "dylib", "o", "a", "class", "jar", "pyc", "woff", "woff2", "ttf", "otf", "mp3", "mp4", "avi", "mov", "sqlite", "db", "bin"]
SKIP_NAMES = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|cargo\.lock|poetry\.lock|gemfile\.lock|go\.sum|[^/]*\.min\.(js|css)|[^/]*\.map|[^/]*\.bundle\.js)$"
SECRET_NAMES = r"(?i)(^|/)(\.env(\.[^/]*)?|[^/]*\.(pem|key|p12|pfx|jks|keystore)|id_(rsa|dsa|ecdsa|ed25519)(\.pub)?|\.netrc|\.npmrc|\.pypirc|\.htpasswd|credentials(\.json)?|secrets?\.(ya?ml|json|toml))$"
MANIFESTS = ["package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "composer.json", "pom.xml", "build.gradle", "Gemfile", "CMakeLists.txt", "Makefile"]


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size_bytes, mtime, content BINARY of all files below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    return raw.select(F.regexp_replace("path", "^" + re.escape(base).replace("file:", "file:/{0,2}"), "").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def files_of(tree: DataFrame) -> DataFrame:
    """The files relation: path, hash, language, size_bytes, mtime."""
    return tree.select("path", F.sha2("content", 256).alias("hash"), detect_language(F.col("path")).alias("language"), "size_bytes", "mtime")


def has_nul(content: Column) -> Column:
    """A NUL byte among the first 8192, whatever digits are next to it."""
    return F.contains(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), F.lit("\0"))


def in_skipped_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_FOLDERS)))


def parse_ignore(text: str, folder: str = "") -> list[str]:
    """Regular expressions of an ignore file's rules; comments and negations are dropped."""
    out, base = [], folder + "/" if folder else ""
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule[0] in "#!":
            continue
        rule = rule.rstrip("/")
        if rule.startswith("/"):
            out.append(glob_to_regex(base + rule[1:])[:-1] + "(/.*)?$")
        else:
            out.append(glob_to_regex(base + "**/" + rule)[:-1] + "(/.*)?$")
    return out


def ignored(path: Column, rules: list[str]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | path.rlike(r)
    return out


def discover(tree: DataFrame, extensions: list[str] | None = None, rules: list[str] | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """The files to index, by path: the discovery filters in order."""
    ext = F.lower(extension(F.col("path")))
    rows = tree.where(~in_skipped_folder(F.col("path")) & ~ext.isin(*BINARY_EXTENSIONS) & ~F.col("path").rlike(SECRET_NAMES) & ~F.col("path").rlike(SKIP_NAMES))
    rows = rows.where(ext.isin(*extensions)) if extensions else rows
    rows = rows.where(~ignored(F.col("path"), rules)) if rules else rows
    return rows.where((F.col("size_bytes") <= most_bytes) & ~has_nul(F.col("content")))


def vendored(files: DataFrame, workspaces: list[str] = ()) -> DataFrame:
    """Folders that hold a manifest of their own, outside workspaces and source folders: third-party code."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.where(F.instr("path", "/") > 0).where(F.substring_index("path", "/", -1).isin(*MANIFESTS)).select(folder.alias("folder")).distinct()
    own = F.col("folder").rlike(r"(^|/)(src|lib|packages|apps|internal|modules|crates)(/|$)")
    for w in workspaces:
        own = own | F.col("folder").rlike(glob_to_regex(w.rstrip("/"))[:-1] + "(/.*)?$")
    return rows.where(~own)


#: Root manifests that list a project's own members: (file name, what encloses the list, a member in it).
MEMBER_LISTS = [
    (r"package\.json", r'(?s)"workspaces"\s*:\s*(?:\{.*?"packages"\s*:\s*)?\[([^\]]*)\]', r'"([^"]+)"'),
    (r"Cargo\.toml", r"(?s)\[workspace\](?:(?!\n\[).)*?\bmembers\s*=\s*\[([^\]]*)\]", r"[\"']([^\"']+)[\"']"),
    (r"go\.work", r"(?m)^\s*use\s*\(([^)]*)\)", r"(?m)^\s*(?!//)([^\s()]+)"),
    (r"go\.work", r"(?m)^\s*use[ \t]+([^\s(]+)", r"(\S+)"),
    (r"pom\.xml", r"(?s)<modules>(.*?)</modules>", r"<module>\s*([^<]*?)\s*</module>"),
    (r"settings\.gradle(?:\.kts)?", r"(?m)^\s*include\b\s*((?:[^\n]|,\s*\n)*)", r"[\"']([^\"']+)[\"']"),
]


def workspaces(tree: DataFrame) -> DataFrame:
    """manifest, folder: the members (folders or globs) that the root manifests of npm, Cargo, Go, Maven and Gradle list."""
    text = F.col("content").cast("string")
    lists = [F.when(F.col("path").rlike(f"^{name}$"), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(around), 1), lambda x: F.regexp_extract_all(x, F.lit(member), 1)))) for name, around, member in MEMBER_LISTS]
    rows = tree.where(~F.contains("path", F.lit("/"))).select(F.col("path").alias("manifest"), F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("m"))
    plain = F.when(F.startswith("manifest", F.lit("settings.gradle")), F.translate("m", ":", "/")).otherwise(F.col("m"))
    folder = F.regexp_replace(F.regexp_replace(plain, r"^(\./|/)+", ""), r"/+$", "")
    return rows.where("m not like '!%'").select("manifest", folder.alias("folder")).where("folder not in ('', '.')").distinct()


def third_party(tree: DataFrame) -> DataFrame:
    """vendored(), with the workspaces that the tree's own root manifests list (a few short files)."""
    return vendored(tree, [r.folder for r in workspaces(tree).collect()])


# Manifests and the extensions of such, with their ecosystems; extensions of source files; folders not entered.
ECOSYSTEMS = {
    "composer.json": "php", "package.json": "node", "Cargo.toml": "rust", "go.mod": "go", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python", "Gemfile": "ruby",
    "build.gradle": "java", "build.gradle.kts": "kotlin", "pom.xml": "java", "CMakeLists.txt": "c/cpp", "Makefile": "c/cpp", "mix.exs": "elixir", "pubspec.yaml": "dart", "stack.yaml": "haskell", "cabal.project": "haskell",
    "build.sbt": "scala", "build.zig": "zig", "flake.nix": "nix",
}
ECOSYSTEM_EXTENSIONS = {"sln": "dotnet", "csproj": "dotnet", "fsproj": "dotnet", "cabal": "haskell"}
SOURCE_EXTENSIONS = (
    "php phtml inc js jsx mjs cjs ts tsx mts vue py pyw go rs java c h cpp cxx cc hpp hxx hh cs rb kt kts swift dart lua pl pm sh bash zsh sql r R scala ex exs erl hrl hs ml mli vim el clj cljs cljc groovy v sv nix gleam ejs md markdown mdx"
).split()
CLOSED_FOLDERS = "vendor node_modules .git .svn .hg __pycache__ .tox .venv venv dist build target .idea .vscode".split()
LEAST_SOURCES, DEEPEST_MANIFEST = 5, 2


def detect_codebases(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """project, detection (manifest-root, manifest-subdir, heuristic, none), ecosystems (sorted), action (index:create, ready, skip).

    listing: project, path of every file. indexed: project, of those with an index. Manifests below the root count at the
    least depth that has any, of all its folders; hidden and closed folders are not entered. Without manifests, a Git folder
    and five source files do.
    """
    parts, name = F.split("path", "/"), F.substring_index("path", "/", -1)
    depth = F.size(parts) - 1
    entered = ~F.exists(F.slice(parts, F.lit(1), depth), lambda p: p.startswith(".") | F.lower(p).isin(*CLOSED_FOLDERS))
    visible = ~name.startswith(".")
    by_name, by_extension = (F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (ECOSYSTEMS, ECOSYSTEM_EXTENSIONS))
    eco = F.coalesce(by_name[name], F.when(visible, by_extension[F.regexp_extract(name, r"\.([^.]*)$", 1)]))
    source = entered & visible & F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*SOURCE_EXTENSIONS)
    rows = listing.select("project", depth.alias("depth"), F.when(entered, eco).alias("eco"), source.alias("source"), parts[0].alias("top"))
    at = [F.array_sort(F.collect_set(F.when(F.col("depth") == d, F.col("eco")))).alias(f"eco{d}") for d in range(DEEPEST_MANIFEST + 1)]
    facts = rows.groupBy("project").agg(*at, F.count_if("source").alias("sources"), F.bool_or((F.col("top") == ".git") & (F.col("depth") > 0)).alias("git"))
    found = F.coalesce(*[F.when(F.size(f"eco{d}") > 0, F.col(f"eco{d}")) for d in range(DEEPEST_MANIFEST + 1)], F.array().cast("array<string>"))
    how = F.when(F.size("eco0") > 0, "manifest-root").when(F.size(found) > 0, "manifest-subdir").when(F.col("git") & (F.col("sources") >= LEAST_SOURCES), "heuristic").otherwise("none")
    facts = facts.select("project", how.alias("detection"), found.alias("ecosystems")).join(indexed.select("project").distinct().withColumn("_has", F.lit(True)), "project", "left")
    return facts.select("project", "detection", "ecosystems", F.when(F.col("detection") == "none", "skip").when(F.col("_has"), "ready").otherwise("index:create").alias("action"))


def contained(root: str, path: str) -> bool:
    """Whether a path, links resolved, lies below root."""
    root, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return full == root or full.startswith(root + os.sep)


def git_head(root: str) -> str | None:
    """The commit of a working copy: HEAD, its loose ref, or the packed one."""
    git = os.path.join(root, ".git")
    try:
        head = open(os.path.join(git, "HEAD")).read().strip()
        if not head.startswith("ref: "):
            return head
        ref = head[5:]
        loose = os.path.join(git, ref)
        if os.path.exists(loose):
            return open(loose).read().strip()
        for line in open(os.path.join(git, "packed-refs")):
            if line.rstrip().endswith(" " + ref):
                return line.split()[0]
    except OSError:
        pass
    return None


def check_repo_name(name: str) -> tuple[str, str]:
    """owner and repository of owner/repo, or an error."""
    m = re.fullmatch(r"([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/([A-Za-z0-9._-]{1,100})", name)
    if not m or m[2] in (".", "..") or m[1].endswith("-"):
        raise ValueError(f"not owner/repo: {name!r}")
    return m[1], m[2]
