"""Which files of a checkout are manifests, which languages it holds, and one answer per address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pkgaudit.functions.json_text import is_json
from pkgaudit.operators.keys import compute_once, first_per_key
from pkgaudit.schemas import TEXT_DOC_KINDS

# File names that are dependency manifests.
MANIFEST_NAMES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "requirements.txt",
    "poetry.lock", "Pipfile.lock", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "Gemfile", "Gemfile.lock",
)

# Folders that are never searched for manifests.
IGNORED_FOLDERS = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "coverage", ".venv", "venv", "env",
    "__pycache__", ".pytest_cache", ".mypy_cache", "target", "vendor",
)

# Folders that language counts leave out besides those.
IGNORED_BY_LANGUAGES = (".next", ".nuxt", "out", ".cache", ".parcel-cache")

# File extensions of each language.
LANGUAGES = {
    "JavaScript": (".js", ".jsx", ".mjs", ".cjs"),
    "TypeScript": (".ts", ".tsx"),
    "Python": (".py", ".pyw"),
    "C#": (".cs",),
    "Rust": (".rs",),
    "Go": (".go",),
    "Java": (".java",),
    "Kotlin": (".kt", ".kts"),
    "Ruby": (".rb",),
    "PHP": (".php",),
    "Swift": (".swift",),
    "C": (".c",),
    "C++": (".cpp", ".cc", ".cxx", ".hpp"),
    "C/C++": (".h",),
    "Objective-C": (".m",),
    "Objective-C++": (".mm",),
    "Scala": (".scala",),
    "Clojure": (".clj",),
    "Elixir": (".ex", ".exs"),
    "Erlang": (".erl", ".hrl"),
    "Dart": (".dart",),
    "Lua": (".lua",),
    "R": (".r",),
    "Julia": (".jl",),
    "Vimscript": (".vim",),
    "Shell": (".sh", ".bash", ".zsh", ".fish"),
    "PowerShell": (".ps1", ".psm1"),
    "SQL": (".sql",),
    "Perl": (".pl", ".pm"),
    "Zig": (".zig",),
    "Nim": (".nim",),
    "Crystal": (".cr",),
    "V": (".v",),
    "Visual Basic": (".vb",),
    "F#": (".fs", ".fsx"),
    "OCaml": (".ml", ".mli"),
    "Haskell": (".hs",),
    "Elm": (".elm",),
    "Vue": (".vue",),
    "Svelte": (".svelte",),
}


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _searched(path: Column, ignored: tuple, exclude: list[str]) -> Column:
    """Whether a walk reaches the file: no ignored folder above it, no excluded text in its folder path."""
    keep = ~F.arrays_overlap(_folders(path), F.array(*[F.lit(d) for d in ignored]))
    above = F.array_join(_folders(path), "/")
    return reduce(lambda acc, pattern: acc & ~above.contains(pattern), exclude, keep)


def find_manifests(files: DataFrame, exclude: list[str] | None = None, max_depth: int = 0) -> DataFrame:
    """Files that are manifests, with their kind in column 'type'; max_depth 0 means any depth."""
    path = F.col("relative_path")
    kind = F.element_at(F.split(path, "/"), -1)
    rows = files.filter(kind.isin(*MANIFEST_NAMES) & _searched(path, IGNORED_FOLDERS, exclude or []))
    if max_depth > 0:
        rows = rows.filter(F.size(F.split(path, "/")) <= max_depth)
    return rows.withColumn("type", kind)


def language_stats(files: DataFrame, exclude: list[str] | None = None, by: tuple = ()) -> DataFrame:
    """Files per language and their share of all recognised files, most common first."""
    path = F.col("relative_path")
    base = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))
    pairs = [F.lit(x) for name, exts in LANGUAGES.items() for ext in exts for x in (ext, name)]
    counts = (
        files.filter(_searched(path, IGNORED_FOLDERS + IGNORED_BY_LANGUAGES, exclude or []))
        .withColumn("language", F.element_at(F.create_map(*pairs), extension))
        .filter(F.col("language").isNotNull())
        .groupBy(*by, "language")
        .agg(F.count(F.lit(1)).alias("file_count"))
    )
    # At most one row per language is left in each group, so this window stays small.
    total = F.sum("file_count").over(Window.partitionBy(*by))
    return counts.withColumn("percentage", F.col("file_count") / total * 100).orderBy(
        *by, F.desc("file_count"), "language"
    )


def dedup_responses(fetches: DataFrame) -> DataFrame:
    """One answer per address: the first; a failed or unreadable one counts as 404 without a body."""
    first = first_per_key(fetches, ["url"], F.struct("fetched_at", "status", "body"))
    readable = is_json(F.col("body"))
    if "kind" in fetches.columns:
        readable = F.col("kind").isin(*TEXT_DOC_KINDS) | readable
    good = F.coalesce(F.col("status").between(200, 299) & F.col("body").isNotNull() & readable, F.lit(False))
    marked = compute_once(first, "_good", good)
    return marked.withColumns({
        "body": F.when(F.col("_good"), F.col("body")),
        "status": F.when(F.col("_good"), F.col("status")).otherwise(F.lit(404)),
    }).select(*fetches.columns)
