"""File path rules: which files count more or less, and what a package's files are for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths whose score is lowered.
LOW_VALUE_PATHS = (
    r"/__tests__/",
    r"\.spec\.(ts|js|tsx|jsx)$",
    r"\.test\.(ts|js|tsx|jsx)$",
    r"/test/",
    r"\.stories\.(ts|js|tsx|jsx)$",
    r"\.d\.ts$",
    r"/types?\.(ts|js)$",
    r"/interfaces?/",
    r"/mocks?/",
    r"/fixtures?/",
    r"/docs?/",
    r"/examples?/",
    r"\.md$",
    r"\.map$",
    r"LICENSE",
    r"\.ya?ml$",
    r"\.json$",
    r"api\.spec",
    r"swagger",
    r"openapi",
    r"/_next/static/",
    r"/out/_next/",
    r"/static/chunks/",
    r"/assets?/",
)

# Paths whose score is raised.
HIGH_VALUE_PATHS = (
    r"package\.json$",
    r"Dockerfile",
    r"Jenkinsfile",
    r"\.sh$",
    r"webpack.*config",
    r"rollup.*config",
    r"vite.*config",
    r"jest.*config|jest.*preset|jest.*setup",
    r"babel.*config",
    r"\.github/workflows",
    r"\.gitlab-ci",
    r"Makefile",
    r"setup\.(py|cfg)$",
    r"extconf\.rb$",
    r"\.gemspec$",
    r"Gemfile$",
    r"Gemfile\.lock$",
    r"Rakefile$",
    r"pyproject\.toml$",
    r"Cargo\.toml$",
    r"go\.mod$",
    r"main\.(ts|js)$",
    r"main\.(rs|go)$",
    r"lib\.rs$",
    r"index\.(ts|js)$",
    r"^tools/",
    r"builders?/",
    r"scripts?/",
    r"codegen",
    r"generate",
    r"deploy",
    r"install-script",
    r"locust",
    r"\.py$",
    r"\.rb$",
)

# Text files of each ecosystem.
TEXT_FILES = {
    "npm": r"(?i)\.(js|ts|mjs|cjs|py|sh|json|yml|yaml|toml|cfg|ini|txt|md)$",
    "pypi": r"(?i)\.(py|js|ts|sh|json|yml|yaml|toml|cfg|ini|txt|md|pth)$",
    "cargo": r"(?i)\.(rs|toml|md|txt|json|ya?ml|sh|lock)$",
    "go": r"(?i)\.(go|mod|sum|md|txt|json|ya?ml|sh)$",
    "ruby": r"(?i)(^|/)(Rakefile|Gemfile|.*\.(rb|ru|rake|gemspec|yml|yaml|json|toml|cfg|ini|txt|md|sh))$",
}

# Files worth a look in each ecosystem; npm and pypi look at the file name only.
SUSPICIOUS_FILES = {
    "npm": r"(?i)(postinstall\.(js|sh|ts)|preinstall\.(js|sh|ts)|setup\.(js|sh)|install\.(js|sh|ts))$",
    "pypi": r"(setup\.py|setup\.cfg|conftest\.py|__init__\.py)$",
    "cargo": r"(?i)(build\.rs|/src/main\.rs|/src/lib\.rs|Cargo\.toml)$",
    "go": r"(?i)(/go\.mod|/main\.go|/init\.go|\.sh)$",
    "ruby": r"(?i)extconf\.rb$|\.gemspec$|Rakefile$|/bin/",
}

# Files that run at install time whatever their score.
INSTALL_TRIGGER = r"(?i)\.(pth|sh|bat|ps1)$|/(?:post-?install|pre-?install|install)\.[jt]s$"


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def by_ecosystem(ecosystem: Column, tests: dict[str, Column]) -> Column:
    """The test of the row's ecosystem; false for an unknown one."""
    value = F
    for name, test in tests.items():
        value = value.when(ecosystem == name, test)
    return value.otherwise(F.lit(False))


def is_text_file(ecosystem: Column, path: Column) -> Column:
    return by_ecosystem(ecosystem, {e: path.rlike(p) for e, p in TEXT_FILES.items()})


def is_suspicious(ecosystem: Column, path: Column) -> Column:
    tests = {
        e: (basename(path) if e in ("npm", "pypi") else path).rlike(p) for e, p in SUSPICIOUS_FILES.items()
    }
    return by_ecosystem(ecosystem, tests)


def without_package_prefix(path: Column) -> Column:
    return F.regexp_replace(path, "^package/", "")


def glob_pattern(glob: str) -> str:
    """The loose expression a file glob stands for: '*' any text, '?' any character, unanchored."""
    return "(?i)" + glob.replace("*", ".*").replace("?", ".")
