"""Version text: cleaning, ordering, and the name keys the registries use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgaudit.functions.binding import bind

def clean_version(spec: Column) -> Column:
    """Drop leading range operators and blanks, keep the first of several alternatives."""
    bare = F.regexp_replace(F.regexp_replace(spec, r"^[\^~>=<]+", ""), r"\s+", "")
    return F.trim(F.substring_index(F.substring_index(bare, ",", 1), "||", 1))


def number_key(digits: Column) -> Column:
    """Text of a run of digits that sorts as the number does, whatever its size.

    Led by the count of its digits without leading zeros, which is led by the count of that count's
    digits: nothing is padded, so nothing is ever cut. A text of 10^9 digits is beyond a column.
    """
    def led(bare: Column) -> Column:
        count = F.length(bare).cast("string")
        return F.concat(F.length(count).cast("string"), count, bare)

    return bind(F.regexp_replace(digits, r"^0+(?=\d)", ""), led)


def natural_key(text: Column) -> Column:
    """Text key under which digit runs compare as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number_key(r)).otherwise(r)), "")


def version_key(version: Column) -> Column:
    """Text that sorts as versions do: epoch, numeric core without trailing zeros, stage (pre, final, post), tail.

    Every number is led by its count of digits, so numbers of any size compare as text; the mark
    between core and stage sorts before digits, so a shorter core comes first. An epoch is what stands
    before '!', 0 where there is none. Repeated groups are possessive: the JVM recurses on others, and
    a version text may be arbitrarily long.
    """
    whole = F.regexp_replace(F.trim(version), r"^[vV]", "")
    epoch = F.regexp_extract(whole, r"^(\d+)!", 1)
    bare = F.regexp_replace(whole, r"^\d+!", "")
    core = F.regexp_extract(bare, r"^\d+(?:\.\d+)*+", 0)
    tail = F.regexp_replace(bare, r"^\d+(?:\.\d+)*+", "")
    numbers = F.transform(F.split(F.regexp_replace(core, r"(?:\.0+)++$", ""), r"\."), number_key)

    def ending(rest: Column) -> Column:
        return (
            F.when((rest == "") | rest.startswith("+"), F.lit("!1"))
            .when(F.lower(rest).rlike(r"^[.-]?post"), F.concat(F.lit("!2"), natural_key(rest)))
            .otherwise(F.concat(F.lit("!0"), natural_key(rest)))
        )

    first = number_key(F.when(epoch == "", F.lit("0")).otherwise(epoch))
    return F.concat(first, F.array_join(numbers, ""), bind(tail, ending))


def strip_operators(spec: Column) -> Column:
    return F.regexp_replace(spec, r"^[>=<~!^]+", "")


def requested_version(ecosystem: Column, spec: Column) -> Column:
    """The one version a registry is asked for under a requirement; 'latest' when there is none."""
    npm = F.regexp_replace(spec, r"^[^\d]*", "")
    pypi = F.trim(strip_operators(spec))
    go = F.regexp_replace(strip_operators(spec), "^v", "")
    first = F.trim(strip_operators(F.substring_index(spec, ",", 1)))
    ruby = F.when(first.rlike(r"^\d+\.\d+"), first).otherwise(F.lit("latest"))
    bare = (
        F.when(ecosystem == "npm", npm)
        .when(ecosystem == "pypi", pypi)
        .when(ecosystem == "go", go)
        .when(ecosystem == "ruby", ruby)
        .otherwise(F.lit("latest"))
    )
    return F.when(bare == "", F.lit("latest")).otherwise(bare)


def pep503_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def registry_key(ecosystem: Column, name: Column, version: Column | None = None) -> Column:
    """Name as it appears in a registry address, with '@version' appended when one is given."""
    escaped_go = F.lower(F.regexp_replace(F.regexp_replace(name, r"""^["']+|["']+$""", ""), "([A-Z])", "!$1"))
    go = F.replace(F.url_encode(escaped_go), F.lit("%2F"), F.lit("/"))
    npm = F.when(
        name.startswith("@"), F.concat(F.lit("@"), F.url_encode(F.substring(name, 2, 1 << 30)))
    ).otherwise(F.url_encode(name))
    key = (
        F.when(ecosystem == "npm", npm)
        .when(ecosystem == "pypi", pep503_name(name))
        .when(ecosystem == "go", F.replace(go, F.lit("%21"), F.lit("!")))
        .otherwise(F.url_encode(name))
    )
    if version is None:
        return key
    return F.concat(key, F.lit("@"), version)


def is_dependency_confusion(name: Column) -> Column:
    """Published names that look like a company's internal packages."""
    return name.rlike(
        r"(?i)^@[^/]+/(internal|private|corp|shared|local)[/-]|^(internal|private|corp)-"
    )
