"""Triage: rank package files by how suspicious their text and place are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit.functions import paths
from pkgaudit.functions.binding import bind
from pkgaudit.functions.indicators import literals_in, match_counts
from pkgaudit.functions.labels import half_up
from pkgaudit.operators.keys import PACKAGE, compute_once

# Indicators that count as network or execution activity in combinations.
NETWORK_NAMES = (
    "http-request-api", "http-post-data", "curl-wget-nc", "fetch-xhr", "socket-connect", "dns-exfil", "known-c2",
    "metadata-endpoint", "telegram-exfil", "discord-webhook", "suspicious-tld", "python-urllib",
    "python-socket-connect", "python-http-client",
)
EXEC_NAMES = (
    "dynamic-exec", "subprocess-launch", "child-process", "dynamic-import", "python-compile-exec",
    "python-os-system", "python-pty-spawn", "python-pip-install", "chr-obfuscation", "exec-chr-combo",
)

MIN_SCORE = 8


def indicator_counts(files: DataFrame) -> DataFrame:
    """Files with column 'counts': the indicators found, with numbers of matches. Whole texts, one pass per row."""
    lowered = files.withColumn("_lower", F.lower("content"))
    marked = lowered.withColumn("_found", literals_in(F.col("_lower")))
    return compute_once(marked, "counts", match_counts("content", "_lower", "_found")).drop("_lower", "_found")


def base_scores(counted: DataFrame) -> DataFrame:
    """Files with any indicator: summed score, indicator map and categories, in order of the catalogue."""
    counts = F.col("counts")
    return counted.filter(F.size(counts) > 0).withColumns({
        "score": F.aggregate(
            counts, F.lit(0).cast("bigint"), lambda acc, c: acc + (c["weight"] * c["count"]).cast("bigint")
        ),
        "indicators": F.map_from_entries(F.transform(counts, lambda c: F.struct(c["name"], c["count"]))),
        "categories": F.array_distinct(F.transform(counts, lambda c: c["category"])),
    }).drop("counts")


def compound_multiplier(score: Column, categories: Column) -> Column:
    """Score raised for two categories, and more for three and above."""
    n = F.size(categories)
    return bind(
        score, lambda s: F.when(n >= 3, half_up(s * 2.5)).when(n == 2, half_up(s * 1.8)).otherwise(s)
    )


def combo_bonuses(score: Column, indicators: Column) -> Column:
    """Score with the bonuses of indicator combinations, and at least 8 for the two worst indicators."""
    names = F.map_keys(indicators)

    def has(*any_name: str) -> Column:
        return F.arrays_overlap(names, F.array(*[F.lit(n) for n in any_name]))

    network, execution = has(*NETWORK_NAMES), has(*EXEC_NAMES)
    bonuses = (
        (has("install-script") & (network | execution), 10),
        (has("python-setup-override") & (network | execution), 10),
        (has("env-bulk-dump", "credential-files") & network, 8),
        (has("base64-decode-exec") & execution, 6),
        (has("python-pip-install") & has("hex-base64-blob", "encoded-powershell"), 6),
        (has("child-process") & has("curl-wget-nc"), 6),
    )
    total = score
    for condition, points in bonuses:
        total = total + F.when(condition, points).otherwise(0)
    least = F.when(has("exec-chr-combo", "known-c2"), MIN_SCORE).otherwise(0).cast("bigint")
    return F.greatest(total, least)


def path_adjustments(score: Column, path: Column) -> Column:
    """Score scaled by where the file lies, rounded after every step."""
    low, high = paths.any_of(paths.LOW_VALUE_PATHS), paths.any_of(paths.HIGH_VALUE_PATHS)
    steps = (
        lambda s: F.when(path.rlike(low), half_up(s * 0.3)).otherwise(s),
        lambda s: F.when(path.rlike(high), half_up(s * 1.5)).otherwise(s),
        lambda s: F.when(path.startswith("package.json:"), s * 3).otherwise(s),
        lambda s: F.when(
            path.rlike(r"(?i)\.min\.js$"), half_up(F.when(s < 6, s * 0.3).otherwise(s * 1.2))
        ).otherwise(s),
    )
    for step in steps:
        score = bind(score, step)
    return score


def triage(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scored files with any indicator, in one narrow pass over the texts; keep names further columns to carry."""
    columns = [*PACKAGE, "ordinal", "path", "content", *[c for c in keep if c != "content"]]
    scored = base_scores(indicator_counts(files.select(*columns)))
    raised = compound_multiplier(F.col("score"), F.col("categories"))
    final = path_adjustments(combo_bonuses(raised, F.col("indicators")), F.col("path"))
    return compute_once(scored, "score", final).select(
        "ordinal", *PACKAGE, "path", "score", "indicators", "categories", *keep
    )


def indicators_by_count(indicators: Column, fmt) -> Column:
    """Text of the indicators, most matches first, catalogue order among equals."""
    keyed = F.transform(
        F.map_entries(indicators), lambda e, i: F.struct((-e["value"]).alias("n"), i.alias("i"), e["key"].alias("k"))
    )
    return F.array_join(F.transform(F.sort_array(keyed), lambda x: fmt(x["k"], -x["n"])), ", ")


def triage_report(triaged: DataFrame, files: DataFrame) -> DataFrame:
    """The report as line rows: per package a head (score null), and a line for each file found.

    A sink puts the lines in order: head first, then by falling score and rising ordinal. No package's
    lines ever meet in one place.
    """
    totals = files.groupBy(*PACKAGE).agg(F.count(F.lit(1)).alias("n_files"))
    found = triaged.groupBy(*PACKAGE).agg(F.count(F.lit(1)).alias("n_found"))
    head = F.format_string("Scanned %d files. Found indicators in %d files.", "n_files", "n_found")
    heads = totals.join(found, PACKAGE, "left").select(
        *PACKAGE, F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("ordinal"),
        F.when(F.col("n_found").isNull(), F.lit("No threat indicators found in any file.")).otherwise(head).alias("line"))
    shown = indicators_by_count(F.col("indicators"), lambda k, n: F.concat(k, F.lit("("), n.cast("string"), F.lit(")")))
    line = F.concat(
        F.lit("[score: "), F.col("score").cast("string"), F.lit("] "), F.col("path"),
        F.lit("\n   categories: "), F.array_join("categories", "+"), F.lit(" | indicators: "), shown)
    lines = triaged.select(
        *PACKAGE, F.col("score").cast("double").alias("score"), F.col("ordinal").cast("bigint").alias("ordinal"),
        line.alias("line"))
    return heads.unionByName(lines)


def investigation_plan(triaged: DataFrame, threshold: int = MIN_SCORE) -> DataFrame:
    """Files to look into: all at the threshold, with is_trigger for those that run at install time.

    Who can look into few files only takes the triggers and the best scores first; none is left out here.
    """
    return triaged.filter(F.col("score") >= threshold).withColumn("is_trigger", F.col("path").rlike(paths.INSTALL_TRIGGER))
