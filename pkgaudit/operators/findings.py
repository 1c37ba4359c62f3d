"""Findings of package reviews: candidates, prompts, verdicts and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgaudit import schemas
from pkgaudit.functions.json_text import extract_json
from pkgaudit.functions.paths import without_package_prefix
from pkgaudit.functions.severity import SEVERITIES, normalize_severity
from pkgaudit.operators.keys import PACKAGE, compute_once, first_per_key, package_label
from pkgaudit.operators.package_files import entry_points, suspicious_files
from pkgaudit.operators.triage import indicators_by_count

DEEP_CONFIDENCE = 0.3
# Characters of text in one part row; a longer text has more parts.
PART_LENGTH = 12_000

# Defaults for what a review leaves out.
DEFAULT_CATEGORY = "code-obfuscation"
DEFAULT_TITLE = "Unknown finding"
DEFAULT_REMEDIATION = "Review the package source code manually."


def gate_candidates(deps: DataFrame, vulns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies to review, and those left out for a known vulnerability above LOW."""
    known = (
        vulns.filter(~F.col("severity").eqNullSafe("LOW"))
        .select("ecosystem", F.col("package_name").alias("name"), F.col("package_version").alias("version"))
        .distinct()
    )
    return deps.join(known, PACKAGE, "left_anti"), deps.join(known, PACKAGE, "left_semi")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def text_parts(rows: DataFrame, text: str, length: int = PART_LENGTH) -> DataFrame:
    """A row for each part of the text, in column `text`, numbered from 1 in `part` of `parts`: nothing is cut off."""
    parts = F.greatest(F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / length), F.lit(1)).cast("int")
    numbered = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    return numbered.withColumn(text, F.substring(text, (F.col("part") - 1) * length + 1, F.lit(length)))


def file_prompts(plan: DataFrame, new_files: DataFrame | None = None, part_length: int = PART_LENGTH) -> DataFrame:
    """A prompt for every part of every planned file: (ordinal, package, path, part, parts, prompt).

    The plan carries the texts, so the file table is not read again.
    """
    rows = plan.withColumn("_inner", without_package_prefix(F.col("path")))
    if new_files is not None:
        fresh = new_files.select(
            *PACKAGE, F.col("path").alias("_inner"), F.col("previous_version").alias("_previous")
        )
        rows = rows.join(fresh, [*PACKAGE, "_inner"], "left")
    else:
        rows = rows.withColumn("_previous", F.lit(None).cast("string"))
    warning = F.when(
        F.col("_previous").isNotNull(),
        _text("\nNEW FILE: it was not part of the previous version (", F.col("_previous"),
              "). Added files are a common way in.\n"),
    ).otherwise(F.lit(""))
    shown = indicators_by_count(
        F.col("indicators"), lambda k, n: F.concat(k, F.lit(" ("), n.cast("string"), F.lit(" matches)"))
    )
    prompt = _text(
        'Review one file of package "', F.col("name"), '" for supply chain threats.', warning,
        "\n\nFile: ", F.col("path"), "\nTriage score: ", F.col("score").cast("string"),
        "\nCategories: ", F.array_join("categories", ", "), "\nIndicators: ", shown,
        "\n\nContent, part ", F.col("part").cast("string"), " of ", F.col("parts").cast("string"), ":\n",
        F.coalesce("content", F.lit("")),
        "\n\nReport every malicious behaviour found; report an empty list if the file is legitimate.",
    )
    return text_parts(rows, "content", part_length).select(
        "ordinal", *PACKAGE, "path", "part", "parts", prompt.alias("prompt"))


def package_prompts(metadata: DataFrame, packages: DataFrame) -> DataFrame:
    """Opening text per package from its metadata and signals; packages gives version and total_files."""
    none, unknown = F.lit("(none)"), F.lit("(unknown)")
    yes_no = lambda c: F.when(F.col(c), F.lit("yes")).otherwise(F.lit("no"))
    change = F.when(
        F.col("maintainer_changed"),
        _text("YES, was ", F.array_join("previous_maintainers", ", "), ", new ", F.array_join("new_maintainers", ", ")),
    ).otherwise(F.lit("no"))
    prompt = _text(
        "Review this ", F.col("ecosystem"), " package for supply chain threats.\n\nPackage: ",
        package_label(F.col("name"), F.col("version")),
        "\nDescription: ", F.coalesce("description", none), "\nLicense: ", F.coalesce("license", none),
        "\nWeekly downloads: ", F.format_number("weekly_downloads", 0),
        "\nCreated: ", F.col("created_at"), "\nUpdated: ", F.col("updated_at"),
        "\nMaintainers: ", F.coalesce(F.nullif(F.array_join("maintainers", ", "), F.lit("")), unknown),
        "\nRepository: ", F.coalesce("repository_url", none),
        "\nInstall scripts: ", yes_no("has_install_scripts"),
        "\nTotal files: ", F.col("total_files").cast("string"),
        "\nRisk score: ", F.col("risk_score").cast("string"), "/10",
        F.when(F.col("risk_score") >= 5, F.lit(" HIGH")).otherwise(F.lit("")),
        "\nMaintainer change: ", change,
        "\nPackage age: ", F.coalesce(F.col("package_age_days").cast("string"), unknown), " days",
        "\nPublished days ago: ", F.coalesce(F.col("published_days_ago").cast("string"), unknown),
        "\nTyposquat candidate: ", F.coalesce("typosquat_candidate", F.lit("none")),
        "\nDependency confusion risk: ", yes_no("is_dependency_confusion"),
        "\nProvenance: ", yes_no("has_provenance"),
    )
    return packages.join(metadata, ["ecosystem", "name"]).select(*PACKAGE, prompt.alias("prompt"))


def deep_prompts(findings: DataFrame) -> DataFrame:
    """One question per finding to look at again. The code to look at comes from package_context,
    once per package and not once per finding."""
    prompt = _text(
        'A first review flagged package "', package_label(F.col("package_name"), F.col("package_version")), '" (',
        F.col("ecosystem"), ").\n\nCategory: ", F.col("category"), "\nSeverity: ", F.col("severity"),
        "\nConfidence: ", F.col("confidence").cast("string"), "\nTitle: ", F.col("title"),
        "\nDescription: ", F.coalesce("description", F.lit("")), "\nEvidence: ", F.coalesce("evidence", F.lit("")),
        "\n\nConfirm, downgrade or dismiss it against the package's code. Answer as JSON with verdict, "
        "adjustedSeverity, adjustedConfidence, attackChain, dataAtRisk, remediation and reasoning.",
    )
    return needs_deep(findings).select(
        *_key_of(findings), "ecosystem", "package_name", "package_version", prompt.alias("prompt")
    )


def package_context(findings: DataFrame, files: DataFrame, scripts: DataFrame) -> DataFrame:
    """(package, section, label, part, parts, text) rows of the code behind the findings to look at again.

    Rows, not one text per package: a large package gives many rows and no large value, a long text
    several parts. scripts holds (package, hook, content). Every path is a listing row without text.
    Files are picked by their paths before they meet the packages, so only the texts shown are moved.
    """
    wanted = needs_deep(findings).select(
        "ecosystem", F.col("package_name").alias("name"), F.col("package_version").alias("version")
    ).distinct()
    script_rows = scripts.join(wanted, PACKAGE, "left_semi").select(
        *PACKAGE, F.lit("install script").alias("section"), F.col("hook").alias("label"), F.col("content").alias("text")
    )
    suspicious = suspicious_files(files).join(wanted, PACKAGE, "left_semi").select(
        *PACKAGE, F.lit("suspicious file").alias("section"), F.col("path").alias("label"), F.col("content").alias("text"),
    )
    entry_rows = entry_points(files, keep=("content",)).join(wanted, PACKAGE, "left_semi").select(
        *PACKAGE, F.lit("entry point").alias("section"), F.col("path").alias("label"), F.col("content").alias("text"),
    )
    listed = files.select(*PACKAGE, "path").join(wanted, PACKAGE, "left_semi").select(
        *PACKAGE, F.lit("listing").alias("section"), F.col("path").alias("label"), F.lit("").alias("text"))
    rows = reduce(DataFrame.unionByName, [script_rows, suspicious, entry_rows, listed])
    return text_parts(rows, "text").select(*PACKAGE, "section", "label", "part", "parts", "text")


def json_in(responses: DataFrame, column: str = "response") -> DataFrame:
    """Responses with the JSON part of their text in column 'json'."""
    return compute_once(responses, "json", extract_json(F.col(column)))


def normalize_findings(responses: DataFrame) -> DataFrame:
    """Findings listed in review responses, with defaults for what is missing or out of range."""
    listed = json_in(responses).filter(F.col("json").startswith("["))
    rows = listed.select(
        *[c for c in responses.columns if c != "response"],
        F.posexplode_outer(F.from_json("json", schemas.REVIEW_FINDINGS)).alias("position", "_f"),
    ).filter(F.col("_f").isNotNull())
    confidence = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_f.confidence"))), F.lit(0.5))
    return rows.select(
        *[c for c in responses.columns if c != "response"], "position",
        F.coalesce("_f.category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        normalize_severity(F.col("_f.severity"), "MEDIUM").alias("severity"),
        F.when(F.col("_f.confidence").isNull(), F.lit(0.5)).otherwise(confidence).alias("confidence"),
        F.coalesce("_f.title", F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce("_f.description", F.lit("")).alias("description"),
        F.coalesce("_f.evidence", F.lit("")).alias("evidence"),
        F.coalesce("_f.remediation", F.lit(DEFAULT_REMEDIATION)).alias("remediation"),
        F.lit(False).alias("deep_investigated"),
    )


def _key_of(*tables: DataFrame) -> list[str]:
    """A finding is known by its response's ordinal and its position in the response, where there is one."""
    return [c for c in ("ordinal", "position") if all(c in t.columns for t in tables)]


def verdicts_in(responses: DataFrame) -> DataFrame:
    """Verdict rows out of deep review responses that hold a JSON object, keyed as the findings they answer."""
    parsed = json_in(responses).filter(F.col("json").startswith("{"))
    key = _key_of(responses)
    return parsed.select(*key, F.from_json("json", schemas.REVIEW_VERDICT).alias("v")).select(
        *key, "v.verdict", F.col("v.adjustedSeverity").alias("adjusted_severity"),
        F.col("v.adjustedConfidence").alias("adjusted_confidence"), F.col("v.attackChain").alias("attack_chain"),
        F.col("v.dataAtRisk").alias("data_at_risk"), F.col("v.remediation").alias("remediation"),
    )


def is_severe() -> Column:
    return F.col("severity").isin("CRITICAL", "HIGH")


def needs_deep(findings: DataFrame) -> DataFrame:
    """Findings to look at again."""
    return findings.filter(is_severe() & (F.col("confidence") >= DEEP_CONFIDENCE))


def deep_route(findings: DataFrame) -> DataFrame:
    """One row: whether there is any severe finding at all."""
    return findings.agg(F.coalesce(F.bool_or(is_severe()), F.lit(False)).alias("deep_investigation"))


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after the deep review: dismissed ones dropped, the others adjusted.

    When the review would dismiss every finding it looked at, all are kept as they were. Verdicts meet
    findings on ordinal and position; of several verdicts on one finding the least by its texts counts.
    """
    key = _key_of(findings, verdicts)
    if "position" in findings.columns and "position" not in verdicts.columns:
        raise ValueError("verdicts on findings with a position need it too")
    rest = [c for c in verdicts.columns if c not in key]
    answer = first_per_key(verdicts, key, F.struct(*rest)).select(
        *key, F.upper(F.coalesce("verdict", F.lit(""))).alias("_verdict"), F.col("adjusted_severity").alias("_sev"),
        F.col("adjusted_confidence").alias("_conf"), F.col("attack_chain").alias("_chain"),
        F.col("data_at_risk").alias("_risk"), F.col("remediation").alias("_fix"),
    )
    deep = is_severe() & (F.col("confidence") >= DEEP_CONFIDENCE)
    joined = (
        findings.join(answer, key, "left")
        .withColumn("_deep", deep)
        .withColumn("_dismissed", F.col("_deep") & F.coalesce(F.col("_verdict") == "FALSE_POSITIVE", F.lit(False)))
    )
    kept = joined.filter(F.col("_deep") & ~F.col("_dismissed")).agg(F.count(F.lit(1))).scalar()
    adjusted = F.col("_deep") & F.col("_verdict").isNotNull() & ~F.col("_dismissed")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_conf")))
    chain = _text(
        F.coalesce("description", F.lit("")), "\n\nAttack chain: ", F.col("_chain"), "\nData at risk: ",
        F.coalesce("_risk", F.lit("Unknown")),
    )
    new = {
        "severity": F.coalesce(normalize_severity(F.col("_sev"), None), F.col("severity")),
        "confidence": F.when(F.col("_conf").isNotNull(), clamped).otherwise(F.col("confidence")),
        "description": F.when(F.coalesce("_chain", F.lit("")) != "", chain).otherwise(F.col("description")),
        "remediation": F.coalesce("_fix", "remediation"),
        "deep_investigated": F.lit(True),
    }
    return joined.filter(~F.col("_dismissed") | (kept == 0)).select(*[
        F.when(adjusted, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in findings.columns
    ])


FINDING_KEY = ["ecosystem", "package_name", "package_version", "category", "title"]


def aggregate_findings(findings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """First finding of every package, category and title; a sink puts them in order, worst and surest first."""
    order = F.struct(ordinal, "position") if "position" in findings.columns else F.col(ordinal)
    return first_per_key(findings, FINDING_KEY, order)


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row of counters; packages are counted from per-package partial counts."""
    severities = SEVERITIES[:4]
    per_package = findings.groupBy("ecosystem", "package_name", "package_version").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in severities]
    )
    zero = F.lit(0).cast("bigint")
    return per_package.agg(
        F.count(F.lit(1)).alias("packages_with_findings"), F.coalesce(F.sum("n"), zero).alias("total_findings"),
        *[F.coalesce(F.sum(s.lower()), zero).alias(s.lower()) for s in severities],
    )


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n_findings"))
