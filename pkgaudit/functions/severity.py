"""Severity order, buckets and the CVSS 3 base score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgaudit.functions.binding import bind

# Severity names from worst to mildest.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN")

# Lowest score that each bucket stands for.
SEVERITY_FLOORS = {"CRITICAL": 9.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 0.1, "UNKNOWN": 0.0}

# Words in an advisory that decide its severity when no score is given.
CRITICAL_WORDS = (
    "malicious package",
    "malicious code",
    "backdoor",
    "trojan",
    "stealer",
    "credential harvesting",
    "credential harvester",
    "exfiltrat",
    "supply chain attack",
    "automatically activated malware",
)
HIGH_WORDS = (
    "remote code execution",
    "arbitrary code execution",
    "command execution",
    "sql injection",
    "template injection",
    "server-side request forgery",
    "authentication bypass",
    "privilege escalation",
    "sandbox escape",
    "path traversal",
)
MEDIUM_WORDS = (
    "prototype pollution",
    "deserialization",
    "cross-site scripting",
    "information disclosure",
    "denial of service",
    "xxe",
    "xml external entity",
    "open redirect",
)

# CVSS 3 metric weights.
CVSS_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"L": 0.22, "H": 0.56},
    "I": {"L": 0.22, "H": 0.56},
    "A": {"L": 0.22, "H": 0.56},
}
PRIVILEGE_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGE_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}


def _lookup(key: Column, table: dict, default) -> Column:
    whens = reduce(
        lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:],
        F.when(key == next(iter(table)), F.lit(next(iter(table.values())))),
    )
    return whens.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL up to 4 for UNKNOWN; 5 for anything else."""
    return _lookup(severity, {name: rank for rank, name in enumerate(SEVERITIES)}, len(SEVERITIES))


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def normalize_severity(value: Column, default: str | None) -> Column:
    """Upper-cased value when it is one of the four real levels, else the default."""
    upper = F.upper(value)
    return F.when(upper.isin(*SEVERITIES[:4]), upper).otherwise(F.lit(default).cast("string"))


def severity_floor(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_FLOORS, 0.0)


def severity_bucket(score: Column) -> Column:
    """CRITICAL from 9, HIGH from 7, MEDIUM from 4, else LOW; null stays null."""
    return bind(
        score,
        lambda s: F.when(s >= 9.0, F.lit("CRITICAL"))
        .when(s >= 7.0, F.lit("HIGH"))
        .when(s >= 4.0, F.lit("MEDIUM"))
        .when(s.isNotNull(), F.lit("LOW")),
    )


def _weight(metric: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[metric], F.lit(0.0))


def _vector_score(m: Column) -> Column:
    """Base score from the metric letters of a vector."""
    unchanged = m["S"].isin("", "U")
    privilege = F.when(unchanged, _weight(m["PR"], PRIVILEGE_UNCHANGED)).otherwise(
        _weight(m["PR"], PRIVILEGE_CHANGED)
    )
    kept = [1.0 - _weight(m[k], CVSS_WEIGHTS[k]) for k in ("C", "I", "A")]
    parts = F.struct(
        unchanged.alias("unchanged"),
        (1.0 - kept[0] * kept[1] * kept[2]).alias("loss"),
        (
            8.22 * _weight(m["AV"], CVSS_WEIGHTS["AV"]) * _weight(m["AC"], CVSS_WEIGHTS["AC"]) * privilege
            * _weight(m["UI"], CVSS_WEIGHTS["UI"])
        ).alias("ease"),
    )

    def total(p: Column) -> Column:
        impact = F.when(p["unchanged"], 6.42 * p["loss"]).otherwise(
            7.52 * (p["loss"] - 0.029) - 3.25 * F.pow(p["loss"] - 0.02, F.lit(15.0))
        )
        return bind(impact, lambda i: F.when(i <= 0, F.lit(0.0)).otherwise(
            F.least(F.when(p["unchanged"], i + p["ease"]).otherwise(1.08 * (i + p["ease"])), F.lit(10.0))
        ))

    return F.ceil(bind(parts, total) * 10).cast("double") / 10.0


def cvss3_score(value: Column) -> Column:
    """Base score of a CVSS 3.x vector; other text gives its leading number or null."""
    letters = F.struct(*[
        F.regexp_extract(value, f"^.*/{k}:([^/:]*)", 1).alias(k) for k in ("AV", "AC", "PR", "UI", "S", "C", "I", "A")
    ])
    number = F.regexp_extract(
        F.split_part(value, F.lit("/"), F.lit(1)), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    )
    return F.when(value.startswith("CVSS:3."), bind(letters, _vector_score)).otherwise(
        F.nullif(number, F.lit("")).try_cast("double")
    )


def infer_severity_from_text(id_col: Column, summary: Column, details: Column) -> Column:
    """Severity of an advisory that carries no score, from its id and wording."""
    text = F.lower(F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), F.coalesce(details, F.lit(""))))

    def grade(t: Column) -> Column:
        def mentions(words) -> Column:
            return reduce(lambda a, b: a | b, [t.contains(w) for w in words])

        return (
            F.when(mentions(CRITICAL_WORDS), F.lit("CRITICAL"))
            .when(mentions(HIGH_WORDS), F.lit("HIGH"))
            .when(mentions(MEDIUM_WORDS), F.lit("MEDIUM"))
            .otherwise(F.lit("UNKNOWN"))
        )

    return F.when(F.upper(id_col).startswith("MAL-"), F.lit("CRITICAL")).otherwise(bind(text, grade))
