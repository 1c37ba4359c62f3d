"""Advisory matching and severity over the dependency and advisory views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import view, with_views
from pkgaudit.functions.severity import (
    cvss3_score,
    infer_severity_from_text,
    normalize_severity,
    severity_bucket,
)
from pkgaudit.operators import advisories as adv
from pkgaudit.plans import scan


def _advisories(spark, sf_dir):
    return adv.parse_advisories(view(spark, sf_dir, "fx_adv_docs"))


def _hits(spark, sf_dir):
    return adv.match_advisories(view(spark, sf_dir, "fx_star_deps"), _advisories(spark, sf_dir))


def _flat_vulns(df):
    return df.withColumn("references", F.array_join("references", "; "))


def advisory_queries(spark, sf_dir):
    return adv.advisory_queries(view(spark, sf_dir, "fx_star_deps"))


def match_advisories(spark, sf_dir):
    return _hits(spark, sf_dir)


def backfill_advisory_details(spark, sf_dir):
    docs = view(spark, sf_dir, "fx_adv_docs")
    details = adv.parse_advisories(docs.filter("k % 7 <> 0")).withColumn("summary", F.lit("from detail"))
    return adv.backfill_advisory_details(adv.parse_advisories(docs), details).select("id", "summary")


def cvss3(spark, sf_dir):
    return view(spark, sf_dir, "fx_adv").select("id", "vector", cvss3_score(F.col("vector")).alias("score"))


def severity_buckets(spark, sf_dir):
    return view(spark, sf_dir, "fx_vulns").select("ordinal", severity_bucket(F.col("cvss")).alias("bucket"))


def advisory_severity(spark, sf_dir):
    return _advisories(spark, sf_dir).select("id", adv.advisory_severity().alias("severity"))


# Details of advisories from version 1 on; the others have none.
DETAILS = "case when introduced = '1.0.0' then 'A crafted name leads to Remote Code Execution.' end"


def severity_from_text(spark, sf_dir):
    text = infer_severity_from_text(F.col("id"), F.col("summary"), F.expr(DETAILS))
    return view(spark, sf_dir, "fx_adv").select("id", text.alias("severity"))


def advisory_cvss(spark, sf_dir):
    scored = _advisories(spark, sf_dir).withColumn("sev", adv.advisory_severity())
    return scored.select("id", adv.advisory_cvss(F.col("sev")).alias("cvss"))


def fixed_versions(spark, sf_dir):
    return _advisories(spark, sf_dir).select("id", adv.fixed_versions().alias("fixed_versions"))


def affected_versions(spark, sf_dir):
    return _advisories(spark, sf_dir).select("id", adv.affected_versions().alias("affected_versions"))


def to_vulnerability(spark, sf_dir):
    return _flat_vulns(adv.to_vulnerability(_hits(spark, sf_dir), _advisories(spark, sf_dir)))


def vulnerable_packages(spark, sf_dir):
    return scan.vulnerable_packages(view(spark, sf_dir, "fx_star_deps"), view(spark, sf_dir, "fx_adv_docs"))


def union_sources(spark, sf_dir):
    first = view(spark, sf_dir, "fx_vulns")
    second = first.withColumn("title", F.lit("second source")).drop("cvss")
    return adv.union_sources(first, None, second).drop("package_published_ts")


def dedup_vulnerabilities(spark, sf_dir):
    return adv.dedup_vulnerabilities(view(spark, sf_dir, "fx_vulns")).drop("package_published_ts")


def order_by_severity(spark, sf_dir):
    return adv.order_by_severity(view(spark, sf_dir, "fx_vulns")).select("ordinal", "severity")


def severity_summary(spark, sf_dir):
    return adv.severity_summary(view(spark, sf_dir, "fx_vulns"))


def normalized_severities(spark, sf_dir):
    raw = F.lower("severity")
    return view(spark, sf_dir, "fx_vulns").select(
        "ordinal",
        normalize_severity(raw, "UNKNOWN").alias("audit"),
        normalize_severity(raw, "MEDIUM").alias("review"),
        normalize_severity(raw, None).alias("verdict"),
    )


def cvss_sql(v: str) -> str:
    """CVSS 3 base score of column v in DuckDB SQL."""

    def metric(key):
        return f"regexp_extract({v}, '/{key}:([^/:]*)', 1)"

    def weight(key, pairs):
        whens = " ".join(f"when '{k}' then {w}::double" for k, w in pairs.items())
        return f"(case {metric(key)} {whens} else 0::double end)"

    unchanged = f"{metric('S')} in ('', 'U')"
    impact3 = {"L": 0.22, "H": 0.56}
    pr = (f"(case when {unchanged} then {weight('PR', {'N': .85, 'L': .62, 'H': .27})} "
          f"else {weight('PR', {'N': .85, 'L': .68, 'H': .5})} end)")
    loss = (f"(1::double - (1::double - {weight('C', impact3)}) * (1::double - {weight('I', impact3)})"
            f" * (1::double - {weight('A', impact3)}))")
    expl = (f"(8.22::double * {weight('AV', {'N': .85, 'A': .62, 'L': .55, 'P': .2})} * "
            f"{weight('AC', {'L': .77, 'H': .44})} * {pr} * {weight('UI', {'N': .85, 'R': .62})})")
    impact = (f"(case when {unchanged} then 6.42::double * {loss} else 7.52::double * ({loss} - 0.029::double) "
              f"- 3.25::double * pow({loss} - 0.02::double, 15::double) end)")
    total = f"(case when {unchanged} then 1::double else 1.08::double end) * ({impact} + {expl})"
    base = f"(case when {impact} <= 0 then 0::double else least({total}, 10::double) end)"
    return (f"(case when {v} like 'CVSS:3.%' then ceil({base} * 10::double) / 10::double "
            f"else try_cast(split_part({v}, '/', 1) as double) end)")


def bucket_sql(s: str) -> str:
    return (f"(case when {s} is null then null when {s} >= 9 then 'CRITICAL' when {s} >= 7 then 'HIGH' "
            f"when {s} >= 4 then 'MEDIUM' else 'LOW' end)")


def key_sql(v: str) -> str:
    return (f"list_transform(string_split(regexp_replace({v}, '(\\.0+)+$', ''), '.'), "
            "lambda x: cast(x as bigint))")


def stopped(stop: str, start: str = "") -> str:
    """The version asked for lies before a stop, or the stop before the start of the interval."""
    behind = f" or {key_sql(stop)} <= {key_sql(start)}" if start else ""
    return f"({stop} is null or {key_sql('query_version')} < {key_sql(stop)}{behind})"


TEXT_SQL = (
    "case when upper(id) like 'MAL-%' then 'CRITICAL' when lower(summary) like '%backdoor%' then 'CRITICAL' "
    "when lower(summary) like '%remote code execution%' then 'HIGH' "
    "when lower(summary) like '%prototype pollution%' or lower(summary) like '%denial of service%' then 'MEDIUM' "
    "else 'UNKNOWN' end"
)

WORDING = f"lower(concat_ws(' ', summary, {DETAILS}))"

FACTS_SQL = with_views("fx_star_deps", "fx_adv_flat") + f""",
scored as (
  select *, {cvss_sql('vector')} as vector_score, {TEXT_SQL} as text_severity,
   case db_severity when 'CRITICAL' then 9.0::double when 'HIGH' then 7.0::double when 'LOW' then 0.1::double
     when 'UNKNOWN' then 0::double end as db_score
  from fx_adv_flat),
graded as (
  select *, coalesce({bucket_sql('vector_score')},
     {bucket_sql('coalesce(cast(database_score as double), db_score)')},
     {bucket_sql('cast(package_score as double)')}, text_severity) as severity
  from scored),
facts as (
  select k, id, osv_ecosystem, name, introduced, fixed, early_fixed, listed, severity,
   coalesce(vector_score, case severity when 'CRITICAL' then 9.0::double when 'HIGH' then 7.0::double
     when 'MEDIUM' then 4.0::double when 'LOW' then 0.1::double else 0::double end) as cvss,
   case when k % 4 = 0 then id else summary end as title,
   case when k % 4 = 1 then summary else 'Details of ' || summary end as description,
   case when k % 6 = 0 then '' else 'https://nvd.nist.gov/vuln/detail/CVE-2020-' || k
     || '; https://www.example.com/a' end as "references",
   '>=' || introduced || coalesce(' <' || fixed, '') || coalesce(', ' || listed || ', 9.9.9', '') as affected_versions,
   case when early_fixed is null then fixed when fixed is null or fixed = early_fixed then early_fixed
     else early_fixed || ', ' || fixed end as fixed_versions,
   '2023-01-0' || (1 + k % 9) || 'T00:00:00Z' as published_date, 'OSV' as source
  from graded),
wanted as (
  select distinct ecosystem, name, version, case ecosystem when 'npm' then 'npm' when 'pypi' then 'PyPI'
   when 'cargo' then 'crates.io' when 'go' then 'Go' else 'RubyGems' end as osv_ecosystem,
   case when version <> '*' then version end as query_version
  from fx_star_deps),
hits as (
  select distinct w.ecosystem, w.name, w.version, f.id
  from wanted w join facts f on f.osv_ecosystem = w.osv_ecosystem and f.name = w.name
  where query_version is null or query_version in (listed, '9.9.9')  and listed is not null
   or ({key_sql('introduced')} <= {key_sql('query_version')} and {stopped('fixed', 'introduced')} and {stopped('early_fixed', 'introduced')})
   or (early_fixed is not null and {stopped('fixed')} and {stopped('early_fixed')}))
"""

VULNS_SQL = """select h.id, h.name as package_name, h.version as package_version, h.ecosystem, severity, title,
 description, cvss, "references", affected_versions, fixed_versions, published_date, source
from hits h join facts f on f.id = h.id"""

QUERIES = {
    f.__name__: f
    for f in (
        advisory_queries, match_advisories, backfill_advisory_details, cvss3, severity_buckets,
        advisory_severity, severity_from_text, advisory_cvss, fixed_versions, affected_versions,
        to_vulnerability, vulnerable_packages, union_sources, dedup_vulnerabilities, order_by_severity, severity_summary,
        normalized_severities,
    )
}

ORACLES = {
    "advisory_queries": FACTS_SQL + "select ecosystem, name, version, osv_ecosystem, query_version from wanted",
    "match_advisories": FACTS_SQL + "select ecosystem, name, version, id from hits",
    "backfill_advisory_details": with_views("fx_adv_flat") + """select id, case when vector is null and k % 7 <> 0
 then 'from detail' when k % 4 = 0 then null else summary end as summary from fx_adv_flat""",
    "cvss3": with_views("fx_adv") + f"select id, vector, {cvss_sql('vector')} as score from fx_adv",
    "severity_buckets": with_views("fx_vulns") + f"select ordinal, {bucket_sql('cvss')} as bucket from fx_vulns",
    "advisory_severity": FACTS_SQL + "select id, severity from facts",
    "severity_from_text": with_views("fx_adv") + f"select id, {TEXT_SQL.replace('lower(summary)', WORDING)} as severity from fx_adv",
    "advisory_cvss": FACTS_SQL + "select id, cvss from facts",
    "fixed_versions": FACTS_SQL + "select id, fixed_versions from facts",
    "affected_versions": FACTS_SQL + "select id, affected_versions from facts",
    "to_vulnerability": FACTS_SQL + VULNS_SQL,
    "vulnerable_packages": FACTS_SQL + f""", vulns as ({VULNS_SQL})
select ecosystem, package_name, package_version, case min(case severity when 'CRITICAL' then 0 when 'HIGH' then 1
  when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end) when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM'
  when 3 then 'LOW' else 'UNKNOWN' end as highest_severity, count(*) as static_count, 0 as supply_chain_count
from vulns group by 1, 2, 3""",
    "union_sources": with_views("fx_vulns") + """select ordinal, id, ecosystem, package_name, package_version, severity,
 title, cvss, reference, 0 as source_rank from fx_vulns
union all select ordinal, id, ecosystem, package_name, package_version, severity, 'second source', null, reference, 1
from fx_vulns""",
    "dedup_vulnerabilities": with_views("fx_vulns") + """, ranked as (
 select *, max(case severity when 'CRITICAL' then 2 when 'HIGH' then 1 else 0 end)
   over (partition by id, ecosystem, package_name, package_version) as top from fx_vulns),
picked as (select *, row_number() over (partition by id, ecosystem, package_name, package_version
   order by case when top = 0 then ordinal else -ordinal end) as rn
 from ranked where top = case severity when 'CRITICAL' then 2 when 'HIGH' then 1 else 0 end)
select ordinal, id, ecosystem, package_name, package_version, severity, title, cvss, reference
from picked where rn = 1""",
    "order_by_severity": with_views("fx_vulns") + "select ordinal, severity from fx_vulns",
    "severity_summary": with_views("fx_vulns") + """select count(*) as total,
 count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high,
 count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low,
 count(*) filter (severity = 'UNKNOWN') as unknown from fx_vulns""",
    "normalized_severities": with_views("fx_vulns") + """select ordinal,
 case when severity in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') then severity else 'UNKNOWN' end as audit,
 case when severity in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') then severity else 'MEDIUM' end as review,
 case when severity in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') then severity end as verdict from fx_vulns""",
}
