"""Candidates, prompts, verdicts and summaries of package reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import triage_checks
from checks.common import AS_OF, view, with_views
from pkgaudit.operators import findings as fnd
from pkgaudit.operators import package_files, registry, triage
from pkgaudit.operators.keys import PACKAGE
from pkgaudit.session import cut_lineage


def _findings(spark, sf_dir):
    return view(spark, sf_dir, "fx_findings_full").drop("verdict")


def _gate(spark, sf_dir):
    vulns = view(spark, sf_dir, "fx_vulns_libs").withColumn(
        "severity", F.when(F.col("ordinal") % 3 == 0, F.lit("HIGH")).otherwise(F.lit("LOW")))
    return fnd.gate_candidates(view(spark, sf_dir, "fx_lib_deps"), vulns)


def gate_candidates(spark, sf_dir):
    return _gate(spark, sf_dir)[0].select("ordinal", *PACKAGE)


def gate_blocked(spark, sf_dir):
    return _gate(spark, sf_dir)[1].select("ordinal", *PACKAGE)


def file_prompts(spark, sf_dir):
    files = triage_checks._files(spark, sf_dir)
    plan = triage.investigation_plan(cut_lineage(triage.triage(files, keep=("content",)).filter("score >= 8")))
    current = files.withColumn("previous_version", F.when(F.col("version") == "1.1.0", F.lit("1.0.0")))
    return fnd.file_prompts(plan, package_files.new_files_in_version(current, files))


def package_prompts(spark, sf_dir):
    packages = view(spark, sf_dir, "fx_libs").select(*PACKAGE, (F.col("n") + 1).alias("total_files"))
    metadata = registry.package_metadata(view(spark, sf_dir, "fx_docs"), AS_OF)
    return fnd.package_prompts(metadata, packages)


def deep_prompts(spark, sf_dir):
    return fnd.deep_prompts(_findings(spark, sf_dir))


def package_context(spark, sf_dir):
    files = view(spark, sf_dir, "fx_sized_files")
    keys = files.select(*PACKAGE).distinct().withColumn("ordinal", F.lit(1))
    found = keys.select(
        "ordinal", "ecosystem", F.col("name").alias("package_name"), F.col("version").alias("package_version"),
        F.when(F.col("ecosystem").isin("npm", "pypi"), F.lit("HIGH")).otherwise(F.lit("LOW")).alias("severity"),
        F.lit(0.9).alias("confidence"),
    )
    scripts = view(spark, sf_dir, "fx_hooks").withColumnRenamed("command", "content")
    return fnd.package_context(found, files, scripts)


def extract_json(spark, sf_dir):
    return fnd.json_in(view(spark, sf_dir, "fx_llm")).select("ordinal", "json")


def normalize_findings(spark, sf_dir):
    return fnd.normalize_findings(view(spark, sf_dir, "fx_llm"))


def verdicts_in(spark, sf_dir):
    return fnd.verdicts_in(view(spark, sf_dir, "fx_llm")).select("ordinal", "verdict", "adjusted_severity")


def needs_deep(spark, sf_dir):
    return fnd.needs_deep(_findings(spark, sf_dir)).select("ordinal", "severity", "confidence")


def deep_route(spark, sf_dir):
    return fnd.deep_route(_findings(spark, sf_dir))


def apply_verdicts(spark, sf_dir):
    return fnd.apply_verdicts(_findings(spark, sf_dir), view(spark, sf_dir, "fx_verdicts"))


def apply_verdicts_all_dismissed(spark, sf_dir):
    verdicts = view(spark, sf_dir, "fx_findings").select(
        "ordinal", F.lit("false_positive").alias("verdict"), F.lit("LOW").alias("adjusted_severity"),
        F.lit(0.1).alias("adjusted_confidence"), F.lit("x").alias("attack_chain"), F.lit("y").alias("data_at_risk"),
        F.lit("z").alias("remediation"),
    )
    return fnd.apply_verdicts(_findings(spark, sf_dir), verdicts)


def aggregate_findings(spark, sf_dir):
    return fnd.aggregate_findings(_findings(spark, sf_dir))


def findings_summary(spark, sf_dir):
    return fnd.findings_summary(_findings(spark, sf_dir))


def findings_by_category(spark, sf_dir):
    return fnd.findings_by_category(_findings(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    gate_candidates, gate_blocked, file_prompts, package_prompts, deep_prompts, package_context, extract_json,
    normalize_findings, verdicts_in, needs_deep, deep_route, apply_verdicts, apply_verdicts_all_dismissed,
    aggregate_findings, findings_summary, findings_by_category,
)}

FULL = with_views("fx_findings_full", "fx_verdicts")
COLUMNS = """ordinal, package_name, package_version, ecosystem, file_path, category, severity, confidence, title,
 description, evidence, remediation, deep_investigated"""
DEEP = "severity in ('CRITICAL', 'HIGH') and confidence >= 0.3"
GATE = with_views("fx_lib_deps", "fx_vulns_libs") + """, known as (select distinct ecosystem, package_name as name,
 package_version as version from fx_vulns_libs where ordinal % 3 = 0)
select ordinal, ecosystem, name, version from fx_lib_deps d where {} exists (select 1 from known k
 where k.ecosystem = d.ecosystem and k.name = d.name and k.version = d.version)"""
META = " union all ".join(
    v.replace("from fx_libs", ", n, k, version from fx_libs")
    for v in __import__("checks.enrich_checks", fromlist=["META_SQL"]).META_SQL.values()
)
DAYS = "cast(floor(date_diff('second', try_cast({t} as timestamp), timestamp '2024-02-01 00:00:00') / 86400.0) as bigint)"
ORACLES = {
    "gate_candidates": GATE.format("not"),
    "gate_blocked": GATE.format(""),
    "file_prompts": triage_checks.FINAL + """,
wide as (select ordinal, string_agg(name || ' (' || n || ' matches)', ', ' order by n desc, idx) as shown2 from counts group by ordinal)
select ordinal, ecosystem, name, version, path, part, parts, 'Review one file of package "' || name || '" for supply chain threats.'
 || case when version = '1.1.0' and not exists (select 1 from f p where p.ecosystem = r.ecosystem and p.name = r.name
   and p.version = '1.0.0' and p.path = r.path) then chr(10) || 'NEW FILE: it was not part of the previous version (1.0.0). Added files are a common way in.' || chr(10) else '' end
 || chr(10) || chr(10) || 'File: ' || path || chr(10) || 'Triage score: ' || cast(final as bigint) || chr(10)
 || 'Categories: ' || replace(categories, '+', ', ') || chr(10) || 'Indicators: ' || shown2 || chr(10) || chr(10)
 || 'Content, part ' || part || ' of ' || parts || ':' || chr(10) || substr(content, (part - 1) * 12000 + 1, 12000) || chr(10) || chr(10)
 || 'Report every malicious behaviour found; report an empty list if the file is legitimate.' as prompt
from (select *, unnest(range(1, parts + 1)) as part from (select *, greatest(1, cast(ceil(length(content) / 12000.0) as int)) as parts from final where final >= 8) x) r
join wide using (ordinal)""",
    "package_prompts": with_views("fx_docs", "fx_libs") + f", meta as ({META})" + f""",
sig as (select *, new_maintainers <> '' as changed, {DAYS.format(t='created_at')} as age, {DAYS.format(t='updated_at')} as published from meta),
risky as (select *, case when changed then 3 else 0 end + case when age < 30 then 2 else 0 end + case when published < 3 then 1 else 0 end
 + case when not has_provenance and age > 365 then 1 else 0 end as risk from sig)
select ecosystem, name, l.version, 'Review this ' || ecosystem || ' package for supply chain threats.' || chr(10) || chr(10)
 || 'Package: ' || name || '@' || l.version || chr(10) || 'Description: ' || coalesce(description, '(none)') || chr(10)
 || 'License: ' || coalesce(license, '(none)') || chr(10) || 'Weekly downloads: ' || format('{{:,}}', weekly_downloads) || chr(10)
 || 'Created: ' || created_at || chr(10) || 'Updated: ' || updated_at || chr(10)
 || 'Maintainers: ' || case when maintainers = '' then '(unknown)' else replace(maintainers, '|', ', ') end || chr(10)
 || 'Repository: ' || coalesce(repository_url, '(none)') || chr(10)
 || 'Install scripts: ' || case when has_install_scripts then 'yes' else 'no' end || chr(10)
 || 'Total files: ' || (r.n + 1) || chr(10) || 'Risk score: ' || risk || '/10' || case when risk >= 5 then ' HIGH' else '' end || chr(10)
 || 'Maintainer change: ' || case when changed then 'YES, was ' || replace(previous_maintainers, '|', ', ') || ', new ' || replace(new_maintainers, '|', ', ') else 'no' end || chr(10)
 || 'Package age: ' || age || ' days' || chr(10) || 'Published days ago: ' || published || chr(10)
 || 'Typosquat candidate: none' || chr(10) || 'Dependency confusion risk: no' || chr(10)
 || 'Provenance: ' || case when has_provenance then 'yes' else 'no' end as prompt
from risky r join fx_libs l using (ecosystem, name)""",
    "deep_prompts": FULL + f"""select ordinal, ecosystem, package_name, package_version,
 'A first review flagged package "' || package_name || '@' || package_version || '" (' || ecosystem || ').' || chr(10) || chr(10)
 || 'Category: ' || category || chr(10) || 'Severity: ' || severity || chr(10) || 'Confidence: ' || confidence || chr(10)
 || 'Title: ' || title || chr(10) || 'Description: ' || description || chr(10) || 'Evidence: ' || coalesce(evidence, '') || chr(10) || chr(10)
 || 'Confirm, downgrade or dismiss it against the package''s code. Answer as JSON with verdict, adjustedSeverity, adjustedConfidence, attackChain, dataAtRisk, remediation and reasoning.' as prompt
from fx_findings_full where {DEEP}""",
    "package_context": with_views("fx_sized_files", "fx_hooks") + f""", ours as (select * from fx_files where ecosystem in ('npm', 'pypi')),
entries as (select *, row_number() over (partition by ecosystem, name, version order by ordinal) as rn from ours
  where (ecosystem = 'npm' and path = 'package/index.js') or path like '%/__init__.py'),
texts as (
 select ecosystem, name, version, 'install script' as section, hook as label, command as text from fx_hooks
 union all select ecosystem, name, version, 'suspicious file', path, content from ours
  where (ecosystem = 'npm' and path = 'package/scripts/postinstall.js') or (ecosystem = 'pypi' and path = 'package/setup.py')
 union all select ecosystem, name, version, 'entry point', path, content from entries where rn = 1
 union all select ecosystem, name, version, 'listing', path, '' from ours)
select ecosystem, name, version, section, label, part, parts, substr(text, (part - 1) * 12000 + 1, 12000) as text
from (select *, unnest(range(1, parts + 1)) as part from (select *, greatest(1, cast(ceil(length(text) / 12000.0) as int)) as parts from texts) x) y""",
    "extract_json": with_views("fx_llm") + """select ordinal, case when response like 'Here%' then regexp_extract(response, '\\[.*\\]')
 when response like 'verdict%' then regexp_extract(response, '\\{.*\\}') end as json from fx_llm""",
    "normalize_findings": with_views("fx_llm") + """, j as (select ordinal, cast(regexp_extract(response, '\\[.*\\]') as json) as j
  from fx_llm where response like 'Here%')
select ordinal, position, x->>'category' as category, upper(x->>'severity') as severity,
 greatest(0, least(1, cast(x->>'confidence' as double))) as confidence, x->>'title' as title, '' as description,
 '' as evidence, 'Review the package source code manually.' as remediation, false as deep_investigated
from (select ordinal, i as position, j->i as x from j, (select unnest(range(3)) as i) r) y""",
    "verdicts_in": with_views("fx_llm") + """select ordinal, 'CONFIRMED' as verdict, 'LOW' as adjusted_severity
from fx_llm where response like 'verdict%'""",
    "needs_deep": FULL + f"select ordinal, severity, confidence from fx_findings_full where {DEEP}",
    "deep_route": FULL + "select bool_or(severity in ('CRITICAL', 'HIGH')) as deep_investigation from fx_findings_full",
    "apply_verdicts": FULL + f""", j as (select f.*, v.verdict as v, v.adjusted_severity, v.adjusted_confidence, v.attack_chain, v.data_at_risk,
  v.remediation as fix, {DEEP} as deep, coalesce({DEEP} and v.verdict = 'FALSE_POSITIVE', false) as fp
 from fx_findings_full f left join fx_verdicts v using (ordinal)),
k as (select *, deep and v is not null as adj from j where not fp or (select count(*) from j where deep and not fp) = 0)
select ordinal, package_name, package_version, ecosystem, file_path, category,
 case when adj and adjusted_severity = 'low' then 'LOW' else severity end as severity,
 case when adj and adjusted_confidence is not null then least(1, adjusted_confidence) else confidence end as confidence, title,
 case when adj and attack_chain is not null then description || chr(10) || chr(10) || 'Attack chain: ' || attack_chain || chr(10)
  || 'Data at risk: ' || coalesce(data_at_risk, 'Unknown') else description end as description, evidence,
 case when adj then coalesce(fix, remediation) else remediation end as remediation, adj as deep_investigated from k""",
    "apply_verdicts_all_dismissed": FULL + f"select {COLUMNS} from fx_findings_full",
    "aggregate_findings": FULL + f"""select {COLUMNS} from (select *, row_number() over (partition by ecosystem, package_name,
 package_version, category, title order by ordinal) as rn from fx_findings_full) x where rn = 1""",
    "findings_summary": FULL + """select count(distinct (ecosystem, package_name, package_version)) as packages_with_findings,
 count(*) as total_findings, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high,
 count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low from fx_findings_full""",
    "findings_by_category": FULL + "select category, count(*) as n_findings from fx_findings_full group by 1",
}
