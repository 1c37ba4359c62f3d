"""Table layouts, as DDL. External JSON is read with the fixed layouts at the end."""

MANIFESTS = "repo string, path string, relative_path string, type string, content string"

DEPENDENCIES = (
    "repo string, file string, ecosystem string, name string, version string, version_spec string, "
    "is_dev boolean, is_pinned boolean, pos int"
)

REGISTRY_DOCS = (
    "ecosystem string, kind string, name string, version string, url string, status int, "
    "body string, fetched_at timestamp"
)

PACKAGE_FILES = (
    "ordinal bigint, ecosystem string, name string, version string, path string, size bigint, content string"
)

VULNERABILITIES = (
    "id string, package_name string, package_version string, ecosystem string, severity string, "
    "title string, description string, cvss double, references array<string>, affected_versions string, "
    "fixed_versions string, published_date string, source string"
)

FINDINGS = (
    "ordinal bigint, package_name string, package_version string, ecosystem string, file_path string, "
    "category string, severity string, confidence double, title string, description string, "
    "evidence string, remediation string, deep_investigated boolean"
)

# Kinds of registry documents: one row per answered URL.
DOC_KINDS = ("package", "version", "latest", "versions", "dependencies", "mod", "list", "downloads")
TEXT_DOC_KINDS = ("mod", "list")

SEVERITY_ENTRIES = "array<struct<type:string,score:string>>"

ADVISORY_BODY = f"""
    id string, summary string, details string, published string,
    severity {SEVERITY_ENTRIES},
    affected array<struct<
        package:struct<name:string,ecosystem:string>,
        severity:{SEVERITY_ENTRIES},
        ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>,
        versions:array<string>>>,
    references array<struct<type:string,url:string>>,
    database_specific struct<severity:string>
"""

NPM_PERSON = "struct<name:string,email:string>"

NPM_VERSION_FIELDS = f"""
    version:string, main:string, scripts:map<string,string>, dependencies:map<string,string>,
    maintainers:array<{NPM_PERSON}>, dist:struct<tarball:string,attestations:string>
"""

NPM_PACKAGE_BODY = f"""
    `dist-tags` map<string,string>, versions map<string,struct<{NPM_VERSION_FIELDS}>>,
    time map<string,string>, maintainers array<{NPM_PERSON}>, repository struct<url:string>,
    description string, license string
"""

PYPI_FILE = """struct<filename:string,upload_time:string,upload_time_iso_8601:string,
    provenance_url:string,metadata_version:string,attestations:string>"""

PYPI_BODY = f"""
    info struct<version:string,author:string,maintainer:string,summary:string,license:string,
        home_page:string,project_urls:struct<Source:string,Repository:string>,requires_dist:array<string>>,
    releases map<string,array<{PYPI_FILE}>>, urls array<{PYPI_FILE}>
"""

CRATE_BODY = """
    crate struct<newest_version:string,max_version:string,max_stable_version:string,created_at:string,
        updated_at:string,downloads:bigint,description:string,license:string,repository:string,homepage:string>,
    versions array<struct<num:string,created_at:string,updated_at:string>>,
    keywords array<struct<id:string,keyword:string>>,
    version struct<num:string,created_at:string>
"""

CRATE_DEPENDENCIES_BODY = (
    "dependencies array<struct<crate_name:string,crate_id:string,req:string,optional:boolean,kind:string>>"
)

GO_INFO_BODY = "Version string, Time string"

GEM_BODY = """
    version string, number string, authors string, info string, licenses array<string>,
    downloads bigint, version_downloads bigint, version_created_at string, created_at string,
    updated_at string, built_at string, homepage_uri string, source_code_uri string, project_uri string,
    dependencies struct<runtime:array<struct<name:string,requirements:string>>>
"""

GEM_VERSIONS_BODY = "array<struct<number:string,created_at:string,built_at:string>>"

REVIEW_FINDINGS = """array<struct<category:string,severity:string,confidence:double,title:string,
    description:string,evidence:string,remediation:string>>"""

REVIEW_VERDICT = """verdict string, adjustedSeverity string, adjustedConfidence double, attackChain string,
    dataAtRisk string, remediation string"""
