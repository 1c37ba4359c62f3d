"""Answers worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from pkgaudit.functions import json_text, labels, severity, signals, versions
from pkgaudit.operators import advisories, enrich, explore, findings, graph, registry, reports


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


CVSS = {
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
    "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:N/A:H": 5.9,
    "CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N": 5.5,
    "CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N": 1.6,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0,
    "7.5": 7.5,
    "9.0": 9.0,
    "0": 0.0,
    "CVSS:4.0/AV:N/AC:L": None,
    "CVSS:2.0/AV:N": None,
}


def test_cvss(spark):
    assert values(spark, severity.cvss3_score, CVSS) == list(CVSS.values())


def test_typosquats(spark):
    npm = lambda c: signals.typosquat_candidate(F.lit("npm"), c)
    names = ["crossenv", "momnet", "nodemailer", "loddddash", "lodash", "@x/expres"]
    assert values(spark, npm, names) == ["cross-env", "moment", None, None, None, "express"]
    pypi = lambda c: signals.typosquat_candidate(F.lit("pypi"), c)
    assert values(spark, pypi, ["requesst", "colorama"]) == ["requests", None]


def test_dependency_confusion(spark):
    names = ["@apple/internal-analytics", "@microsoft/corp-utils", "private-payment-gateway", "internal-auth-service",
             "@babel/core", "@types/node", "express"]
    assert values(spark, versions.is_dependency_confusion, names) == [True] * 4 + [False] * 3


@pytest.mark.parametrize("change, age, published, typo, expected", [
    (False, 500, 30, None, 0), (True, 20, 1, None, 6), (True, 5, 0, "lodash", 9),
])
def test_risk_score(spark, change, age, published, typo, expected):
    score = signals.registry_risk_score(
        F.lit(change), F.lit(age), F.lit(published), F.lit(typo).cast("string"), F.lit(False), F.lit(True))
    assert spark.range(1).select(score).first()[0] == expected


def test_version_order(spark):
    ordered = ["0", "1.0.0-alpha.2", "1.0.0-alpha.10", "1.0.0-rc.1", "1.0", "1.0.1", "1.2.0", "1.10.0", "v2.0.0"]
    rows = spark.createDataFrame([(v,) for v in random.Random(1).sample(ordered, len(ordered))], "v string")
    assert [r[0] for r in rows.orderBy(versions.version_key(F.col("v"))).collect()] == ordered
    equal = spark.createDataFrame([("1.0", "1.0.0"), ("v1.2", "1.2.0"), ("2.0.0+build", "2.0")], "a string, b string")
    same = equal.select((versions.version_key(F.col("a")) == versions.version_key(F.col("b"))).alias("s"))
    assert all(r[0] for r in same.collect())
    long = spark.createDataFrame([("1" + ".2" * 100_000,), ("1" + ".0" * 100_000,), ("9" * 60,)], "v string")
    keys = [r[0] for r in long.select(versions.version_key(F.col("v"))).collect()]
    assert keys[1] == "110" "111" "!1" and keys[2] > keys[0] > keys[1]
    epochs = ["2.0", "1!0.5", "1!1.0", "10!0.1"]
    sizes = ["1." + "9" * 20, "1.1" + "0" * 20, "1." + "9" * 99, "1.1" + "0" * 99, "1.2" + "0" * 99]
    for right in (epochs, sizes):
        rows = spark.createDataFrame([(v,) for v in reversed(right)], "v string")
        assert [r[0] for r in rows.orderBy(versions.version_key(F.col("v"))).collect()] == right
        assert rows.select(versions.natural_key(F.col("v"))).distinct().count() == len(right)


CASES = [
    ("npm", "npm", "lodash", "4.17.18", "GHSA-p6mc-m468-83gw", "0", "4.17.19"),
    ("npm", "npm", "minimist", "0.0.8", "GHSA-vh95-rmgr-6w4m", "0", "0.2.1"),
    ("npm", "npm", "axios", "0.21.0", "GHSA-4w2v-q235-vp99", "0", "0.21.1"),
    ("npm", "npm", "node-fetch", "2.6.6", "GHSA-r683-j2x4-v87g", "0", "2.6.7"),
    ("pypi", "PyPI", "urllib3", "1.25.8", "PYSEC-2021-108", "1.25.4", "1.26.5"),
    ("pypi", "PyPI", "django", "2.2.23", "PYSEC-2021-98", "2.2", "2.2.24"),
    ("go", "Go", "github.com/dgrijalva/jwt-go", "3.2.0", "GO-2020-0017", "0", "4.0.0-preview1"),
    ("go", "Go", "github.com/gin-gonic/gin", "1.5.0", "GO-2020-0001", "0", "1.6.0"),
    ("go", "Go", "github.com/cloudflare/circl", "1.6.2", "GO-2026-4550", "0", "1.6.3"),
    ("cargo", "crates.io", "time_calibrator", "0.1.0", "RUSTSEC-2026-0030", "0", None),
    ("cargo", "crates.io", "rpc-check", "0.1.0", "RUSTSEC-2026-0014", "0", None),
    ("cargo", "crates.io", "serd", "0.1.0", "RUSTSEC-2023-0102", "0", None),
    ("ruby", "RubyGems", "rack", "2.2.3", "GHSA-hxqx-xwvh-44m2", "2.0", "2.2.3.1"),
    ("ruby", "RubyGems", "nokogiri", "1.13.9", "GHSA-353f-x4gh-cqq8", "0", "1.13.10"),
]


def test_known_advisories(spark):
    deps = spark.createDataFrame([(c[0], c[2], c[3]) for c in CASES], "ecosystem string, name string, version string")
    fixed = deps.union(spark.createDataFrame(
        [(c[0], c[2], c[6]) for c in CASES if c[6]], "ecosystem string, name string, version string"))
    bodies = [
        (f'{{"id":"{i}","affected":[{{"package":{{"name":"{n}","ecosystem":"{e}"}},"ranges":[{{"type":"SEMVER","events":'
         f'[{{"introduced":"{a}"}}' + (f',{{"fixed":"{b}"}}' if b else "") + "]}]}]}",)
        for _, e, n, _, i, a, b in CASES
    ]
    parsed = advisories.parse_advisories(spark.createDataFrame(bodies, "body string"))
    hits = advisories.match_advisories(fixed, parsed).collect()
    assert sorted((h.name, h.version, h.id) for h in hits) == sorted((c[2], c[3], c[4]) for c in CASES)


def test_repeated_affected_entries_give_one_hit(spark):
    entry = '{"package":{"name":"My_Pkg","ecosystem":"PyPI"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"2.0"}]}],"versions":["1.0","3.0"]}'
    commits = '{"package":{"name":"my-pkg","ecosystem":"PyPI"},"ranges":[{"type":"GIT","events":[{"introduced":"0"}]}]}'
    body = f'{{"id":"A","affected":[{entry},{entry},{commits}]}}'
    parsed = advisories.parse_advisories(spark.createDataFrame([(body,)], "body string"))
    deps = spark.createDataFrame(
        [("pypi", "my.pkg", v) for v in ("1.0", "1.5", "2.0", "2.5", "3.0", "*")],
        "ecosystem string, name string, version string")
    assert sorted(h.version for h in advisories.match_advisories(deps, parsed).collect()) == ["*", "1.0", "1.5", "3.0"]


def test_dedup_does_not_depend_on_row_order(spark):
    rows = [(i, "V", "npm", "p", "1", s) for i, s in enumerate(["LOW", "HIGH", "CRITICAL", "HIGH", "CRITICAL", "LOW"])]
    rows += [(10, "W", "npm", "p", "1", "LOW"), (11, "W", "npm", "p", "1", "MEDIUM"), (12, "X", "npm", "p", "1", "HIGH"),
             (13, "X", "npm", "p", "1", "HIGH")]
    schema = "ordinal long, id string, ecosystem string, package_name string, package_version string, severity string"
    for seed in range(3):
        shuffled = random.Random(seed).sample(rows, len(rows))
        kept = advisories.dedup_vulnerabilities(spark.createDataFrame(shuffled, schema).repartition(3)).collect()
        assert sorted(r.ordinal for r in kept) == [4, 10, 13]


def test_verdicts_restore_when_all_are_dismissed(spark):
    schema = ("ordinal long, package_name string, package_version string, ecosystem string, category string, "
              "severity string, confidence double, title string, description string, remediation string, "
              "deep_investigated boolean")
    found = spark.createDataFrame([
        (1, "a", "1", "npm", "c", "HIGH", 0.9, "t", "d", "r", False),
        (2, "b", "1", "npm", "c", "LOW", 0.9, "t", "d", "r", False),
    ], schema)
    verdict = "ordinal long, verdict string, adjusted_severity string, adjusted_confidence double, attack_chain string, data_at_risk string, remediation string"
    dismissed = spark.createDataFrame([(1, "FALSE_POSITIVE", None, None, None, None, None)], verdict)
    assert sorted(r.ordinal for r in findings.apply_verdicts(found, dismissed).collect()) == [1, 2]
    more = found.union(spark.createDataFrame([(3, "c", "1", "npm", "c", "CRITICAL", 0.5, "t", "d", "r", False)], schema))
    assert sorted(r.ordinal for r in findings.apply_verdicts(more, dismissed).collect()) == [2, 3]


def test_uninformative_rows(spark):
    schema = ("id string, severity string, description string, references array<string>, cvss double, "
              "fixed_versions string, affected_versions string")
    rows = spark.createDataFrame([
        ("keep-low", "LOW", None, [], None, None, "Unknown"), ("drop", "UNKNOWN", " ", [], None, None, "Unknown"),
        ("drop2", "UNKNOWN", "No description available", None, None, "", None),
        ("keep-ref", "UNKNOWN", None, ["u"], None, None, None), ("keep-cvss", "UNKNOWN", None, [], 0.0, None, None),
    ], schema)
    assert sorted(r.id for r in reports.filter_uninformative(rows).collect()) == ["keep-cvss", "keep-low", "keep-ref"]


def test_labels(spark):
    days = [None, -1, 0, 29, 30, 364, 365, 3649, 3650]
    assert values(spark, labels.age_label, days, "int") == [
        "Unknown", "Unknown", "today", "29d", "1mo", "12mo", "1.0y", "10.0y", "10y"]
    urls = ["https://github.com/advisories/GHSA-aaaa-bbbb-cccc", "https://www.cve.org/CVERecord/CVE-2020-1",
            "https://nvd.nist.gov/vuln/detail/CVE-2021-2", "https://www.Example.com/a", "https://github.com/o/r", "nonsense"]
    assert values(spark, labels.reference_label, urls) == [
        "GitHub · GHSA-aaaa-bbbb-cccc", "CVE · CVE-2020-1", "NVD · CVE-2021-2", "Link · example.com", "GitHub · github.com", "Link"]
    assert values(spark, labels.repo_name, ["git@github.com:o/r.git", "https://github.com/o/r", "https://x/y/z.git", None]) == [
        "o/r", "o/r", "z", None]


def test_json_in_text(spark):
    texts = ["a [1, 2] b", 'x {"a": [1} y', 'note [bad {"a": 1} end', "none", '[{"a": 1}] and ]']
    assert values(spark, json_text.extract_json, texts) == ["[1, 2]", None, '{"a": 1}', None, '{"a": 1}']


def test_provenance_states(spark):
    docs = spark.createDataFrame([
        ("npm", "version", "a", "1.0.0", "u1", 200, '{"dist":{"attestations":{"url":"x","provenance":{"predicateType":"p"}}}}'),
        ("npm", "version", "b", "1.0.0", "u2", 200, '{"dist":{"attestations":{"url":"x"}}}'),
        ("npm", "latest", "c", None, "u3", 503, None),
        ("pypi", "version", "my-lib", "1.0", "u4", 200, '{"urls":[{},{"attestations":{"provenance":{"url":"z"}}}]}'),
    ], "ecosystem string, kind string, name string, version string, url string, status int, body string")
    deps = spark.createDataFrame([
        ("npm", "a", "1.0.0"), ("npm", "b", "1.0.0"), ("npm", "c", "^1"), ("npm", "d", "1"), ("pypi", "My.Lib", "1.0"),
        ("go", "e", "1"),
    ], "ecosystem string, name string, version string")
    got = {r.package_name: (r.has_provenance, r.provenance_url, r.error)
           for r in enrich.verify_provenance(deps, docs).collect()}
    assert got == {
        "a": (True, "x", None), "b": (False, "x", None), "c": (False, None, "HTTP 503"), "d": (False, None, "HTTP 404"),
        "My.Lib": (True, "z", None),
    }


def test_previous_version_needs_a_listed_latest(spark):
    rows = [("npm", "a", v, "1.10.0") for v in ("1.2.0", "1.9.0", "1.10.0", "2.0.0")]
    rows += [("npm", "b", "1.0.0", "9.0.0"), ("npm", "c", "1.0.0", "1.0.0")]
    df = spark.createDataFrame(rows, "ecosystem string, name string, version string, latest string")
    assert {r.name: r.previous for r in registry.previous_version(df).collect()} == {"a": "1.9.0", "b": None, "c": None}


def test_grep_finds_every_line_with_its_context(spark):
    text = "\n".join(f"line {i} eval" if i % 2 else f"line {i}" for i in range(1, 20))
    files = spark.createDataFrame([("npm", "p", "1", "a.js", 1, text)],
                                  "ecosystem string, name string, version string, path string, ordinal long, content string")
    rows = explore.grep_files(files, "EVAL", context=1).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(1, 20, 2))
    assert rows[0].snippet == "> 1: line 1 eval\n  2: line 2"
    assert rows[1].snippet == "  2: line 2\n> 3: line 3 eval\n  4: line 4"


def test_every_finding_has_its_own_verdict(spark):
    """Two findings of one response, one confirmed and one dismissed; a second verdict on one changes no count."""
    found = findings.normalize_findings(spark.createDataFrame(
        [(1, 'x [{"severity":"high","confidence":0.9,"title":"a"},{"severity":"high","confidence":0.9,"title":"b"}] y')],
        "ordinal long, response string"))
    verdicts = spark.createDataFrame(
        [(1, 0, "CONFIRMED", None, None, None, None, "fix"), (1, 1, "FALSE_POSITIVE", None, None, None, None, None),
         (1, 0, "CONFIRMED", None, None, None, None, "fix")],
        "ordinal long, position int, verdict string, adjusted_severity string, adjusted_confidence double, "
        "attack_chain string, data_at_risk string, remediation string")
    rows = findings.apply_verdicts(found, verdicts).collect()
    assert [(r.title, r.deep_investigated, r.remediation) for r in rows] == [("a", True, "fix")]


def test_ranges_end_where_they_say(spark):
    def body(events):
        return ('{"id":"X","affected":[{"package":{"name":"a","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":['
                + events + ']}]}]}')

    deps = spark.createDataFrame([("npm", "a", v) for v in ("0.5.0", "1.2.0", "1.3.0", "9.0.0")], "ecosystem string, name string, version string")
    for events, hit in (
        ('{"introduced":"0"},{"last_affected":"1.2.0"}', ["0.5.0", "1.2.0"]),
        ('{"introduced":"0"},{"limit":"1.2.0"}', ["0.5.0"]),
        ('{"fixed":"1.3.0"},{"introduced":"1.0.0"}', ["1.2.0"]),
        ('{"introduced":"2.0.0"},{"introduced":"0"},{"fixed":"1.0.0"}', ["0.5.0", "9.0.0"]),
    ):
        docs = advisories.parse_advisories(spark.createDataFrame([("X", body(events))], "id string, body string"))
        got = advisories.match_advisories(deps, docs).collect()
        assert sorted(r.version for r in got) == hit, events


def test_no_source_gives_no_row(spark):
    assert advisories.union_sources(None, None).count() == 0


def test_trees_are_followed_to_their_ends(spark):
    roots = spark.createDataFrame([("r", "f", "npm", "n0", "*", True), ("r", "g", "npm", "n3", "*", False)],
                                  "repo string, file string, ecosystem string, name string, version_spec string, is_dev boolean")
    edges = [("npm", f"n{i}", "*", f"n{i + 1}", "*") for i in range(14)] + [("npm", "n14", "*", "n2", "*")]
    chain = spark.createDataFrame(edges, "ecosystem string, name string, version_spec string, child_name string, child_spec string")
    rows = {(r.file, r.name): (r.depth, r.is_dev) for r in graph.expand_tree(roots, chain).collect()}
    assert rows["f", "n14"] == (14, False) and rows["f", "n0"] == (0, True) and rows["g", "n2"] == (12, False)
    assert len(rows) == 15 + 13


def test_one_answer_for_names_that_are_written_differently(spark):
    docs = spark.createDataFrame(
        [("pypi", "version", n, "1.0", "u", 200, '{"urls":[{}]}') for n in ("Foo.Bar", "foo-bar")],
        "ecosystem string, kind string, name string, version string, url string, status int, body string")
    deps = spark.createDataFrame([("pypi", "foo_bar", "1.0")], "ecosystem string, name string, version string")
    assert enrich.apply_provenance(deps, enrich.verify_provenance(deps, docs)).count() == 1
