"""Hits of advisories: once each without a distinct over them, and nothing parsed is broadcast."""

import json

from pkgaudit.operators import advisories as adv


def document(ident, name, events, versions=None):
    return (json.dumps({"id": ident, "summary": "s", "affected": [{
        "package": {"name": name, "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": events}], "versions": versions}]}),)


def test_every_hit_once(spark):
    deps = spark.createDataFrame(
        [("npm", "a", v) for v in ("1.0.0", "v1.0.0", "1.5.0", "2.0.0", "3.0.0", "*", "1.0.0")], "ecosystem string, name string, version string")
    docs = spark.createDataFrame([
        # Overlapping ranges, a listed version inside and one outside, and the same advisory in a second document.
        document("A", "a", [{"introduced": "0"}, {"fixed": "1.5.0"}, {"introduced": "1.0.0"}, {"last_affected": "1.5.0"}], ["1.0.0", "3.0.0", "3.0.0"]),
        document("A", "a", [{"introduced": "1.2.0"}, {"fixed": "2.0.0"}], ["3.0.0", "1.5.0"]),
        document(None, "a", [{"introduced": "2.0.0"}], ["2.0.0"]),
        document(None, "a", [{"introduced": "3.0.0"}]),
    ], "body string")
    hits = adv.match_advisories(deps, adv.parse_advisories(docs))
    rows = sorted(((r.version, r.id) for r in hits.collect()), key=repr)
    assert rows == sorted([
        ("1.0.0", "A"), ("v1.0.0", "A"), ("1.5.0", "A"), ("3.0.0", "A"), ("*", "A"),
        ("2.0.0", None), ("3.0.0", None), ("*", None)], key=repr)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [ecosystem" in line and "id#" in line.split("]")[0] for line in plan.splitlines())


def test_details_are_not_broadcast(spark):
    stubs = adv.parse_advisories(spark.createDataFrame([document(i, "a", []) for i in ("A", "B", None)], "body string"))
    details = adv.parse_advisories(spark.createDataFrame([document(i, "b", []) for i in ("A", "C", None)], "body string"))
    filled = adv.backfill_advisory_details(stubs, details)
    assert "Broadcast" not in filled._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.affected[0].package.name) for r in filled.collect()} == {("A", "b"), ("B", "a"), (None, "a")}
    hits = spark.createDataFrame([("npm", "a", "1", "A")], "ecosystem string, name string, version string, id string")
    rows = adv.to_vulnerability(hits, stubs)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1


def test_affected_packages_of_a_small_file_are_not_broadcast(spark, tmp_path):
    docs = [document(f"A{i}", "a", [{"introduced": "0"}, {"fixed": f"{i}.0.0"}], ["9.9.9"] if i == 3 else None) for i in range(4)]
    # A file that Spark takes for far less than what is parsed from it.
    spark.createDataFrame(docs, "body string").write.parquet(f"{tmp_path}/docs")
    deps = spark.createDataFrame([("npm", "a", v) for v in ("1.0.0", "9.9.9", "*")], "ecosystem string, name string, version string")
    hits = adv.match_advisories(deps, adv.parse_advisories(spark.read.parquet(f"{tmp_path}/docs")))
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.version, r.id) for r in hits.collect()) == [
        ("*", "A0"), ("*", "A1"), ("*", "A2"), ("*", "A3"), ("1.0.0", "A2"), ("1.0.0", "A3"), ("9.9.9", "A3")]
