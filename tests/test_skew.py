"""One key with a third and more of all rows."""

import pytest
from pyspark.sql import functions as F

from pkgaudit.operators import advisories, enrich, findings, graph, reports
from pkgaudit.operators.keys import first_per_key

N = 60_000


@pytest.fixture
def hot_deps(spark):
    """Half of the rows are one package version."""
    hot = F.col("id") % 2 == 0
    return spark.range(0, N, 1, 8).select(
        F.col("id").alias("ordinal"), F.lit("npm").alias("ecosystem"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id"))).alias("name"),
        F.lit("1.0.0").alias("version"), F.lit("x" * 50).alias("payload"),
    )


@pytest.fixture
def shuffled_joins(spark):
    """Settings under which small tests join by shuffle and count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_lookup_joins_split_a_hot_key(spark, hot_deps, shuffled_joins):
    provenance = spark.range(0, 2000).select(
        F.lit("npm").alias("ecosystem"),
        F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") * 2 + 1)).alias("package_name"),
        F.lit("1.0.0").alias("version"), F.lit(True).alias("has_provenance"),
    )
    rows, plan = final_plan(enrich.apply_provenance(hot_deps, provenance))
    assert len(rows) == N and sum(bool(r.provenance) for r in rows) == N // 2 + 1999
    assert "skew=true" in plan


def test_candidate_gate_splits_a_hot_key(spark, hot_deps, shuffled_joins):
    vulns = spark.createDataFrame([("npm", "hot", "1.0.0", "HIGH")], "ecosystem string, package_name string, package_version string, severity string")
    eligible, blocked = findings.gate_candidates(hot_deps, vulns)
    rows, plan = final_plan(eligible)
    assert len(rows) == N // 2 and "skew=true" in plan
    assert blocked.count() == N // 2


def test_a_hot_key_is_reduced_before_the_shuffle(spark, hot_deps):
    first = first_per_key(hot_deps, ["ecosystem", "name"], F.col("ordinal"))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange") and "Window" not in plan
    assert first.filter("name = 'hot'").first().ordinal == 0 and first.count() == N // 2 + 1


def test_a_hot_package_is_counted_whole(spark, hot_deps):
    vulns = hot_deps.select(
        "ordinal", F.concat(F.lit("V"), F.col("ordinal")).alias("id"), "ecosystem", F.col("name").alias("package_name"),
        F.col("version").alias("package_version"), F.lit("LOW").alias("severity"), F.lit("t").alias("title"),
    )
    grouped = reports.aggregate_by_package(vulns, vulns.limit(0))
    assert max(r.static_count for r in grouped.collect()) == N // 2
    assert advisories.dedup_vulnerabilities(vulns).count() == N
    assert reports.vulnerable_split(hot_deps, grouped).first().vulnerable == N


def test_a_hot_requirement_is_expanded_for_every_manifest(spark, shuffled_joins):
    roots = spark.range(0, 5000).select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("id")).alias("file"), F.lit("npm").alias("ecosystem"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id"))).alias("name"),
        F.lit("*").alias("version_spec"), F.lit(False).alias("is_dev"),
    )
    edges = spark.createDataFrame(
        [("npm", "hot", "*", f"c{i}", "*") for i in range(5)] + [("npm", "c0", "*", "hot", "*")],
        "ecosystem string, name string, version_spec string, child_name string, child_spec string")
    counts = {r.depth: r.n for r in graph.expand_tree(roots, edges).groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 5000, 1: 2500 * 5}
