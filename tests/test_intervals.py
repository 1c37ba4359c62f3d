"""The interval index against all pairs."""

import random

import pytest

from pkgaudit.operators.intervals import points_in_intervals


def brute(points, spans):
    out = []
    for g, key, name in points:
        for h, start, to, last, ident in spans:
            if None not in (g, key, start) and g == h and start <= key and (to is None or key < to) and (
                    to is not None or last is None or key <= last):
                out.append((g, key, name, ident))
    return sorted(out, key=repr)


def found(spark, points, spans):
    p = spark.createDataFrame(points, "g string, at_key string, name string")
    s = spark.createDataFrame(spans, "g string, from_key string, to_key string, last_key string, ident string")
    rows = points_in_intervals(p, s, ["g"]).select("g", "at_key", "name", "ident").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, *(f"{i:02d}" for i in range(25))])
    group = lambda: rng.choice(["a", "b", "c", None])
    points = [(group(), key(), f"p{i}") for i in range(120)]
    spans = []
    for i in range(150):
        to, last = rng.choice([(key(), None), (None, key()), (None, None)])
        spans.append((group(), rng.choice(["", key(), key()]), to, last, f"s{i}"))
    # Repeated rows meet as often as they are there.
    points += points[:5]
    spans += spans[:5]
    assert found(spark, points, spans) == brute(points, spans)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 33])
def test_every_interval_of_a_group(spark, size):
    points = [("a", f"{i:03d}", f"p{i}") for i in range(size)]
    spans = [("a", f"{i:03d}", None, f"{j:03d}", f"{i}-{j}") for i in range(size) for j in range(i - 1, size)]
    assert found(spark, points, spans) == brute(points, spans)


def test_no_points_and_no_intervals(spark):
    assert found(spark, [], [("a", "0", None, None, "s")]) == []
    assert found(spark, [("a", "0", "p")], []) == []


def test_many_of_both_cost_their_hits(spark):
    """A package with 5,000 points and 5,000 intervals of one point: 25,000,000 pairs, 5,000 hits."""
    points = spark.range(5000).selectExpr("'hot' as g", "lpad(cast(id as string), 6, '0') as at_key", "id as name")
    spans = spark.range(5000).selectExpr(
        "'hot' as g", "lpad(cast(id as string), 6, '0') as from_key", "cast(null as string) as to_key",
        "lpad(cast(id as string), 6, '0') as last_key", "id as ident")
    hits = points_in_intervals(points, spans, ["g"])
    assert hits.filter("name <> ident").count() == 0 and hits.count() == 5000
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Blocks of an interval: two of a size at most.
    wide = spark.createDataFrame([("hot", "000001", None, "004998")], "g string, from_key string, to_key string, last_key string")
    assert points_in_intervals(points, wide, ["g"]).count() == 4998


@pytest.mark.parametrize("seed", range(2))
def test_merged_intervals_are_met_once(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, *(f"{i:02d}" for i in range(25))])
    group = lambda: rng.choice(["a", "b", None])
    points = [(group(), key(), f"p{i}") for i in range(60)]
    spans = []
    for i in range(120):
        to, last = rng.choice([(key(), None), (None, key()), (None, None)])
        spans.append((group(), rng.choice(["", key(), key()]), to, last, rng.choice([None, "s0", "s1", "s2", "s3", "s4"])))
    p = spark.createDataFrame(points, "g string, at_key string, name string")
    s = spark.createDataFrame(spans, "g string, from_key string, to_key string, last_key string, ident string")
    rows = points_in_intervals(p, s, ["g"], merge_by=["ident"]).select("g", "at_key", "name", "ident").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(set(brute(points, spans)), key=repr)
