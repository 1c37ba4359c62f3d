"""Names near a given list of known names against all pairs."""

import random

from pkgaudit.operators import registry


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(names, known):
    out = set()
    for eco, name in set(names):
        local = (name.split("/")[1] if name.startswith("@") and "/" in name else name).lower()
        own = [(k, p) for e, k, p in known if e == eco]
        if any(k == local for k, _ in own):
            continue
        near = [(distance(local, k), p, k) for k, p in own if 1 <= distance(local, k) <= 2]
        if near:
            out.add((eco, name, min(near)[2]))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé-") for _ in range(rng.randrange(0, 7)))
    known = [(rng.choice(("npm", "cargo")), word(), i) for i in range(40)] + [("npm", "lodash", 50), ("npm", "lodash", 3)]
    names = [(rng.choice(("npm", "cargo", "go")), rng.choice((word(), "@s/" + word(), word().upper()))) for _ in range(150)]
    names += [("npm", "Lodahs"), ("npm", "@x/lodas"), ("npm", "lodash"), ("npm", "@alone"), ("npm", "loooodash")]
    pkgs = spark.createDataFrame(names, "ecosystem string, name string")
    listed = spark.createDataFrame(known, "ecosystem string, known string, place int")
    got = {tuple(r) for r in registry.typosquat_candidates(pkgs, listed).collect()}
    assert got == brute(names, known)


def test_work_follows_the_neighbours(spark):
    """20,000 names and 20,000 known ones: no product of the two."""
    names = spark.range(20_000).selectExpr("'npm' as ecosystem", "substr(md5(cast(id as string)), 1, 12) as name")
    known = spark.range(20_000).selectExpr("'npm' as ecosystem", "substr(md5(cast(id + 7 as string)), 1, 11) || 'x' as known", "cast(id as int) as place")
    found = registry.typosquat_candidates(names, known)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() >= 19_000


def test_one_edit_first(spark, monkeypatch):
    """Names with a neighbour within one edit are not looked for within two, and the least is found without sorting."""
    edits = []
    real = registry.signals.with_deletions
    monkeypatch.setattr(registry.signals, "with_deletions", lambda text, n=2: edits.append(n) or real(text, n))
    known = spark.createDataFrame(
        [("npm", "lodash", 2), ("npm", "lodasx", 1), ("npm", "abcdef", None), ("npm", "abcdeg", 9)],
        "ecosystem string, known string, place int")
    names = spark.createDataFrame([("npm", "lodas"), ("npm", "lodaxy"), ("npm", "@s/abcxyf"), ("npm", "abcd")], "ecosystem string, name string")
    found = registry.typosquat_candidates(names, known)
    assert edits == [1, 1, 2, 2]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[1:] for r in found.collect()} == {
        ("lodas", "lodasx"), ("lodaxy", "lodasx"), ("@s/abcxyf", "abcdef"), ("abcd", "abcdef")}
    assert spark.range(1).select(real(registry.F.lit("abcdefgh"), 1)).first()[0].__len__() == 9
