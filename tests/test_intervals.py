import random

from tracewell.operators import intervals


def test_points_meet_the_spans_that_hold_them(spark):
    """Short, long, open, empty and reversed spans, negative places, ties and repeated rows, against every pair."""
    r = random.Random(3)
    spans = [(r.choice("ab"), k, b, b + r.choice([0, 0, 1, 3, 40, 1000, 10**12, -2])) for k in range(200) for b in [r.choice([r.randrange(-50, 50), r.randrange(-2000, 2000), -(10**12)])]]
    spans += [("a", 900, None, 5), ("a", 901, 5, None), ("b", 902, None, None), (None, 903, 0, 9), ("a", 904, -(2**63), 2**63 - 1)]
    points = [(r.choice("abc"), n, r.choice([r.randrange(-60, 60), r.randrange(-3000, 3000), 10**11])) for n in range(150)] + [("a", 500, None), (None, 501, 1), ("a", 502, 5), ("a", 502, 5)]
    p, s = spark.createDataFrame(points, "g string, n long, at long"), spark.createDataFrame(spans, "g string, k long, f long, u long")
    got = sorted((x.n, x.k) for x in intervals.within(p, s, ["g"], "at", "f", "u").collect())
    want = sorted((n, k) for g, n, at in points for h, k, f, u in spans if g is not None and g == h and at is not None and (f is None or f <= at) and (u is None or at <= u))
    assert got == want and len(want) > 1000
    assert intervals.within(p, s.where("k < 0"), ["g"], "at", "f", "u").isEmpty()
    plan = intervals.within(p, s, ["g"], "at", "f", "u")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_prohibitions_win_and_evaluations_without_rules_stay(spark):
    asked = spark.createDataFrame([("e1", "i", "publish", "x", 5), ("e2", "i", "publish", "y", 5), ("e3", "i", "read", "x", 5), ("e4", "i", "publish", "x", 50), ("e5", "i", "publish", None, 5)], "id string, issuer string, action string, target string, at long")
    rules = spark.createDataFrame([("i", "permission", "publish", None, 0, 10), ("i", "prohibition", "publish", "y", 5, 5), ("i", "permission", "publish", "x", None, 4)], "issuer string, effect string, action string, target string, valid_from long, valid_until long")
    got = {r.id: (r.permissions, r.prohibitions, r.verdict) for r in intervals.authorizations(asked, rules, ["issuer"], ["id"]).collect()}
    assert got == {"e1": (1, 0, "permitted"), "e2": (1, 1, "prohibited"), "e3": (0, 0, "unauthorised"), "e4": (0, 0, "unauthorised"), "e5": (1, 0, "permitted")}


def test_authorizations_make_no_pairs(spark):
    """Open ends, rules without a target, nulls and empty spans against plain loops; the plan has no join by bins, whose rows are pairs."""
    r = random.Random(11)
    rules = [(r.randrange(2), r.choice(["permission", "prohibition", None]), r.randrange(2), r.choice([None, 0, 1]), r.choice([None, r.randrange(-200_000, 200_000)]), r.choice([None, r.randrange(-200_000, 200_000)])) for _ in range(300)]
    asked = [(k, r.choice([0, 1, None]), r.randrange(2), r.choice([None, 0, 1, 2]), r.choice([None, r.randrange(-200_000, 200_000)])) for k in range(200)]
    holds = lambda x, e: x[0] == e[1] and x[2] == e[2] and x[3] in (None, e[3]) and e[4] is not None and (x[4] is None or x[4] <= e[4]) and (x[5] is None or e[4] <= x[5])
    want = sorted((e[0], *(sum(holds(x, e) and x[1] == effect for x in rules) for effect in ("permission", "prohibition"))) for e in asked)
    made = intervals.authorizations(
        spark.createDataFrame(asked, "k int, issuer int, action int, target int, at int"),
        spark.createDataFrame(rules, "issuer int, effect string, action int, target int, valid_from int, valid_until int"), ["issuer"], ["k"],
    )
    assert sorted(tuple(x)[:3] for x in made.collect()) == want
    assert "_level" not in made._jdf.queryExecution().optimizedPlan().toString()
