"""The queries over the driver tables against their SQL in DuckDB, and the operators on small graphs."""

import os
import random

import pytest

from tracewell.operators import checks, lineage
from tracewell.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(d[sorted(d.columns)].astype(str).agg("|".join, axis=1)) if len(d) else []
    assert rows(got) == rows(want)


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "parent string, child string")


def test_trace_takes_the_least_depth_and_reports_what_it_cut(spark):
    e = edges(spark, "ab", "bc", "cd", "ad", "de", "ca")
    nodes, cut = lineage.trace(e, "a", max_depth=1)
    assert {tuple(r) for r in nodes.collect()} == {("b", 1), ("d", 1)} and cut
    nodes, cut = lineage.trace(e, "a")
    assert {tuple(r) for r in nodes.collect()} == {("b", 1), ("d", 1), ("c", 2), ("e", 2)} and not cut
    nodes, cut = lineage.trace(e, "e", "ancestors", 64)
    assert {r.id for r in nodes.collect()} == {"a", "b", "c", "d"}
    for bad in (0, 65, True, 1.5):
        with pytest.raises(lineage.LineageError):
            lineage.trace(e, "a", max_depth=bad)


def test_lineage_stays_inside_its_record(spark):
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("2", "c", "b"), ("1", "z", "a")], "record_key string, parent string, child string")
    entities = spark.createDataFrame([(r, x, "works", None, f"/works/{k}", k) for r, xs in (("1", "abz"), ("2", "bc")) for k, x in enumerate(xs)], "record_key string, id string, collection string, type string, path string, place int")
    roots = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "a")], "record_key string, id string")
    nodes, inside, missing = lineage.report(entities, e, roots)
    assert [(r.record_key, r.root, r.direction, r.id, r.depth, r.path, r.truncated) for r in nodes.collect()] == [
        ("1", "a", "ancestors", "z", 1, "/works/2", False), ("1", "a", "descendants", "b", 1, "/works/1", False),
        ("2", "b", "ancestors", "c", 1, "/works/1", False), ("2", "b", "descendants", "c", 1, "/works/1", False),
    ]
    assert {(r.record_key, r.parent, r.child) for r in inside.collect()} == {("1", "a", "b"), ("1", "z", "a"), ("2", "b", "c"), ("2", "c", "b")}
    assert [tuple(r) for r in missing.collect()] == [("2", "a", "LINEAGE_ENTITY_MISSING")]
    chain = spark.createDataFrame([("1", str(k), str(k + 1)) for k in range(5)], e.schema)
    nodes, cut = lineage.trace_records(chain, spark.createDataFrame([("1", "0"), ("1", "3")], roots.schema), max_depth=2)
    assert {(r.root, r.id) for r in nodes.collect()} == {("0", "1"), ("0", "2"), ("3", "4"), ("3", "5")} and [r.root for r in cut.collect()] == ["0"]


def test_cyclic_core(spark):
    assert lineage.cyclic_core(edges(spark, "ab", "bc", "ac")).isEmpty()
    assert {tuple(r) for r in lineage.cyclic_core(edges(spark, "ab", "bc", "cb", "cd")).collect()} == {("b", "c"), ("c", "b")}


def test_cyclic_core_equals_reachability(spark):
    """Random graphs with acyclic tails: an edge stays if its parent is reachable from a cycle and its child reaches one."""
    r = random.Random(5)
    for size in (6, 12):
        pairs = {(r.randrange(10), r.randrange(10)) for _ in range(size)} | {(20, 21), (21, 0), (0, 22), (22, 23)}
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        cyclic = {a for a, b in reach if a == b}
        want = {(a, b) for a, b in pairs if (a in cyclic or any((c, a) in reach for c in cyclic)) and (b in cyclic or any((b, c) in reach for c in cyclic))}
        e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "parent string, child string")
        assert {(int(x.parent), int(x.child)) for x in lineage.cyclic_core(e).collect()} == want < pairs


def test_running_and_previous_differ(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate([5, 3, 4])], "g string, k int, v int")
    at = lambda how: [r.k for r in checks.not_rising(df, ["g"], [df["k"]], "v", how).orderBy("k").collect()]
    assert (at("running"), at("previous")) == ([1, 2], [1])


def test_diagnostics_are_distinct_and_sorted_for_readers(spark):
    rows = [("C", "error", p, None, "m") for p in ("/b", "/a/1", "/a-1", "/A", "/a/1")]
    df = spark.createDataFrame(rows, "code string, severity string, instance_path string, schema_path string, message string")
    assert [r.instance_path for r in checks.distinct_diagnostics(df).collect()] == ["/A", "/a-1", "/a/1", "/b"]


def test_strong_components_equal_reachability(spark):
    """Random graphs with tails, chains, loops and closed chains."""
    r = random.Random(8)
    for size in (8, 14, 22):
        pairs = {(r.randrange(12), r.randrange(12)) for _ in range(size)} | {(20, 21), (21, 22), (22, 0), (0, 23), (23, 24), (30, 31), (31, 32), (32, 33), (33, 30), (40, 40), (50, 51), (51, 52), (52, 50), (52, 53)}
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        nodes = {x for p in pairs for x in p}
        want = {(str(a), min(str(b) for b in nodes if (a, b) in reach and (b, a) in reach)) for a in nodes if (a, a) in reach}
        e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "parent string, child string")
        assert {tuple(x) for x in lineage.strong_components(e).collect()} == want
    assert lineage.strong_components(edges(spark, "ab", "bc", "ac")).isEmpty()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """3,000 nodes in a row, with and without an edge that closes them: rounds grow as the logarithm."""
    writes = []
    keep = lineage.materialized
    monkeypatch.setattr(lineage, "materialized", lambda df, name, **k: writes.append(name) or keep(df, name, **k))
    row = spark.range(3000).selectExpr("cast(id AS string) AS parent", "cast(id + 1 AS string) AS child")
    assert lineage.cyclic_core(row).isEmpty() and lineage.strong_components(row).isEmpty()
    for back in ("0", "1000"):
        whole = row.unionByName(spark.createDataFrame([("3000", back)], row.schema))
        n = 3001 - int(back)
        assert lineage.cyclic_core(whole).count() == n
        assert lineage.strong_components(whole).groupBy("component").count().collect()[0]["count"] == n
    assert len(writes) < 250


def test_local_and_looped_traces_agree(spark):
    """Random graphs of several records, with loops, repeated edges and missing ends, both ways and at several depths."""
    r = random.Random(11)
    e = [(str(r.randrange(6)), str(r.randrange(9)), str(r.randrange(9))) for _ in range(90)] + [("1", None, "2"), (None, "1", "2"), ("2", "3", None)]
    e = spark.createDataFrame(e + e[:9], "record_key string, parent string, child string")
    roots = spark.createDataFrame([(str(r.randrange(7)), str(r.randrange(10))) for _ in range(25)], "record_key string, id string")
    for way in ("ancestors", "descendants"):
        for depth in (1, 2, 64):
            (a, cut_a), (b, cut_b) = lineage.trace_local(e, roots, way, depth), lineage.trace_records(e.dropna(), roots, way, depth)
            key = lambda d: sorted(map(tuple, d.collect()))
            assert key(a.select("record_key", "root", "id", "depth")) == key(b.select("record_key", "root", "id", "depth"))
            assert key(cut_a) == key(cut_b)
    with pytest.raises(lineage.LineageError):
        lineage.trace_local(e, roots, "sideways")


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_walks_break_at_the_same_entry_however_rows_are_dealt(spark, parts):
    from pyspark.sql import functions as F

    from tracewell.sources import bundles

    r = random.Random(5)
    files = sorted({"/".join(r.choice(["a", "b", "a-b", "B", "é"]) for _ in range(r.randrange(1, 5))) + f"/f{k}" for k in range(60)})
    sizes = {f: r.randrange(1, 50) for f in files}

    def walk(limits):
        n = total = 0
        folders = {f.rsplit("/", k)[0] for f in files for k in range(1, f.count("/") + 1)}
        for p in sorted(files + list(folders), key=lambda p: [x.encode() for x in p.split("/")]):
            n, total = n + 1, total + sizes.get(p, 0)
            for code, bad in (("BUNDLE_ENTRY_COUNT_LIMIT", n > limits.entries), ("BUNDLE_ENTRY_LIMIT", sizes.get(p, 0) > limits.entry), ("BUNDLE_TOTAL_LIMIT", total > limits.total)):
                if bad:
                    return p, code
        return None

    rows = spark.createDataFrame(list(sizes.items()), "path string, length long").repartition(parts, F.rand(parts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for limits in (bundles.Limits(entries=20), bundles.Limits(total=300), bundles.Limits(entry=48), bundles.Limits(entries=40, total=900, entry=49), bundles.Limits()):
            got = bundles.walk_fault(rows, limits).first()
            assert (tuple(got) if got else None) == walk(limits)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
