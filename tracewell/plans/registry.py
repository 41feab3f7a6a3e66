"""The queries of the record engine over the driver's tables, by name, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import addresses, columns as fx
from tracewell.operators import budgets, checks, lineage
from tracewell.plans import corpus
from tracewell.functions.shapes import SECRET_SHAPES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(corpus.QUERIES)
ORACLES: dict[str, str] = dict(corpus.ORACLES)
COLLECTIONS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def ownership(spark: SparkSession, d: str) -> DataFrame:
    """Edges region - nation - customer - order - line, with typed ids."""
    t = lambda n: table(spark, d, n)
    return (
        t("nation").select(_id("region", "n_regionkey").alias("parent"), _id("nation", "n_nationkey").alias("child"))
        .unionByName(t("customer").select(_id("nation", "c_nationkey").alias("parent"), _id("customer", "c_custkey").alias("child")))
        .unionByName(t("orders").select(_id("customer", "o_custkey").alias("parent"), _id("order", "o_orderkey").alias("child")))
        .unionByName(t("lineitem").select(_id("order", "l_orderkey").alias("parent"), F.concat(_id("line", "l_orderkey"), F.lit("."), F.col("l_linenumber").cast("string")).alias("child")).distinct())
    )


EDGES = """
WITH RECURSIVE e AS (
  SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION SELECT DISTINCT 'order:' || l_orderkey, 'line:' || l_orderkey || '.' || l_linenumber FROM lineitem),
"""


@query(EDGES + "t(id, depth) AS (SELECT 'region:0', 0 UNION SELECT e.child, depth + 1 FROM t JOIN e ON e.parent = t.id WHERE depth < 16) SELECT id, min(depth)::INT AS depth FROM t WHERE depth > 0 GROUP BY id")
def lineage_descendants(spark, d):
    return lineage.trace(ownership(spark, d), "region:0")[0]


@query(EDGES + "t(id, depth) AS (SELECT 'order:1', 0 UNION SELECT e.parent, depth + 1 FROM t JOIN e ON e.child = t.id WHERE depth < 16) SELECT id, min(depth)::INT AS depth FROM t WHERE depth > 0 GROUP BY id")
def lineage_ancestors(spark, d):
    return lineage.trace(ownership(spark, d), "order:1", "ancestors")[0]


@query(EDGES + "t(id, depth) AS (SELECT 'region:0', 0 UNION SELECT e.child, depth + 1 FROM t JOIN e ON e.parent = t.id WHERE depth < 2) SELECT depth::INT AS depth, count(*) AS nodes, true AS truncated FROM t WHERE depth > 0 GROUP BY depth")
def lineage_truncated(spark, d):
    nodes, truncated = lineage.trace(ownership(spark, d), "region:0", max_depth=2)
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes")).withColumn("truncated", F.lit(truncated))


@query(EDGES + "t(id, depth) AS (SELECT 'nation:3', 0 UNION SELECT e.child, depth + 1 FROM t JOIN e ON e.parent = t.id WHERE depth < 2) SELECT parent, child FROM e WHERE parent IN (SELECT id FROM t) AND child IN (SELECT id FROM t)")
def lineage_relations(spark, d):
    edges = ownership(spark, d)
    return lineage.induced(edges, lineage.trace(edges, "nation:3", max_depth=2)[0], "nation:3").select("parent", "child")


@query(EDGES + """a(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT e.parent, depth + 1 FROM a JOIN e ON e.child = a.id WHERE depth < 16),
t(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT e.child, depth + 1 FROM t JOIN e ON e.parent = t.id WHERE depth < 16)
SELECT 'ancestors' AS direction, id, min(depth)::INT AS depth FROM a WHERE depth > 0 GROUP BY id UNION ALL SELECT 'descendants', id, min(depth)::INT FROM t WHERE depth > 0 GROUP BY id""")
def lineage_both(spark, d):
    edges = ownership(spark, d)
    both = [lineage.trace(edges, "customer:1", way)[0].withColumn("direction", F.lit(way)) for way in ("ancestors", "descendants")]
    return both[0].unionByName(both[1])


@query("""WITH RECURSIVE e AS (SELECT user_id AS record_key, event_id AS parent, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS child FROM events),
r AS (SELECT user_id AS record_key, min(event_id) AS root FROM events GROUP BY 1),
t(record_key, root, id, depth) AS (SELECT record_key, root, root, 0 FROM r UNION SELECT t.record_key, root, e.child, depth + 1 FROM t JOIN e ON e.record_key = t.record_key AND e.parent = t.id WHERE child IS NOT NULL AND depth < 8)
SELECT record_key, root, id, depth::INT AS depth FROM t WHERE depth > 0""")
def lineage_per_record(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("record_key"), F.col("event_id").alias("parent"))
    edges = e.withColumn("child", F.lead("parent").over(Window.partitionBy("record_key").orderBy("parent"))).where("child IS NOT NULL")
    return lineage.trace_records(edges, e.groupBy("record_key").agg(F.min("parent").alias("id")), max_depth=8)[0]


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Which type of event follows which for a user, with a first and a last node that lie on no cycle."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("parent"))
    first = e.select(F.lit("start").alias("parent"), F.col("parent").alias("child")).distinct()
    return e.withColumn("child", F.coalesce(F.lead("parent").over(w), F.lit("end"))).select("parent", "child").unionByName(first).distinct()


TRANSITIONS = """
WITH RECURSIVE e AS (SELECT DISTINCT event_type AS parent, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'end') AS child FROM events
  UNION SELECT 'start', event_type FROM events),
r(a, b) AS (SELECT parent, child FROM e UNION SELECT r.a, e.child FROM r JOIN e ON r.b = e.parent),
"""


@query("""WITH t AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders), r AS (SELECT *, sum(cents) OVER (ORDER BY o_orderkey)::BIGINT AS total FROM t)
SELECT o_orderkey, total FROM r WHERE total // 1000000000 > (total - cents) // 1000000000""")
def budget_breaks(spark, d):
    """The orders at which the running total of all prices passes each ten million."""
    orders = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return budgets.passed(orders, ["o_orderkey"], F.col("cents"), 1_000_000_000).select("o_orderkey", "total")


STEPS = """
WITH RECURSIVE s AS (SELECT user_id || ':' || event_type AS parent, user_id || ':' || lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS child FROM events),
e AS (SELECT DISTINCT parent, child FROM s WHERE child IS NOT NULL), r(a, b) AS (SELECT parent, child FROM e UNION SELECT r.a, e.child FROM r JOIN e ON r.b = e.parent)
"""


@query(STEPS + "SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
def event_components(spark, d):
    """Which types of event a user returns between: strongly connected components of all users' steps."""
    from pyspark.sql import Window

    node = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    steps = table(spark, d, "events").select("user_id", "event_id", node.alias("parent"))
    steps = steps.withColumn("child", F.lead("parent").over(Window.partitionBy("user_id").orderBy("event_id"))).where("child IS NOT NULL")
    return lineage.strong_components(steps)


@query(TRANSITIONS + """c AS (SELECT a FROM r WHERE a = b)
SELECT parent, child FROM e WHERE parent IN (SELECT r.b FROM r JOIN c ON r.a = c.a) AND child IN (SELECT r.a FROM r JOIN c ON r.b = c.a)""")
def cycle_core(spark, d):
    return lineage.cyclic_core(transitions(spark, d))


@query(TRANSITIONS + EDGES.replace("WITH RECURSIVE e AS", "o AS").rstrip().rstrip(",") + """,
q(a, b) AS (SELECT parent, child FROM o UNION SELECT q.a, o.child FROM q JOIN o ON q.b = o.parent)
SELECT 'ownership' AS graph, count(*) > 0 AS cyclic FROM q WHERE a = b UNION ALL SELECT 'transitions', count(*) > 0 FROM r WHERE a = b""")
def cycle_verdict(spark, d):
    rows = [(name, not lineage.cyclic_core(g).isEmpty()) for name, g in (("ownership", ownership(spark, d)), ("transitions", transitions(spark, d)))]
    return spark.createDataFrame(rows, "graph string, cyclic boolean")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ref_closure_anti(spark, d):
    return checks.unresolved(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def ref_closure_events(spark, d):
    return checks.unresolved(table(spark, d, "events").select("event_id", "user_id"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])


@query("WITH k AS (SELECT s_suppkey AS id, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)) SELECT event_id, id, kind FROM events JOIN k ON k.id = user_id WHERE kind <> 'customer'")
def typed_ref(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.lit(0).alias("o"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.lit(1).alias("o"))
    known = s.unionByName(c).groupBy("id").agg(F.min(F.struct("o", "kind")).alias("m")).select("id", "m.kind")
    refs = table(spark, d, "events").select("event_id", F.col("user_id").alias("id"), F.array(F.lit("customer")).alias("expected"))
    return checks.wrong_type(refs, known, ["id"]).select("event_id", "id", "kind")


_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) AS n FROM lineitem) WHERE n > 1")
def duplicate_identity(spark, d):
    return checks.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _LINE.split(", ")])


@query("SELECT doc_id, digest FROM (SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1")
def duplicate_content(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return checks.repeated(docs, ["digest"], [F.col("doc_id")])


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def temporal_order(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).where("l_shipdate < o_orderdate").select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_tax < l_discount")
def window_order(spark, d):
    return table(spark, d, "lineitem").where("l_tax < l_discount").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


def _sequences(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("sequence"))


_SEQ = "SELECT o_custkey, o_orderkey, sequence FROM (SELECT *, {} AS b FROM (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS sequence FROM orders)) WHERE sequence <= b"


@query(_SEQ.format("max(sequence) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def sequence_running_max(spark, d):
    return checks.not_rising(_sequences(spark, d), ["o_custkey"], [F.col("o_orderkey")], "sequence")


@query(_SEQ.format("lag(sequence) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"))
def sequence_lag(spark, d):
    return checks.not_rising(_sequences(spark, d), ["o_custkey"], [F.col("o_orderkey")], "sequence", "previous")


@query("SELECT coalesce(a, b) AS orderkey, CASE WHEN a IS NULL THEN 'actual' ELSE 'declared' END AS side FROM (SELECT DISTINCT o_orderkey AS a FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem) ON a = b WHERE a IS NULL OR b IS NULL")
def coverage_diff(spark, d):
    return checks.uncovered(table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey")), ["orderkey"])


@query("SELECT o_orderkey AS id, count(l_orderkey) AS n, count(l_orderkey) = 1 AS once FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def receipt_occurrences(spark, d):
    return checks.occurrences(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS collection, count(*) AS n FROM {c}" for c in COLLECTIONS))
def entity_counts(spark, d):
    return checks.counts({c: table(spark, d, c) for c in COLLECTIONS})


@query("WITH g AS (SELECT l_orderkey AS id, l_shipdate < o_orderdate AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_orderkey AS id, coalesce(NOT bool_or(bad), true) AS valid, count(g.id) FILTER (bad) AS n_diagnostics FROM orders LEFT JOIN g ON g.id = o_orderkey GROUP BY 1")
def verdict_rollup(spark, d):
    found = temporal_order(spark, d).select(F.col("l_orderkey").alias("id"), F.lit("error").alias("severity"))
    return checks.verdicts(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), found, "id")


@query("SELECT doc_id, n_chars, length(text) AS actual FROM documents WHERE n_chars IS DISTINCT FROM length(text)")
def size_mismatch(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "n_chars", F.length("text").cast("long").alias("actual")).where(~F.col("n_chars").eqNullSafe(F.col("actual")))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1")
def relations_by_subject(spark, d):
    m = checks.multimap(table(spark, d, "nation"), "n_regionkey", "n_name", "n_nationkey")
    return m.select(F.col("n_regionkey").alias("region"), F.array_join("values", ",").alias("nations"))


_KEY = "([A-Za-z_][A-Za-z0-9_]*) = \""
_SECRETS = "|".join(fx.SECRET_NAMES + [".*" + e for e in fx.SECRET_ENDINGS])


@query(f"SELECT doc_id, key FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_KEY}', 1)) AS key FROM documents) WHERE regexp_full_match(lower(regexp_replace(key, '[^A-Za-z0-9]', '', 'g')), '{_SECRETS}')")
def secret_key_scan(spark, d):
    keys = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_KEY), F.lit(1))).alias("key"))
    return keys.where(fx.is_secret_key(F.col("key")))


@query(f"SELECT count(*) AS texts, count(*) FILTER (regexp_matches(text, '{SECRET_SHAPES}')) AS with_secrets FROM documents")
def secret_value_scan(spark, d):
    hit = F.when(F.col("text").rlike(SECRET_SHAPES), 1)
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("texts"), F.count(hit).alias("with_secrets"))


_HOST = "lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:[^@]*@)?([^:]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, CASE WHEN {_HOST} = '' THEN 'none' WHEN regexp_matches({_HOST}, '(^|[.])(example|home[.]arpa|invalid|local|localhost|test)$') OR {_HOST} NOT LIKE '%.%' THEN 'non-public' ELSE 'public' END AS class FROM pages")
def host_class(spark, d):
    host = fx.url_host(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), fx.host_class(host).alias("class"))


@query("WITH p AS (SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') || string_split(regexp_extract(url, '#(.*)', 1), '&'), lambda x: x <> '')) AS pair FROM pages) SELECT page_id, split_part(pair, '=', 1) AS name, split_part(pair, '=', 1) IN ('key', 'sig', 'signature', 'token') AS credential FROM p")
def url_parameters(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(fx.url_parameters(F.col("url"))).alias("name"))
    return rows.withColumn("credential", fx.is_credential_parameter(F.col("name")))


_QUAD = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


def _blocks_sql() -> str:
    tests = []
    for block in fx.IPV4_BLOCKS:
        first, bits = block.split("/")
        lo = fx._address(first)
        tests.append(f"n BETWEEN {lo} AND {lo + 2 ** (32 - int(bits)) - 1}")
    return f"({' OR '.join(tests)}) AND n NOT IN ({', '.join(str(fx._address(x)) for x in fx.IPV4_EXCEPTIONS)})"


@query(f"WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_QUAD}')) AS address FROM documents), b AS (SELECT *, list_transform(string_split(address, '.'), lambda x: x::BIGINT) AS o FROM a), c AS (SELECT *, CASE WHEN list_max(o) < 256 AND NOT regexp_matches(address, '(^|[.])0[0-9]') THEN ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] END AS n FROM b) SELECT doc_id, address, n, {_blocks_sql()} AS non_public FROM c")
def ipv4_class(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_QUAD), F.lit(0))).alias("address"))
    rows = rows.withColumn("n", fx.ipv4_number(F.col("address")))
    return rows.withColumn("non_public", fx.is_non_public_ipv4(F.col("n")))


#: Blocks of the query address_blocks, as (first address, leading bits).
_NETS = [("2001:db8::", 32), ("2001:db8:0:1::", 64), ("2001:db8:40::", 42), ("::ffff:0:0", 96), ("::ffff:10.0.0.0", 104), ("::ffff:10.16.0.0", 108), ("10.0.0.0", 8), ("10.128.0.0", 9), ("10.3.0.0", 16)]


@query("""WITH a AS (SELECT event_id, event_id % 3 AS kind, user_id % 256 AS u, event_id % 256 AS e FROM events)
SELECT event_id, CASE WHEN kind = 0 AND u = 0 AND e = 1 THEN '2001:db8:0:1::/64' WHEN kind = 0 AND u >= 64 AND u < 128 THEN '2001:db8:40::/42' WHEN kind = 0 THEN '2001:db8::/32'
  WHEN kind = 1 AND u >= 16 AND u < 32 THEN '::ffff:10.16.0.0/108' WHEN kind = 1 THEN '::ffff:10.0.0.0/104' WHEN u = 3 THEN '10.3.0.0/16' WHEN u >= 128 THEN '10.128.0.0/9' ELSE '10.0.0.0/8' END AS block FROM a""")
def address_blocks(spark, d):
    """Which block, the narrowest of those that overlap, holds the address that each event's numbers spell."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 256).alias("u"), (F.col("event_id") % 256).alias("e"))
    six = F.concat(F.lit("2001:DB8:"), F.lower(F.hex("u")), F.lit(":"), F.hex("e"), F.lit("::7"))
    mapped, four = (F.concat(F.lit(x), F.concat_ws(".", F.lit("10"), "u", "e", F.lit("9"))) for x in ("0:0:0::ffff:", ""))
    text = F.when(F.col("event_id") % 3 == 0, six).when(F.col("event_id") % 3 == 1, mapped).otherwise(four)
    blocks = spark.createDataFrame([(f"{first}/{n}", first, n) for first, n in _NETS], "block string, first string, length int")
    return addresses.longest_block(e.withColumn("bits", addresses.address_bits(text)), blocks, "bits").select("event_id", "block")


@query("WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) SELECT event_id, '/' || replace(replace(key, '~', '~0'), '/', '~1') AS pointer, json_extract_string(props, '$.' || key) AS value FROM k")
def json_walk(spark, d):
    v = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return v.select("event_id", F.concat(F.lit("/"), fx.pointer_segment(F.col("key"))).alias("pointer"), "value")


@query("SELECT doc_id, source, CASE WHEN quality = 1 AND toxic = 0 THEN 'kept' ELSE 'omitted' END AS notice FROM documents JOIN labels USING (doc_id)")
def collection_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    kept = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return rows.select("doc_id", "source", F.when(F.coalesce(kept, F.lit(False)), "kept").otherwise("omitted").alias("notice"))


@query("SELECT source, bool_or(quality = 1 AND toxic = 0) AS permitted, count(*) FILTER (quality = 1 AND toxic = 0) AS permissions FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def permission_exists(spark, d):
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.bool_or(ok).alias("permitted"), F.count_if(ok).alias("permissions"))


_PATH = "lower(regexp_extract(url, '://[^/]*/([^?#]*)', 1))"


@query(f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), q AS (SELECT path, string_split(path, '/') AS s FROM p), a AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS above FROM (SELECT s, unnest(range(1, len(s))) AS n FROM q)) SELECT path FROM p WHERE path IN (SELECT above FROM a)")
def path_collision(spark, d):
    return checks.path_collisions(table(spark, d, "pages").select(F.lower(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)).alias("path")))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) AS turns FROM conversations GROUP BY 1")
def record_summary(spark, d):
    of = lambda role: F.count_if(F.col("role") == role)
    return table(spark, d, "conversations").groupBy("conv_id").agg(of("user").alias("user_turns"), of("assistant").alias("assistant_turns"), F.count(F.lit(1)).alias("turns"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1")
def receipt_duplicate(spark, d):
    return checks.repeated(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("WITH r AS (SELECT DISTINCT l_orderkey AS receipt, l_partkey AS output FROM lineitem), i AS (SELECT DISTINCT l_orderkey AS receipt, l_suppkey AS input FROM lineitem) SELECT r.receipt, r.output FROM r JOIN i ON r.receipt = i.receipt AND r.output = i.input")
def outputs_reuse_inputs(spark, d):
    events = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("receipt")).agg(F.collect_set("l_partkey").alias("outputs"), F.collect_set("l_suppkey").alias("inputs"))
    return events.select("receipt", F.explode(F.array_intersect("outputs", "inputs")).alias("output"))


@query("SELECT DISTINCT l_partkey AS output, l_suppkey AS input FROM lineitem WHERE l_returnflag = 'R' AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def outputs_without_relation(spark, d):
    pairs = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("output"), F.col("l_suppkey").alias("input")).distinct()
    return checks.unresolved(pairs("R"), pairs("A"), ["output", "input"])
