"""The registered queries over the sample tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import world
from .functions import k3, tuples
from .model import KEY, Schema
from .operators import access, filters, fixpoint, store
from .operators import subject_sets as sets
from .operators.filters import Filter, SubjectRelation, Subjects
from .operators.permissions import Planner
from .plans import dsl, graph, validate
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_V = "CAST({} AS VARCHAR)".format
_ROW = "SELECT '{}' rt, {} rid, '{}' rr, '{}' st, {} sid, '{}' sr, {} cav, {} ctx, {} ex FROM {}"


def _sql(rt, rid, rr, st, sid, table, sr="...", cav="CAST(NULL AS VARCHAR)", ctx="CAST(NULL AS VARCHAR)", ex="CAST(NULL AS BIGINT)") -> str:
    return _ROW.format(rt, _V(rid), rr, st, _V(sid), sr, cav, ctx, ex, table)


FAMILY = {
    "owner": _sql("order", "o_orderkey", "owner", "user", "o_custkey", "orders"),
    "supplier": _sql("order", "l_orderkey", "supplier", "supplier", "l_suppkey", "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"),
    "nation": _sql("supplier", "s_suppkey", "nation", "nation", "s_nationkey", "supplier"),
    "citizen": _sql("nation", "c_nationkey", "member", "user", "c_custkey", "customer"),
    "region": _sql("region", "n_regionkey", "member", "nation", "n_nationkey", "nation", "member"),
    "group": _sql("group", "c_custkey + 1", "member", "user", "c_custkey", "customer") + " UNION ALL " + _sql("group", "(c_custkey + 1) // 2", "member", "group", "c_custkey + 1", "customer WHERE c_custkey >= 1", "member"),
    "team": _sql("order", "o_orderkey", "team", "group", "o_custkey + 1", "orders", "member"),
    "banned": _sql("order", "o_orderkey", "banned", "user", "o_custkey", "orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0"),
    "public": _ROW.format("order", _V("o_orderkey"), "viewer", "user", "'*'", "...", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)", "orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
    "payer": _sql("order", "o_orderkey", "payer", "user", "o_custkey", "orders", cav="'min_total'", ctx="'{\"min\":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '}'"),
    "temp": _sql("order", "o_orderkey", "temp", "user", "o_custkey", "orders", ex=f"epoch_us(o_orderdate) * 1000 + {world.YEAR}"),
}
ITEMS = "ev AS (SELECT epoch_us(ts) * 1000 AS rev, CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10 AS VARCHAR) AS rid, CAST(user_id AS VARCHAR) AS sid, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'touch' END AS op, event_type AS payload FROM events)"
INTERVALS = ITEMS + """,
l AS (SELECT *, lag(op) OVER w AS pop, lag(payload) OVER w AS ppay FROM ev WINDOW w AS (PARTITION BY rid, sid ORDER BY rev)),
ch AS (SELECT * FROM l WHERE (op = 'touch' AND (pop IS NULL OR pop = 'delete' OR ppay <> payload)) OR (op = 'delete' AND pop = 'touch')),
iv0 AS (SELECT *, lead(rev) OVER (PARTITION BY rid, sid ORDER BY rev) AS del FROM ch),
iv AS (SELECT rid, sid, payload, rev AS created_rev, del AS deleted_rev FROM iv0 WHERE op = 'touch')"""


def w(*names: str, more: str = "") -> str:
    rel = "rel AS (" + " UNION ALL ".join(FAMILY[n] for n in names) + ")" if names else ""
    return "WITH RECURSIVE " + ", ".join(x for x in (rel, more) if x) + " "


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@cache
def schema() -> Schema:
    return validate.check_schema(dsl.compile_schema(world.SCHEMA))


def rel(spark, d, *names, now=None, context=None) -> DataFrame:
    return access.prepared(schema(), world.relationships(spark, d, *names), now, context)


def subjects(df: DataFrame) -> DataFrame:
    """Rows of a view as plain columns."""
    return df.select("rid", "sid", F.col("c.st").alias("st"), F.array_join("c.missing", ",").alias("missing"))


def pairs(spark, d, permission: str, *names, type_: str = "order", **kw) -> DataFrame:
    return Planner(schema(), rel(spark, d, *names, **kw)).view(type_, permission).rows.select("rid", "sid")


def literal(spark, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


# ---- permissions

REP = "rep AS (SELECT DISTINCT s.rid, c.sid FROM rel s JOIN rel n ON n.rt = 'supplier' AND n.rr = 'nation' AND n.rid = s.sid JOIN rel c ON c.rt = 'nation' AND c.rid = n.sid WHERE s.rt = 'order' AND s.rr = 'supplier')"
GRAPH = ("owner", "supplier", "nation", "citizen", "banned")


@query(w(*GRAPH, more=REP) + "SELECT rid, CAST(count(*) AS BIGINT) AS users FROM (SELECT rid, sid FROM rel WHERE rr = 'owner' UNION SELECT rid, sid FROM rep EXCEPT SELECT rid, sid FROM rel WHERE rr = 'banned') x GROUP BY rid")
def flagship_view(spark, d):
    return Planner(schema(), rel(spark, d, *GRAPH)).totals("order", "view")


@query(w("owner") + "SELECT rid, sid FROM rel")
def direct_relation(spark, d):
    return pairs(spark, d, "owner", "owner")


@query(w("owner") + "SELECT rid, sid FROM rel")
def computed_userset(spark, d):
    return pairs(spark, d, "held", "owner")


@query(w("nation", "citizen") + "SELECT n.rid, c.sid FROM rel n JOIN rel c ON c.rt = 'nation' AND c.rid = n.sid WHERE n.rt = 'supplier'")
def arrow_any(spark, d):
    return pairs(spark, d, "rep", "nation", "citizen", type_="supplier")


@query(w("supplier", "nation", "citizen", more=REP) + "SELECT rid, CAST(count(*) AS BIGINT) AS users, min(sid) AS first_user FROM rep GROUP BY rid")
def arrow_chain(spark, d):
    return Planner(schema(), rel(spark, d, "supplier", "nation", "citizen")).totals("order", "rep", first=True).withColumnRenamed("first", "first_user")


ALL = """t AS (SELECT rid, count(DISTINCT sid) AS n FROM rel WHERE rt = 'order' GROUP BY rid),
g AS (SELECT s.rid, c.sid, count(DISTINCT s.sid) AS k FROM rel s JOIN rel n ON n.rt = 'supplier' AND n.rid = s.sid JOIN rel c ON c.rt = 'nation' AND c.rid = n.sid WHERE s.rt = 'order' GROUP BY 1, 2)"""


@query(w("supplier", "nation", "citizen", more=ALL) + "SELECT g.rid, g.sid FROM g JOIN t ON t.rid = g.rid WHERE g.k = t.n")
def arrow_all(spark, d):
    return pairs(spark, d, "all_reps", "supplier", "nation", "citizen")


@query(w("owner", "banned") + "SELECT DISTINCT rid, sid FROM rel")
def perm_union(spark, d):
    return pairs(spark, d, "any", "owner", "banned")


@query(w("owner", "supplier", "nation", "citizen", more=REP) + "SELECT rid, sid FROM rel WHERE rr = 'owner' INTERSECT SELECT rid, sid FROM rep")
def perm_intersection(spark, d):
    return pairs(spark, d, "both", "owner", "supplier", "nation", "citizen")


@query(w("owner", "banned") + "SELECT rid, sid FROM rel WHERE rr = 'owner' EXCEPT SELECT rid, sid FROM rel WHERE rr = 'banned'")
def perm_exclusion(spark, d):
    return pairs(spark, d, "own", "owner", "banned")


@query(w("owner") + "SELECT rid, sid FROM rel WHERE false")
def perm_nil(spark, d):
    return pairs(spark, d, "nobody", "owner")


@query(w("owner") + "SELECT DISTINCT rid, rid AS sid FROM rel")
def perm_self(spark, d):
    return pairs(spark, d, "me", "owner")


@query(w("region", "citizen") + "SELECT r.rid, c.sid, '...' AS srel FROM rel r JOIN rel c ON c.rt = 'nation' AND c.rid = r.sid WHERE r.rt = 'region' UNION SELECT rid, sid, sr FROM rel WHERE rt = 'region'")
def userset_member(spark, d):
    return Planner(schema(), rel(spark, d, "region", "citizen")).view("region", "member").rows.select("rid", "sid", "srel")


CLOSURE = "up AS (SELECT rid AS child, rid AS grp FROM rel WHERE rt = 'group' UNION SELECT u.child, r.rid FROM up u JOIN rel r ON r.rt = 'group' AND r.sr = 'member' AND r.sid = u.grp)"


@query(w("group", more=CLOSURE) + "SELECT DISTINCT u.grp AS rid, r.sid FROM up u JOIN rel r ON r.rt = 'group' AND r.sr = '...' AND r.rid = u.child")
def group_members(spark, d):
    """Recursive userset, as a fixpoint of the planner."""
    return Planner(schema(), rel(spark, d, "group")).view("group", "member").rows.filter("srel = '...'").select("rid", "sid")


def _group_edges(spark, d):
    g = world.family(spark, d, "group").filter("subject_rel = 'member'")
    return g.select(F.col("subject_id").alias("src"), F.col("resource_id").alias("dst"))


@query(w("group", more=CLOSURE) + "SELECT DISTINCT child AS start, grp AS node FROM up WHERE child IN (SELECT CAST(c_custkey + 1 AS VARCHAR) FROM customer)")
def group_closure(spark, d):
    """Semi-naive reachability."""
    seeds = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 1).cast("string").alias("start")).withColumn("node", F.col("start"))
    return fixpoint.closure(_group_edges(spark, d), seeds).select("start", "node")


@query(ORACLES["group_closure"])
def group_closure_recursive(spark, d):
    """The same by a recursive query."""
    seeds = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 1).cast("string").alias("start")).withColumn("node", F.col("start"))
    return fixpoint.closure_sql(spark, _group_edges(spark, d), seeds, 30)


DEPTHS = "up AS (SELECT CAST(c_custkey + 1 AS VARCHAR) AS start, c_custkey + 1 AS node, 0 AS depth FROM customer UNION ALL SELECT start, node // 2, depth + 1 FROM up WHERE node >= 2)"


@query("WITH RECURSIVE " + DEPTHS + " SELECT start, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY start")
def depth_required(spark, d):
    """How many steps each start needs."""
    seeds = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 1).cast("string").alias("start")).withColumn("node", F.col("start"))
    return fixpoint.closure(_group_edges(spark, d), seeds).groupBy("start").agg(F.max("depth").alias("depth"))


@query(w("owner", "team", "group", more=CLOSURE) + "SELECT rid, CAST(count(*) AS BIGINT) AS users FROM (SELECT rid, sid FROM rel WHERE rr = 'owner' UNION SELECT t.rid, r.sid FROM rel t JOIN up u ON u.grp = t.sid JOIN rel r ON r.rt = 'group' AND r.sr = '...' AND r.rid = u.child WHERE t.rr = 'team') x GROUP BY rid")
def recursive_view(spark, d):
    rows = Planner(schema(), rel(spark, d, "owner", "team", "group")).view("order", "read").rows.filter("stype = 'user'")
    return rows.groupBy("rid").agg(F.count("*").alias("users"))


# ---- wildcards

BAN = "'*' AS sid"


@query(w("public", "banned") + "SELECT o.rid, u.u AS sid, CASE WHEN p.rid IS NULL OR b.rid IS NOT NULL THEN 'notMember' ELSE 'member' END AS verdict FROM (SELECT CAST(o_orderkey AS VARCHAR) rid, CAST(o_custkey AS VARCHAR) own FROM orders) o CROSS JOIN LATERAL (SELECT own AS u UNION SELECT '3') u LEFT JOIN rel p ON p.rr = 'viewer' AND p.rid = o.rid LEFT JOIN rel b ON b.rr = 'banned' AND b.rid = o.rid AND b.sid = u.u")
def wildcard_check(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    asked = o.select(F.col("o_orderkey").cast("string").alias("rid"), F.explode(F.array_distinct(F.array(F.col("o_custkey").cast("string"), F.lit("3")))).alias("sid")).withColumns({"stype": F.lit("user"), "srel": F.lit("...")})
    return access.check(schema(), rel(spark, d, "public", "banned"), "order", "open", asked).select("rid", "sid", "verdict")


EXCLUDED = "SELECT p.rid, '*' AS sid, CAST(3 AS INTEGER) AS st, coalesce(string_agg(b.sid, ',' ORDER BY b.sid), '') AS excluded FROM rel p LEFT JOIN rel b ON b.rr = 'banned' AND b.rid = p.rid WHERE p.rr = 'viewer' GROUP BY p.rid"


@query(w("public", "banned") + EXCLUDED)
def wildcard_exclusion(spark, d):
    """Everybody but the banned."""
    found = sets.listed(Planner(schema(), rel(spark, d, "public", "banned")).view("order", "open"))
    return found.select("rid", "sid", "st", F.array_join("excluded", ",").alias("excluded"))


@query(w("public", "owner") + "SELECT o.rid, o.sid FROM rel o JOIN rel p ON p.rr = 'viewer' AND p.rid = o.rid WHERE o.rr = 'owner'")
def wildcard_intersection(spark, d):
    return pairs(spark, d, "open_owned", "public", "owner").filter("sid <> '*'")


@query(w("public", "banned") + "SELECT CAST(count(*) AS BIGINT) AS objects FROM (SELECT DISTINCT rid FROM rel WHERE rr = 'viewer')")
def wildcard_objects(spark, d):
    return pairs(spark, d, "open", "public", "banned").filter("sid = '*'").agg(F.count("*").alias("objects"))


# ---- checks


def _asked(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    both = F.array_distinct(F.array(F.col("o_custkey").cast("string"), F.pmod(F.col("o_orderkey"), F.lit(50)).cast("string")))
    return o.select(F.col("o_orderkey").cast("string").alias("rid"), F.explode(both).alias("sid")).withColumns({"stype": F.lit("user"), "srel": F.lit("...")})


ASKED = "a AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) rid, CAST(u AS VARCHAR) sid FROM orders, LATERAL (SELECT o_custkey AS u UNION ALL SELECT o_orderkey % 50) x)"


@query(w("owner", more=ASKED) + "SELECT a.rid, a.sid, CASE WHEN r.rid IS NULL THEN 'notMember' ELSE 'member' END AS verdict FROM a LEFT JOIN rel r ON r.rid = a.rid AND r.sid = a.sid")
def check_direct(spark, d):
    return access.check(schema(), rel(spark, d, "owner"), "order", "owner", _asked(spark, d)).select("rid", "sid", "verdict")


@query(w(*GRAPH, more=REP + ", " + ASKED) + "SELECT a.rid, a.sid, CASE WHEN (o.rid IS NOT NULL OR p.rid IS NOT NULL) AND b.rid IS NULL THEN 'member' ELSE 'notMember' END AS verdict FROM a LEFT JOIN rel o ON o.rr = 'owner' AND o.rid = a.rid AND o.sid = a.sid LEFT JOIN rep p ON p.rid = a.rid AND p.sid = a.sid LEFT JOIN rel b ON b.rr = 'banned' AND b.rid = a.rid AND b.sid = a.sid")
def check_bulk(spark, d):
    """Many questions at once; each asked twice, answered once."""
    asked = _asked(spark, d)
    return access.check(schema(), rel(spark, d, *GRAPH), "order", "view", asked.unionByName(asked)).select("rid", "sid", "verdict").distinct()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS rid, 'member' AS verdict FROM orders")
def check_reflexive(spark, d):
    """A permission of an object as its own subject."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("rid"))
    asked = o.withColumns({"sid": F.col("rid"), "stype": F.lit("order"), "srel": F.lit("own")})
    return access.check(schema(), rel(spark, d, "owner", "banned"), "order", "own", asked).select("rid", "verdict")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS rid, 'notMember' AS verdict FROM orders")
def check_unknown_relation(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("rid"), F.lit("user").alias("stype"), F.lit("...").alias("srel"), F.col("o_custkey").cast("string").alias("sid"))
    return access.check(schema(), rel(spark, d, "owner"), "order", "no_such", asked).select("rid", "verdict")


# ---- conditions

PAY = "SELECT rid, sid, CAST({} AS INTEGER) AS st, {} AS missing FROM rel WHERE rr = 'payer'"
MIN = "CAST(regexp_extract(ctx, '[0-9]+') AS DOUBLE)"


@query(w("payer") + PAY.format(f"CASE WHEN 100000 >= {MIN} THEN 2 ELSE 0 END", "''"))
def caveat_decided(spark, d):
    return subjects(Planner(schema(), rel(spark, d, "payer", context={"total": 100000})).view("order", "payer").rows)


@query(w("payer") + PAY.format("1", "'total'"))
def caveat_missing(spark, d):
    return subjects(Planner(schema(), rel(spark, d, "payer")).view("order", "payer").rows)


@query(w("payer") + f"SELECT rid, sid, CASE WHEN 100000 >= {MIN} THEN 'member' ELSE 'notMember' END AS verdict FROM rel")
def caveat_verdict(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    asked = o.select(F.col("o_orderkey").cast("string").alias("rid"), F.lit("user").alias("stype"), F.lit("...").alias("srel"), F.col("o_custkey").cast("string").alias("sid"))
    return access.check(schema(), rel(spark, d, "payer", context={"total": "100000"}), "order", "payer", asked).select("rid", "sid", "verdict")


@query(w("payer", "owner") + PAY.format(f"CASE WHEN 100000 >= {MIN} THEN 2 ELSE 0 END", "''"))
def caveat_and(spark, d):
    """A condition and an unconditional entry."""
    return subjects(Planner(schema(), rel(spark, d, "payer", "owner", context={"total": 100000})).view("order", "paid").rows)


@query(w("payer", "banned") + PAY.format("1", "'total'") + " AND NOT EXISTS (SELECT 1 FROM rel b WHERE b.rr = 'banned' AND b.rid = rel.rid AND b.sid = rel.sid)")
def caveat_minus(spark, d):
    return subjects(Planner(schema(), rel(spark, d, "payer", "banned")).view("order", "pay").rows)


KLEENE = "v AS (SELECT a.x AS a, b.x AS b FROM (VALUES (0), (1), (2), (3)) a(x), (VALUES (0), (1), (2), (3)) b(x))"


@query("WITH " + KLEENE + """ SELECT CAST(a AS INTEGER) a, CAST(b AS INTEGER) b, CAST(greatest(a, b) AS INTEGER) AS either, CAST(least(a, b) AS INTEGER) AS both_, CAST(CASE WHEN a = 3 THEN b WHEN b = 3 THEN a ELSE greatest(a, b) END AS INTEGER) AS kept,
CAST(CASE WHEN a = 3 THEN 3 ELSE 2 - a END AS INTEGER) AS negated, CAST(CASE WHEN b = 3 THEN -1 ELSE least(a, 2 - b) END AS INTEGER) AS less FROM v""")
def condition_algebra(spark, d):
    v = literal(spark, [(a, b) for a in range(4) for b in range(4)], "a int, b int")
    x, y = k3.of(F.col("a")), k3.of(F.col("b"))
    return v.select("a", "b", k3.or_(x, y)["st"].alias("either"), k3.and_(x, y)["st"].alias("both_"), k3.or_keep(x, y)["st"].alias("kept"), k3.not_(x)["st"].alias("negated"), F.coalesce(k3.minus(x, y)["st"], F.lit(-1)).alias("less"))


@query(w("temp") + f"SELECT rid, sid, ex AS expiration_ns FROM rel WHERE ex > {world.NOW}")
def expiration_filter(spark, d):
    return filters.unexpired(world.relationships(spark, d, "temp"), world.NOW).select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), "expiration_ns")


@query(w("owner", "temp") + f"SELECT DISTINCT rid, sid FROM rel WHERE ex IS NULL OR ex > {world.NOW}")
def expiring_view(spark, d):
    return pairs(spark, d, "seen", "owner", "temp", now=world.NOW)


# ---- lookups

USERS = "('7'), ('42')"


def _users(spark):
    return literal(spark, [("user", "7", "..."), ("user", "42", "...")], "stype string, sid string, srel string")


@query(w(*GRAPH, more=REP) + "SELECT DISTINCT rid, 'member' AS verdict FROM (SELECT rid, sid FROM rel WHERE rr = 'owner' UNION SELECT rid, sid FROM rep EXCEPT SELECT rid, sid FROM rel WHERE rr = 'banned') x WHERE sid IN ('7', '42')")
def lookup_resources(spark, d):
    return access.lookup_resources(schema(), rel(spark, d, *GRAPH), "order", "view", _users(spark)).select("rid", "verdict")


@query(w(*GRAPH, more=REP) + "SELECT DISTINCT rid FROM (SELECT rid, sid FROM rel WHERE rr = 'owner' UNION SELECT rid, sid FROM rep EXCEPT SELECT rid, sid FROM rel WHERE rr = 'banned') x WHERE sid IN ('7', '42') AND rid > '1000' ORDER BY rid LIMIT 16")
def lookup_resources_paged(spark, d):
    return access.lookup_resources(schema(), rel(spark, d, *GRAPH), "order", "view", _users(spark), after="1000", limit=16).select("rid")


@query(w("payer") + f"SELECT rid, 'caveated' AS verdict, 'total' AS missing FROM rel WHERE sid IN ('7', '42')")
def lookup_resources_conditional(spark, d):
    found = access.lookup_resources(schema(), rel(spark, d, "payer"), "order", "payer", _users(spark))
    return found.select("rid", "verdict", F.array_join("missing", ",").alias("missing"))


@query(w("owner", "team", "group", more=CLOSURE) + "SELECT DISTINCT t.rid FROM rel t JOIN up u ON u.grp = t.sid JOIN rel r ON r.rt = 'group' AND r.sr = '...' AND r.rid = u.child WHERE t.rr = 'team' AND r.sid IN ('7', '42') UNION SELECT rid FROM rel WHERE rr = 'owner' AND sid IN ('7', '42')")
def lookup_resources_recursive(spark, d):
    return access.lookup_resources(schema(), rel(spark, d, "owner", "team", "group"), "order", "read", _users(spark)).select("rid")


@query(w("public", "banned") + "SELECT rid FROM rel p WHERE rr = 'viewer' AND NOT EXISTS (SELECT 1 FROM rel b WHERE b.rr = 'banned' AND b.rid = p.rid AND b.sid = '7')")
def lookup_resources_wildcard(spark, d):
    one = literal(spark, [("user", "7", "...")], "stype string, sid string, srel string")
    return access.lookup_resources(schema(), rel(spark, d, "public", "banned"), "order", "open", one).select("rid")


def _orders(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("rid"))


@query(w(*GRAPH, more=REP) + "SELECT rid, sid FROM rel WHERE rr = 'owner' UNION SELECT rid, sid FROM rep EXCEPT SELECT rid, sid FROM rel WHERE rr = 'banned'")
def lookup_subjects(spark, d):
    return access.lookup_subjects(schema(), rel(spark, d, *GRAPH), "order", "view", _orders(spark, d), "user").select("rid", "sid")


@query(w("public", "banned") + EXCLUDED.replace("CAST(3 AS INTEGER) AS st, ", ""))
def lookup_subjects_wildcard(spark, d):
    objects = world.family(spark, d, "public").select(F.col("resource_id").alias("rid"))
    found = access.lookup_subjects(schema(), rel(spark, d, "public", "banned"), "order", "open", objects, "user")
    return found.select("rid", "sid", F.array_join("excluded", ",").alias("excluded"))


@query(w("supplier", "nation", "citizen", more=REP) + "SELECT rid, sid FROM (SELECT rid, sid, row_number() OVER (PARTITION BY rid ORDER BY sid) AS n FROM rep) x WHERE n <= 3")
def lookup_subjects_limit(spark, d):
    return access.lookup_subjects(schema(), rel(spark, d, "supplier", "nation", "citizen"), "order", "rep", _orders(spark, d), "user", limit=3).select("rid", "sid")


@query(w("group", more=CLOSURE) + "SELECT DISTINCT r.sid AS start, u.grp AS rid FROM up u JOIN rel r ON r.rt = 'group' AND r.sr = '...' AND r.rid = u.child")
def membership_walk(spark, d):
    """All groups of all users over stored tuples alone."""
    users = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("user").alias("stype"), F.col("c_custkey").cast("string").alias("sid"), F.lit("...").alias("srel"))
    return access.covered(schema(), rel(spark, d, "group"), "group", "member", users).select(F.split("start", "\x1f")[1].alias("start"), "rid")


@query(w("group", more=CLOSURE) + "SELECT DISTINCT u.grp AS rid FROM up u JOIN rel r ON r.rt = 'group' AND r.sr = '...' AND r.rid = u.child WHERE r.sid IN ('7', '42')")
def covered_candidates(spark, d):
    return access.covered(schema(), rel(spark, d, "group"), "group", "member", _users(spark)).select("rid").distinct().orderBy("rid")


@query(w("owner", "banned") + "SELECT rid AS root, kind, op, subject FROM (SELECT rid, 'leaf' AS kind, '' AS op, 'user:' || sid AS subject FROM rel UNION ALL SELECT o, k, p, '' FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) o FROM orders), (VALUES ('node', 'exclusion'), ('node', 'computed'), ('node', 'computed'), ('node', 'this'), ('node', 'this')) v(k, p)) x")
def expand_shallow(spark, d):
    objects = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("rid"))
    return access.expand(schema(), rel(spark, d, "owner", "banned"), "order", "own", objects).select("root", "kind", "op", "subject")


@query(w("region", "citizen") + "SELECT rid AS root, 'region:' || rid || '#member' AS object, 'nation:' || sid || '#member' AS subject FROM rel WHERE rt = 'region' UNION ALL SELECT r.rid, 'nation:' || c.rid || '#member', 'user:' || c.sid FROM rel r JOIN rel c ON c.rt = 'nation' AND c.rid = r.sid WHERE r.rt = 'region'")
def expand_recursive(spark, d):
    objects = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("string").alias("rid"))
    tree = access.expand(schema(), rel(spark, d, "region", "citizen"), "region", "member", objects, recursive=True)
    return tree.filter("kind = 'leaf'").select("root", "object", "subject")


@query(w("supplier", "nation") + "SELECT rid AS root, CAST(count(*) AS BIGINT) AS targets FROM rel WHERE rt = 'order' GROUP BY rid")
def expand_arrow(spark, d):
    objects = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("rid"))
    tree = access.expand(schema(), rel(spark, d, "supplier", "nation"), "order", "all_reps", objects)
    return tree.filter("kind = 'node' and parent = '0'").groupBy("root").agg(F.count("*").alias("targets"))


# ---- filters

PLAIN = "SELECT rt AS resource_type, rid AS resource_id, rr AS resource_rel, st AS subject_type, sid AS subject_id, sr AS subject_rel FROM rel "
SOME = ("owner", "region", "group", "payer", "temp", "public", "team")


def _some(spark, d, f: Filter):
    return filters.query(world.relationships(spark, d, *SOME), f).select(*KEY)


@query(w(*SOME) + PLAIN + "WHERE rt = 'order' AND rid IN ('1', '2', '33') AND rr = 'owner'")
def filter_resource(spark, d):
    return _some(spark, d, Filter(type="order", ids=("1", "2", "33"), relation="owner"))


@query(w(*SOME) + PLAIN + "WHERE rt = 'order' AND starts_with(rid, '12')")
def filter_prefix(spark, d):
    return _some(spark, d, Filter(type="order", prefix="12"))


@query(w(*SOME) + PLAIN + "WHERE (st = 'user' AND sid IN ('7', '*')) OR (st = 'nation')")
def filter_subject_selectors(spark, d):
    return _some(spark, d, Filter(subjects=(Subjects("user", ("7", "*")), Subjects("nation"))))


@query(w(*SOME) + " UNION ALL ".join(f"SELECT '{k}' AS how, CAST(count(*) AS BIGINT) AS n FROM rel WHERE {c}" for k, c in (("any", "true"), ("ellipsis", "true"), ("named", "sr = 'member'"), ("both", "sr IN ('member', '...')"), ("other", "sr <> '...'"))))
def filter_relation_filter(spark, d):
    """An ellipsis flag alone matches every subject relation."""
    rows = world.relationships(spark, d, *SOME)
    kinds = {"any": SubjectRelation(), "ellipsis": SubjectRelation(ellipsis=True), "named": SubjectRelation(("member",)), "both": SubjectRelation(("member",), True), "other": SubjectRelation(only_other=True)}
    sums = rows.agg(*(F.count(F.when(Subjects(relation=r).column(), 1)).alias(k) for k, r in kinds.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("how"), F.col(k).alias("n")) for k in kinds))).alias("x")).select("x.how", "x.n")


@query(w(*SOME) + PLAIN + "WHERE cav = 'min_total'")
def filter_caveat(spark, d):
    return _some(spark, d, Filter(caveat="min_total"))


@query(w(*SOME) + "SELECT rr AS resource_rel, CAST(count(*) AS BIGINT) AS n FROM rel WHERE cav IS NULL GROUP BY rr")
def filter_no_caveat(spark, d):
    return _some(spark, d, Filter(caveat="")).groupBy("resource_rel").agg(F.count("*").alias("n"))


@query(w(*SOME) + PLAIN + "WHERE ex IS NOT NULL")
def filter_expiration(spark, d):
    return _some(spark, d, Filter(expires=True))


@query(w(*SOME) + PLAIN + "WHERE rt = 'order' AND rr = 'team' AND ((st = 'user' AND sid IN ('7', '*')) OR sr <> '...')")
def check_pushdown_scan(spark, d):
    return filters.check_scan(world.relationships(spark, d, *SOME), "order", "team", ("user", "7", "...")).select(*KEY)


@query(w(*SOME) + PLAIN + "WHERE st = 'user' AND sid IN ('7', '8') ORDER BY st, sid, sr, rt, rid, rr")
def reverse_by_subject_sorted(spark, d):
    found = filters.reverse(world.relationships(spark, d, *SOME), Subjects("user", ("7", "8")))
    return filters.page(found.select(*KEY), filters.BY_SUBJECT)


@query(w(*SOME) + PLAIN + "WHERE (st, sid, sr, rt, rid, rr) > ('user', '7', '...', 'order', '1', 'owner') ORDER BY st, sid, sr, rt, rid, rr LIMIT 25")
def keyset_after(spark, d):
    return filters.page(world.relationships(spark, d, *SOME).select(*KEY), filters.BY_SUBJECT, ("user", "7", "...", "order", "1", "owner"), 25)


LINE = "rt || ':' || rid || '#' || rr || '@' || st || ':' || sid || CASE WHEN sr = '...' THEN '' ELSE '#' || sr END"
TAGS = LINE + " || CASE WHEN cav IS NULL THEN '' ELSE '[' || cav || ':' || ctx || ']' END || CASE WHEN ex IS NULL THEN '' ELSE '[expiration:' || strftime(make_timestamp(ex // 1000), '%Y-%m-%dT%H:%M:%S') || 'Z]' END"


@query(w(*SOME) + f"SELECT {TAGS} AS tuple FROM rel WHERE rt = 'order' AND starts_with(rid, '1') ORDER BY 1 LIMIT 100")
def read_relationships(spark, d):
    return filters.read(world.relationships(spark, d, *SOME), Filter(type="order", prefix="1"), limit=100).select("tuple")


@query(w(*SOME) + f"SELECT {TAGS} AS tuple FROM rel WHERE {TAGS} > 'order:12#' ORDER BY 1 LIMIT 1000")
def bulk_export_page(spark, d):
    from .sources import files

    return files.export(world.relationships(spark, d, *SOME), cursor="order:12#")


@query(w(*SOME) + f"SELECT {TAGS} AS tuple FROM rel")
def tuple_format(spark, d):
    return world.relationships(spark, d, *SOME).select(tuples.text().alias("tuple"))


@query(w(*SOME) + "SELECT rt AS resource_type, rid AS resource_id, rr AS resource_rel, st AS subject_type, sid AS subject_id, sr AS subject_rel, coalesce(cav, '') AS caveat_name, coalesce(ctx, '') AS caveat_ctx, coalesce(ex, 0) AS expiration_ns FROM rel")
def tuple_parse(spark, d):
    """Lines and back, by the whole grammar."""
    rows = tuples.parse(world.relationships(spark, d, *SOME).select(tuples.text().alias("value")))
    return rows.select(*KEY, *(F.coalesce(c, F.lit(x)).alias(c) for c, x in (("caveat_name", ""), ("caveat_ctx", ""), ("expiration_ns", 0))))


@query(w("owner", "region", "group") + PLAIN)
def tuple_parse_builtin(spark, d):
    lines = world.relationships(spark, d, "owner", "region", "group").select(tuples.text(extras=False).alias("line"))
    return lines.select(*tuples.parts(F.col("line")))


@query(w("owner", "public") + "SELECT rr AS resource_rel, CAST(count(*) AS BIGINT) AS n FROM rel WHERE rid <> '*' GROUP BY rr")
def well_formed(spark, d):
    return filters.well_formed(world.relationships(spark, d, "owner", "public")).groupBy("resource_rel").agg(F.count("*").alias("n"))


@query("SELECT 'a' AS fault, CAST(0 AS BIGINT) AS n WHERE false")
def schema_validation_clean(spark, d):
    """All sample relationships fit the schema."""
    return validate.relationship_faults(schema(), world.relationships(spark, d)).groupBy("fault").agg(F.count("*").alias("n"))


# ---- time

ITEM = "SELECT rid, sid, payload, created_rev, coalesce(deleted_rev, 0) AS deleted_rev FROM iv "
MID = "(SELECT epoch_us(min(ts) + (max(ts) - min(ts)) / 2) * 1000 FROM events)"


def _items(spark, d):
    return store.intervals(world.item_changes(spark, d))


def _item(df):
    return df.select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), F.col("caveat_ctx").alias("payload"), "created_rev", F.coalesce("deleted_rev", F.lit(0)).alias("deleted_rev"))


def _middle(spark, d) -> int:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return (e["a"] + (e["b"] - e["a"]) // 2) * 1000


@query("WITH " + INTERVALS + " " + ITEM)
def mvcc_intervals(spark, d):
    return _item(_items(spark, d))


@query("WITH " + INTERVALS + f" {ITEM} WHERE created_rev <= {MID} AND (deleted_rev IS NULL OR deleted_rev > {MID})")
def snapshot_at(spark, d):
    return _item(filters.visible(_items(spark, d), _middle(spark, d)))


@query("WITH " + INTERVALS + f" {ITEM} WHERE deleted_rev IS NULL OR deleted_rev > {MID}")
def gc_collect(spark, d):
    return _item(store.collected(_items(spark, d), _middle(spark, d)))


LIVE = "live AS (SELECT rid, sid, payload, created_rev FROM iv WHERE deleted_rev IS NULL)"
NEW = 10**19 // 10
UPD = "u AS (SELECT CASE WHEN CAST(sid AS BIGINT) % 3 = 0 THEN 'delete' ELSE 'touch' END AS op, rid, sid, CASE WHEN CAST(sid AS BIGINT) % 3 = 1 THEN payload ELSE 'new' END AS p FROM live)"


def _updates(spark, d):
    live = _items(spark, d).filter("deleted_rev is null")
    k = F.col("subject_id").cast("long") % 3
    return live.select(F.when(k == 0, "delete").otherwise("touch").alias("op"), *KEY, "caveat_name", F.when(k == 1, F.col("caveat_ctx")).otherwise("new").alias("caveat_ctx"), "expiration_ns")


@query("WITH " + INTERVALS + f", {LIVE}, {UPD} SELECT rid, sid, payload, created_rev, CASE WHEN deleted_rev IS NULL AND (CAST(sid AS BIGINT) % 3 = 0 OR (CAST(sid AS BIGINT) % 3 = 2 AND payload <> 'new')) THEN {NEW} ELSE coalesce(deleted_rev, 0) END AS deleted_rev FROM iv UNION ALL SELECT rid, sid, p, {NEW}, 0 FROM u WHERE op = 'touch' AND p = 'new'")
def write_touch_delete(spark, d):
    """A touch with the same payload changes nothing."""
    return _item(store.apply_updates(_items(spark, d), _updates(spark, d), NEW))


@query("WITH " + INTERVALS + f", {LIVE} SELECT DISTINCT rid, sid, 'exists' AS why FROM live")
def write_create_conflicts(spark, d):
    rows = _items(spark, d)
    creates = rows.select(F.lit("create").alias("op"), *KEY, "caveat_name", "caveat_ctx", "expiration_ns").dropDuplicates(list(KEY))
    return store.conflicts(rows, creates).select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), "why")


@query(w("owner") + "SELECT rid, sid, 'twice' AS why FROM rel WHERE CAST(rid AS BIGINT) % 7 = 0")
def bulk_import_conflicts(spark, d):
    rows = world.relationships(spark, d, "owner")
    again = rows.filter(F.col("resource_id").cast("long") % 7 == 0)
    updates = rows.unionByName(again).withColumn("op", F.lit("create"))
    none = rows.limit(0).withColumns({"created_rev": F.lit(0).cast("long"), "deleted_rev": F.lit(None).cast("long")})
    return store.conflicts(none, updates).select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), "why")


@query(w("owner", "banned") + PLAIN + "WHERE rt = 'order' AND rr = 'banned' ORDER BY rt, rid, rr, st, sid, sr LIMIT 20")
def delete_limit(spark, d):
    return store.to_delete(world.relationships(spark, d, "owner", "banned"), Filter(type="order", relation="banned"), 20)[0].select(*KEY)


@query(w("owner") + "SELECT CAST(least(n, 20) AS BIGINT) AS deleted, n >= 20 AS reached FROM (SELECT count(*) AS n FROM rel WHERE starts_with(rid, '1'))")
def delete_reached(spark, d):
    return store.to_delete(world.relationships(spark, d, "owner"), Filter(prefix="1"), 20)[1]


@query(w("owner", "banned") + "SELECT 'has_owner' AS name, count(*) > 0 AS holds FROM rel WHERE rr = 'owner' UNION ALL SELECT 'no_items', count(*) = 0 FROM rel WHERE rt = 'item' UNION ALL SELECT 'no_banned', count(*) = 0 FROM rel WHERE rr = 'banned'")
def preconditions(spark, d):
    wanted = [("has_owner", Filter(relation="owner"), True), ("no_items", Filter(type="item"), False), ("no_banned", Filter(relation="banned"), False)]
    return filters.conditions(world.relationships(spark, d, "owner", "banned"), wanted)


@query(w("banned") + "SELECT CAST(count(*) AS BIGINT) AS n FROM rel")
def counter_count(spark, d):
    return filters.counted(world.relationships(spark, d, "owner", "banned"), Filter(relation="banned"))


VERSIONS = "v AS (SELECT epoch_us(ts) * 1000 AS rev, 'c' || (user_id % 20) AS name, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS filter FROM events)"


def _versions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("rev"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("name"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("filter"))


@query("WITH " + VERSIONS + f", l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rev DESC) AS n FROM v WHERE rev <= {MID}) SELECT rev, name, filter FROM l WHERE n = 1 AND filter IS NOT NULL")
def counters_live(spark, d):
    return store.as_of(_versions(spark, d), ["name"], _middle(spark, d), "filter")


@query("WITH " + VERSIONS + f" SELECT rev, filter FROM v WHERE filter IS NOT NULL AND rev <= {MID} ORDER BY rev DESC LIMIT 1")
def schema_as_of(spark, d):
    return store.as_of(_versions(spark, d).filter("filter is not null"), [], _middle(spark, d)).select("rev", "filter")


CHANGES = """made AS (SELECT created_rev AS rev, 'touch' AS op, rid, sid FROM iv),
gone AS (SELECT deleted_rev AS rev, 'delete' AS op, rid, sid FROM iv g WHERE deleted_rev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM made m WHERE m.rev = g.deleted_rev AND m.rid = g.rid AND m.sid = g.sid)),
chg AS (SELECT * FROM made UNION ALL SELECT * FROM gone)"""


@query("WITH " + INTERVALS + ", " + CHANGES + f" SELECT rev, op, rid, sid FROM chg WHERE rev > {MID}")
def watch_changes(spark, d):
    found = store.changes_at(_items(spark, d), _middle(spark, d), (1 << 63) - 1)
    return found.select("rev", "op", F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"))


def _log(spark, d):
    return store.changes_at(_items(spark, d), 0, (1 << 63) - 1).withColumns({"seq": F.lit(0), "schema_changed": F.lit(False)})


@query("WITH " + INTERVALS + ", " + CHANGES + f" SELECT rev, op, rid, sid FROM chg WHERE rev > {MID} AND rid IN ('1', '2')")
def watch_filtered(spark, d):
    found = watch.changes(_log(spark, d), _middle(spark, d), filters=(Filter(type="item", ids=("1", "2")),))
    return found.select("rev", "op", F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"))


@query("WITH " + INTERVALS + ", " + CHANGES + " SELECT max(rev) AS rev FROM chg")
def watch_checkpoint(spark, d):
    return _log(spark, d).agg(F.max("rev").alias("rev"))


@query("WITH " + INTERVALS + " SELECT rid, sid, payload, created_rev FROM iv WHERE deleted_rev IS NULL")
def log_fold(spark, d):
    """The live state from the change feed alone."""
    return watch.folded(_log(spark, d)).select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), F.col("caveat_ctx").alias("payload"), "created_rev")


# ---- schemas

DOC = """
definition user {}
definition team { relation member: user | team#member }
definition folder { relation parent: folder relation viewer: user permission view = viewer + parent->view }
definition doc {
  relation folder: folder
  relation owner: user | team#member
  relation blocked: user
  permission edit = owner
  permission view = (edit + folder->view) - blocked
}
"""
OLD = DOC.replace("relation blocked: user", "relation blocked: user | user:*").replace("permission edit = owner", "permission edit = owner + blocked\n relation legacy: user")


def _values(rows: list[tuple[str, ...]], *columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) if isinstance(x, str) else str(x).lower() for x in r) + ')' for r in rows)}) v({', '.join(columns)})"


@query("WITH RECURSIVE e(src, dst) AS (VALUES ('folder#viewer', 'folder#view'), ('folder#parent', 'folder#view'), ('folder#view', 'folder#view'), ('doc#owner', 'doc#edit'), ('doc#edit', 'doc#view'), ('folder#view', 'doc#view'), ('doc#folder', 'doc#view'), ('doc#blocked', 'doc#view')), r AS (SELECT dst FROM e WHERE src = 'folder#viewer' UNION SELECT e.dst FROM r JOIN e ON e.src = r.dst) SELECT dst AS permission FROM r")
def computable_permissions(spark, d):
    found = graph.computable_permissions(dsl.compile_schema(DOC), "folder", "viewer")
    return literal(spark, [(f"{t}#{r}",) for t, r, _ in found], "permission string")


@query("WITH RECURSIVE e(src, dst) AS (VALUES ('folder#viewer', 'folder#view'), ('folder#parent', 'folder#view'), ('folder#view', 'folder#view'), ('doc#owner', 'doc#edit'), ('doc#edit', 'doc#view'), ('folder#view', 'doc#view'), ('doc#folder', 'doc#view'), ('doc#blocked', 'doc#view'), ('team#member', 'doc#owner')), r AS (SELECT src FROM e WHERE dst = 'doc#view' UNION SELECT e.src FROM r JOIN e ON e.dst = r.src) SELECT src AS relation FROM r")
def dependent_relations(spark, d):
    found = graph.dependent_relations(dsl.compile_schema(DOC), "doc", "view")
    return literal(spark, [(f"{t}#{r}",) for t, r, _ in found], "relation string")


@query(_values([("permission_expr_changed", "doc#edit"), ("relation_removed", "doc#legacy"), ("subject_type_removed", "doc#blocked")], "kind", "on_"))
def schema_diff(spark, d):
    found = graph.schema_diff(dsl.compile_schema(OLD), dsl.compile_schema(DOC))
    return literal(spark, [(x.kind, x.on) for x in found], "kind string, on_ string")


@query(_values([("relation", "user", "...", "doc", "owner"), ("relation", "team", "member", "doc", "owner"), ("relation", "user", "...", "team", "member"), ("relation", "team", "member", "team", "member"), ("computed", "doc", "owner", "doc", "edit")], "kind", "source_type", "source_rel", "target_type", "target_rel"))
def reachability_edges(spark, d):
    steps = graph.toward(graph.entries(dsl.compile_schema(DOC), first=True), ("doc", "edit"))
    return literal(spark, [(e.kind, *e.source, *e.target) for e in steps], "kind string, source_type string, source_rel string, target_type string, target_rel string")


@query(_values([("permission", "doc", "edit", "owner"), ("permission", "doc", "view", "(edit + folder->view) - blocked"), ("relation", "doc", "blocked", "user"), ("relation", "doc", "folder", "folder"), ("relation", "doc", "owner", "user | team#member")], "kind", "owner", "name", "detail"))
def reflect_schema(spark, d):
    return literal(spark, graph.reflect(dsl.compile_schema(DOC), definition="doc"), "kind string, owner string, name string, detail string")


@query(w("banned") + "SELECT rid, sid, 'subject type not allowed' AS fault FROM rel")
def orphan_check(spark, d):
    """Rows that a schema without banned users would orphan."""
    new = dsl.compile_schema(world.SCHEMA.replace("relation banned: user", "relation banned: group"))
    found = validate.orphans(schema(), new, world.relationships(spark, d, "owner", "banned"))
    return found.select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), "fault")


# ---- caveat functions: each evaluated over a table's values, next to the engine's own function


def _cel(spark, d, body: str, params: str, table: str, ctx, key: str, caveat: str = "c") -> DataFrame:
    """(id, holds): a caveat over the rows of a table, with a JSON context made of each row."""
    s = validate.check_schema(dsl.compile_schema(f"definition user {{}} definition thing {{ relation r: user with {caveat} }} caveat {caveat}({params}) {{ {body} }}"))
    t = spark.read.parquet(f"{d}/{table}.parquet")
    rows = world._rows(t.withColumn("j", F.to_json(F.struct(*(v.alias(k) for k, v in ctx.items())))), "thing", F.col(key), "r", "user", F.lit("u"), caveat=caveat, ctx=F.col("j"))
    k = access.prepared(s, rows)
    return k.select(F.col("resource_id").alias("id"), (F.col("k.st") == k3.T).alias("holds"))


def _row(sql: str, table: str, key: str) -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS id, {sql} AS holds FROM {table}"


@query(_row("c_custkey % 7 + 3 * (c_custkey // 5) - 2 > c_custkey AND NOT (-c_custkey < -100)", "customer", "c_custkey"))
def cel_arithmetic(spark, d):
    return _cel(spark, d, "n % 7 + 3 * (n / 5) - 2 > n && !(-n < -100)", "n int", "customer", {"n": F.col("c_custkey")}, "c_custkey")


@query(_row("CASE WHEN c_custkey < 50 THEN c_custkey = 7 OR c_custkey IN (1, 2, 3) ELSE c_custkey >= 900 AND c_custkey <> 950 END", "customer", "c_custkey"))
def cel_logic(spark, d):
    return _cel(spark, d, "n < 50 ? n == 7 || n in [1, 2, 3] : n >= 900 && n != 950", "n int", "customer", {"n": F.col("c_custkey")}, "c_custkey")


@query(_row("contains(c_name, '1') AND starts_with(c_name, 'Cust') AND ends_with(c_name, '5') OR regexp_matches(c_name, '0[3-6]9$')", "customer", "c_custkey"))
def cel_strings(spark, d):
    return _cel(spark, d, "s.contains('1') && s.startsWith('Cust') && s.endsWith('5') || s.matches('0[3-6]9$')", "s string", "customer", {"s": F.col("c_name")}, "c_custkey")


@query(_row("length(c_mktsegment) + 2 > 10", "customer", "c_custkey"))
def cel_size(spark, d):
    return _cel(spark, d, "size(s) + [1, 2].size() > 10", "s string", "customer", {"s": F.col("c_mktsegment")}, "c_custkey")


@query(_row("CAST(c_custkey AS VARCHAR) = '12' OR CAST(trunc(c_acctbal) AS BIGINT) > 5000", "customer", "c_custkey"))
def cel_conversions(spark, d):
    return _cel(spark, d, "string(n) == '12' || int(b) > 5000 && double(n) >= 0.0", "n int, b double", "customer", {"n": F.col("c_custkey"), "b": F.col("c_acctbal")}, "c_custkey")


@query(_row("year(o_orderdate) = 1995 AND month(o_orderdate) = 3 OR dayofyear(o_orderdate) = 100 OR day(o_orderdate) = 31 AND dayofweek(o_orderdate) = 0", "orders", "o_orderkey"))
def cel_time(spark, d):
    t = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _cel(spark, d, "t.getFullYear() == 1995 && t.getMonth() == 2 || t.getDayOfYear() == 99 || t.getDate() == 31 && t.getDayOfWeek() == 0", "t timestamp", "orders", {"t": t}, "o_orderkey")


@query(_row("o_orderdate - INTERVAL 36 HOUR > TIMESTAMP '1996-02-29 00:00:00'", "orders", "o_orderkey"))
def cel_duration(spark, d):
    t = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _cel(spark, d, "t - duration('36h') > timestamp('1996-02-29T00:00:00Z')", "t timestamp", "orders", {"t": t}, "o_orderkey")


@query(_row("c_custkey % 3 = 0 OR c_custkey % 5 = 0", "customer", "c_custkey"))
def cel_macros(spark, d):
    xs = F.array(F.col("c_custkey") % 3, F.col("c_custkey") % 5)
    return _cel(spark, d, "xs.exists(x, x == 0) && xs.all(x, x >= 0) && xs.map(x, x + 1).filter(y, y > 0).size() == 2", "xs list<int>", "customer", {"xs": xs}, "c_custkey")


@query(_row("c_custkey % 2 = 0 AND c_nationkey = 3", "customer", "c_custkey"))
def cel_maps(spark, d):
    m = F.create_map(F.lit("even"), F.col("c_custkey") % 2, F.lit("nation"), F.col("c_nationkey").cast("long"))
    return _cel(spark, d, "m['even'] == 0 && m.nation == 3 && has(m.even) && !('x' in m)", "m map<int>", "customer", {"m": m}, "c_custkey")


@query(_row("c_custkey % 4 = 2", "customer", "c_custkey"))
def caveat_in_cidr(spark, d):
    ip = F.concat(F.lit("10."), (F.col("c_custkey") % 4).cast("string"), F.lit(".0."), (F.col("c_custkey") % 256).cast("string"))
    return _cel(spark, d, "ip.in_cidr('10.2.0.0/16')", "ip ipaddress", "customer", {"ip": ip}, "c_custkey")


@query(_row("c_nationkey = 3", "customer", "c_custkey"))
def caveat_subtree(spark, d):
    m = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("long"))
    big = F.create_map(F.lit("nation"), F.lit(3).cast("long"), F.lit("other"), F.lit(1).cast("long"))
    return _cel(spark, d, "m.isSubtreeOf(big)", "m map<any>, big map<any>", "customer", {"m": m, "big": big}, "c_custkey")


# ---- set algebra with wildcards and conditions: what each operation says of every supplier and its customers

ALGEBRA = """
definition user {}
caveat lucky(n int, want int) { n == want }
definition doc {
  relation left: user | user with lucky | user:* | user:* with lucky
  relation right: user | user with lucky | user:* | user:* with lucky
  relation plain: user | user with lucky
  permission either = left + right
  permission both = left & right
  permission rest = left - right
  permission listed_rest = plain - left
  permission listed_both = plain & left
  permission open_rest = left - plain
  permission listed_either = left + plain
  permission nested = (left + plain) - (right & left)
}
definition hub {
  relation has: doc | doc with lucky
  permission any = has->left
  permission every = has.all(left)
}
"""
# what (supplier s, customer c) and (supplier s, everybody) have in each relation: no entry or condition 0 to 2
DIRECT = {"left": "CASE WHEN (s + c) % 3 = 0 THEN NULL WHEN c % 4 = 0 THEN 1 WHEN c % 4 = 2 THEN 0 ELSE 2 END", "right": "CASE WHEN (s + c) % 2 = 1 THEN NULL WHEN c % 6 = 0 THEN 1 ELSE 2 END", "plain": "CASE WHEN c % 3 <> 1 THEN NULL WHEN c % 9 = 1 THEN 1 ELSE 2 END"}
OPEN = {"left": "CASE WHEN s % 5 = 0 THEN 2 WHEN s % 5 = 1 THEN 1 END", "right": "CASE WHEN s % 10 = 0 THEN 2 WHEN s % 10 = 1 THEN 1 WHEN s % 10 = 5 THEN 0 END"}
HAS = "CASE WHEN s % 7 = 0 THEN 1 ELSE 2 END"
CONTEXTS = {0: '{"n":1,"want":2}', 1: '{"n":1}'}
DEALS = "deals AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
STATE = {r: f"greatest(coalesce({DIRECT[r]}, 0), coalesce({OPEN.get(r, 'NULL')}, 0))" for r in DIRECT}


def _deals(spark, d) -> DataFrame:
    items, orders = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s"), F.col("o_custkey").alias("c")).distinct()


@cache
def _algebra_schema() -> Schema:
    return validate.check_schema(dsl.compile_schema(ALGEBRA))


def _algebra_rows(spark, d, *names: str) -> DataFrame:
    """Relationships of the documents (suppliers) and hubs (nations)."""
    deals, suppliers = fixpoint.keep(_deals(spark, d)), spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("s"), "s_nationkey")
    parts = []

    def add(df, state, rt, rid, rel_, st, sid):
        df = df.withColumn("state", F.expr(state)).filter("state is not null")
        ctx = F.when(F.col("state") == 0, CONTEXTS[0]).when(F.col("state") == 1, CONTEXTS[1])
        rows = world._rows(df, rt, rid, rel_, st, sid, ctx=ctx)
        parts.append(rows.withColumn("caveat_name", F.when(F.col("caveat_ctx").isNotNull(), "lucky")))

    for r in names:
        if r == "has":
            add(suppliers, HAS, "hub", F.col("s_nationkey"), "has", "doc", F.col("s"))
            continue
        add(deals, DIRECT[r], "doc", F.col("s"), r, "user", F.col("c"))
        if r in OPEN:
            add(suppliers, OPEN[r], "doc", F.col("s"), r, "user", F.lit("*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return access.prepared(_algebra_schema(), out)


def _verdicts(spark, d, type_: str, permission: str, asked: DataFrame, *names: str) -> DataFrame:
    """What the subject sets of a permission say of asked pairs."""
    asked = asked.select(F.col("rid").cast("string").alias("rid"), F.lit("user").alias("stype"), F.lit("...").alias("srel"), F.col("sid").cast("string").alias("sid"))
    view = Planner(_algebra_schema(), _algebra_rows(spark, d, *names)).view(type_, permission)
    return sets.granted(view, asked).select("rid", "sid", k3.verdict(F.coalesce("k", k3.of(F.lit(0)))).alias("verdict"))


def _verdict_sql(state: str) -> str:
    return f"SELECT CAST(rid AS VARCHAR) AS rid, CAST(sid AS VARCHAR) AS sid, CASE {state} WHEN 2 THEN 'member' WHEN 1 THEN 'caveated' ELSE 'notMember' END AS verdict"


def _algebra(state: str) -> str:
    for r in STATE:
        state = state.replace("{" + r + "}", STATE[r])
    return f"WITH {DEALS} {_verdict_sql('st')} FROM (SELECT s AS rid, c AS sid, {state} AS st FROM deals) x"


def _all_deals(spark, d) -> DataFrame:
    return _deals(spark, d).select(F.col("s").alias("rid"), F.col("c").alias("sid"))


@query(_algebra("greatest({left}, {right})"))
def wild_union(spark, d):
    """Public wildcards on both sides, with conditions."""
    return _verdicts(spark, d, "doc", "either", _all_deals(spark, d), "left", "right")


@query(_algebra("least({left}, {right})"))
def wild_intersection(spark, d):
    return _verdicts(spark, d, "doc", "both", _all_deals(spark, d), "left", "right")


@query(_algebra("least({left}, 2 - {right})"))
def wild_exclusion(spark, d):
    """A wildcard less a wildcard."""
    return _verdicts(spark, d, "doc", "rest", _all_deals(spark, d), "left", "right")


@query(_algebra("least({plain}, 2 - {left})"))
def listed_less_wild(spark, d):
    return _verdicts(spark, d, "doc", "listed_rest", _all_deals(spark, d), "left", "plain")


@query(_algebra("least({plain}, {left})"))
def listed_and_wild(spark, d):
    return _verdicts(spark, d, "doc", "listed_both", _all_deals(spark, d), "left", "plain")


@query(_algebra("least({left}, 2 - {plain})"))
def wild_less_listed(spark, d):
    return _verdicts(spark, d, "doc", "open_rest", _all_deals(spark, d), "left", "plain")


@query(_algebra("greatest({left}, {plain})"))
def wild_or_listed(spark, d):
    """A wildcard weakened by listed subjects, and the other way round."""
    return _verdicts(spark, d, "doc", "listed_either", _all_deals(spark, d), "left", "plain")


@query(_algebra("least(greatest({left}, {plain}), 2 - least({right}, {left}))"))
def nested_algebra(spark, d):
    return _verdicts(spark, d, "doc", "nested", _all_deals(spark, d), "left", "right", "plain")


def _hubs(how: str) -> str:
    own = f"greatest(CASE WHEN p.s IS NULL THEN 0 ELSE coalesce({DIRECT['left']}, 0) END, coalesce({OPEN['left']}, 0))"
    inner = f"SELECT a.n AS rid, a.c AS sid, t.s_suppkey AS s, a.c AS c, p.s IS NULL AS apart FROM asked a JOIN supplier t ON t.s_nationkey = a.n LEFT JOIN deals p ON p.s = t.s_suppkey AND p.c = a.c"
    return f"WITH {DEALS}, asked AS (SELECT DISTINCT s_nationkey AS n, c FROM deals JOIN supplier ON s_suppkey = s), g AS ({inner}) {_verdict_sql('st')} FROM (SELECT rid, sid, {how}(least({HAS}, {own.replace('p.s IS NULL', 'apart')})) AS st FROM g GROUP BY rid, sid) x"


def _asked_hubs(spark, d) -> DataFrame:
    suppliers = spark.read.parquet(f"{d}/supplier.parquet")
    return _deals(spark, d).join(suppliers, F.col("s_suppkey") == F.col("s")).select(F.col("s_nationkey").alias("rid"), F.col("c").alias("sid")).distinct()


@query(_hubs("max"))
def arrow_conditional(spark, d):
    """Wildcards and conditions through an arrow that is itself conditional."""
    return _verdicts(spark, d, "hub", "any", _asked_hubs(spark, d), "left", "has")


@query(_hubs("min"))
def arrow_all_wild(spark, d):
    return _verdicts(spark, d, "hub", "every", _asked_hubs(spark, d), "left", "has")


# ---- text, pages, feed and commits


@query("SELECT CAST(o_orderkey AS VARCHAR) AS rid, epoch_us(o_orderdate) * 1000 + 123456700 AS ns FROM orders")
def expiration_parse(spark, d):
    """Times of nine digits after the point; those after the seventh are dropped."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    lines = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"), F.lit("#temp@user:"), F.col("o_custkey").cast("string"), F.lit("[expiration:"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456789Z]")).alias("value"))
    return tuples.parse(lines).select(F.col("resource_id").alias("rid"), F.col("expiration_ns").alias("ns"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS rid, '{\"min\":' || CAST(o_custkey AS VARCHAR) || ',\"note\":\"\\u003Ca\\u0026b\\u003E\",\"total\":5}' AS ctx FROM orders")
def context_canonical(spark, d):
    """Contexts in another order and with blanks come out canonical."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    lines = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"), F.lit('#payer@user:tom[min_total:{ "total": 5, "note": "<a&b>",  "min": '), F.col("o_custkey").cast("string"), F.lit("}]")).alias("value"))
    return tuples.parse(lines).select(F.col("resource_id").alias("rid"), F.col("caveat_ctx").alias("ctx"))


@query("SELECT CASE c_custkey % 4 WHEN 0 THEN 'group:' || c_custkey || '#member' WHEN 1 THEN 'group:' || c_custkey WHEN 2 THEN 'Group:' || c_custkey || '#member' ELSE 'group:a/b|' || c_custkey || '#mem_ber' END AS line, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'group' ELSE '' END AS type, CASE c_custkey % 4 WHEN 0 THEN '' || c_custkey WHEN 3 THEN 'a/b|' || c_custkey ELSE '' END AS id, CASE c_custkey % 4 WHEN 0 THEN 'member' WHEN 3 THEN 'mem_ber' ELSE '' END AS rel FROM customer")
def object_parse(spark, d):
    key = F.col("c_custkey")
    of = lambda before, after: F.concat(F.lit(before), key.cast("string"), F.lit(after))
    line = F.when(key % 4 == 0, of("group:", "#member")).when(key % 4 == 1, of("group:", "")).when(key % 4 == 2, of("Group:", "#member")).otherwise(of("group:a/b|", "#mem_ber"))
    found = tuples.objects(spark.read.parquet(f"{d}/customer.parquet").select(line.alias("line")), "line")
    return found.select("line", *(F.coalesce(c, F.lit("")).alias(c) for c in ("type", "id", "rel")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS rid FROM customer WHERE c_custkey % 6 IN (0, 5)")
def tuple_refused(spark, d):
    """Lines that the grammar refuses are left out where that is asked for."""
    key = F.col("c_custkey")
    of = lambda after: F.concat(F.lit("group:"), key.cast("string"), F.lit(after))
    line = F.when(key % 6 == 0, of("#member@user:tom")).when(key % 6 == 1, of("#me@user:tom")).when(key % 6 == 2, of("#member@user:tom[cav:{}]")).when(key % 6 == 3, of("#member@user:tom[expiration:2024-01-02T03:04:05+01:00]")).when(key % 6 == 4, of("@user:tom")).otherwise(of('#member@user:*[cav:{"a":1}]'))
    return tuples.parse(spark.read.parquet(f"{d}/customer.parquet").select(line.alias("value")), strict=False).select(F.col("resource_id").alias("rid"))


@query(w(*SOME) + f"SELECT {TAGS} AS tuple FROM rel WHERE rt = 'order' ORDER BY 1 LIMIT 100 OFFSET 100")
def cursor_page(spark, d):
    """The second page, after a cursor that belongs to the request."""
    rows, request = world.relationships(spark, d, *SOME), {"type": "order", "limit": 100}
    first = filters.read(rows, Filter(type="order"), limit=100).agg(F.max("tuple").alias("last")).first()
    place = tuples.cursor(request, [first["last"]])
    return filters.read(rows, Filter(type="order"), cursor=tuples.parse_cursor(place, request)[0], limit=100).select("tuple")


@query(w(*SOME) + f"SELECT {TAGS} AS tuple FROM rel WHERE rt = 'order'")
def limit_zero(spark, d):
    """A limit of 0 is none."""
    return filters.read(world.relationships(spark, d, *SOME), Filter(type="order"), limit=0).select("tuple")


def _log_with_schema(spark, d):
    return _log(spark, d).withColumn("schema_changed", F.col("rev") % 5000 == 0)


@query("WITH " + INTERVALS + ", " + CHANGES + " SELECT rev, op, rid, sid FROM chg WHERE rev % 5000 = 0")
def watch_content(spark, d):
    """Only what changes the schema, by the content mask."""
    found = watch.changes(_log_with_schema(spark, d), 0, content=watch.SCHEMA)
    return found.select("rev", "op", F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"))


@query("WITH " + INTERVALS + ", " + CHANGES + " SELECT DISTINCT rev FROM chg WHERE rid = '3'")
def watch_revisions(spark, d):
    """Revisions without a wanted change don't come out."""
    return watch.changes(_log(spark, d), 0, filters=(Filter(type="item", ids=("3",)),)).select("rev").distinct()


@query("WITH " + INTERVALS + ", " + CHANGES + " SELECT rev, op, rid, sid FROM chg UNION ALL SELECT max(rev), 'checkpoint', '', '' FROM chg")
def watch_stream(spark, d):
    """The feed as a stream over log files: all changes, and the last checkpoint."""
    import uuid

    from .model import CHANGELOG
    from .sources import files

    base = f"{fixpoint.shared_folder(spark)}/quillon-feed-{uuid.uuid4().hex}"
    log = _log(spark, d).withColumn("tx_metadata", F.lit(None).cast("string"))
    files.changelog(log.select(*CHANGELOG.names), f"{base}/log")

    def sink(found: DataFrame, mark: DataFrame) -> None:
        out = found.select("rev", "op", F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"))
        out.unionByName(mark.select("rev", F.lit("checkpoint").alias("op"), F.lit("").alias("rid"), F.lit("").alias("sid"))).write.mode("append").parquet(f"{base}/out")

    watch.watch(spark, f"{base}/log", f"{base}/state", sink).awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    marks = out.filter("op = 'checkpoint'").groupBy("op", "rid", "sid").agg(F.max("rev").alias("rev"))
    return out.filter("op <> 'checkpoint'").unionByName(marks.select("rev", "op", "rid", "sid"))


@query(w("owner") + "SELECT rid, sid, CAST(5 AS BIGINT) AS created_rev FROM rel")
def bulk_import_feed(spark, d):
    """An import reaches the change feed: its log folds to the imported rows."""
    s = store.Store(spark, world.SCHEMA)
    s.bulk_import(world.relationships(spark, d, "owner"), now_ns=5)
    return watch.folded(s.log).select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), "created_rev")


def _nations(spark, d, op: str) -> DataFrame:
    return world.relationships(spark, d, "region").select(F.lit(op).alias("op"), "*")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS rid, CAST(n_nationkey AS VARCHAR) AS sid, rev, op, meta AS tx_metadata FROM nation, (VALUES (CAST(10 AS BIGINT), 'touch', '{\"by\":\"tom\",\"why\":1}'), (CAST(20 AS BIGINT), 'delete', '')) v(rev, op, meta)")
def tx_metadata(spark, d):
    """Changes with the metadata of the transaction that made them."""
    s = store.Store(spark, world.SCHEMA)
    s.commit(store.Commit(updates=_nations(spark, d, "touch"), metadata={"why": 1, "by": "tom"}), 10)
    s.commit(store.Commit(delete=Filter(type="region")), 20)
    return s.log.select(F.col("resource_id").alias("rid"), F.col("subject_id").alias("sid"), "rev", "op", F.coalesce("tx_metadata", F.lit("")).alias("tx_metadata"))


def outcome(f) -> str:
    try:
        return str(f())
    except ValueError as e:
        return f"{type(e).__name__}"


COMMITS = [("create", "100"), ("create again", "Conflict"), ("touch, clock behind", "101"), ("head moved", "Conflict"), ("precondition", "Conflict"), ("orphaning schema", "Conflict"), ("unknown relation", "Conflict"), ("delete", "300"), ("head", "300")]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, COMMITS))}) v(step, result)")
def commit_order(spark, d):
    """What each step of a history of commits gives: its revision, or a refusal that changes nothing."""
    s, one = store.Store(spark, world.SCHEMA), store.Commit
    bad = _nations(spark, d, "touch").withColumn("resource_rel", F.lit("nosuch"))
    steps = {
        "create": lambda: s.commit(one(updates=_nations(spark, d, "create")), 100)[0],
        "create again": lambda: s.commit(one(updates=_nations(spark, d, "create")), 200)[0],
        "touch, clock behind": lambda: s.commit(one(updates=_nations(spark, d, "touch")), 50)[0],
        "head moved": lambda: s.commit(one(updates=_nations(spark, d, "touch"), expected_head=100), 200)[0],
        "precondition": lambda: s.commit(one(updates=_nations(spark, d, "touch"), preconditions=[("none", Filter(type="region"), False)]), 200)[0],
        "orphaning schema": lambda: s.commit(one(schema="definition user {}"), 200)[0],
        "unknown relation": lambda: s.commit(one(updates=bad), 200)[0],
        "delete": lambda: s.commit(one(delete=Filter(type="region")), 300)[0],
        "head": lambda: s.head,
    }
    return literal(spark, [(name, outcome(f)) for name, f in steps.items()], "step string, result string")


RESOLVED = [("full", "100"), ("latency", "50"), ("fresh behind", "50"), ("fresh ahead", "70"), ("exact", "30"), ("exact, collected", "Conflict"), ("exact, to come", "Conflict"), ("feed, collected", "Gone"), ("feed, both filters", "ValueError")]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, RESOLVED))}) v(step, result)")
def revision_resolve(spark, d):
    at = lambda how, **k: store.resolve(how, 100, 57, quantum_ns=10, **k)
    log = _log(spark, d)
    steps = {
        "full": lambda: at("full"), "latency": lambda: at("latency"), "fresh behind": lambda: at("fresh", at=40), "fresh ahead": lambda: at("fresh", at=70), "exact": lambda: at("exact", at=30),
        "exact, collected": lambda: at("exact", at=3, floor=5), "exact, to come": lambda: at("exact", at=101),
        "feed, collected": lambda: watch.changes(log, 5, floor=10), "feed, both filters": lambda: watch.changes(log, 5, types=("item",), filters=(Filter(),)),
    }
    return literal(spark, [(name, outcome(f)) for name, f in steps.items()], "step string, result string")


FLAT = [("group#member", True), ("nation#member", True), ("order#any", True), ("order#held", True), ("order#own", False), ("order#pay", False), ("order#read", True), ("order#rep", False), ("order#seen", False), ("order#viewer", False), ("region#member", True)]


@query(f"SELECT * FROM (VALUES {', '.join(f'({a!r}, {str(b).lower()})' for a, b in FLAT)}) v(node, flat)")
def coverage(spark, d):
    """Whether a permission is reachability over stored tuples alone."""
    return literal(spark, [(name, graph.flattens(schema(), tuple(name.split("#")))) for name, _ in FLAT], "node string, flat boolean")


@query(_row("CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE 7 END % 2 = 1", "customer", "c_custkey"))
def cel_optionals(spark, d):
    key = F.col("c_custkey")
    return _cel(spark, d, "(there ? optional.of(n) : optional.none()).orValue(7) % 2 == 1 && optional.of(n).hasValue() && !optional.none().hasValue()", "n int, there bool", "customer", {"n": key, "there": key % 3 == 0}, "c_custkey")


CAVEATS = [("holds", "True "), ("fails", "False "), ("missing", "None total"), ("missing by whole words", "None n,total"), ("stored wins", "True "), ("unknown names", "True "), ("wrong type", "CelError"), ("no boolean", "CelError"), ("error", "CelError")]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, CAVEATS))}) v(step, result)")
def caveat_outcomes(spark, d):
    """Verdicts, missing inputs and errors of caveats."""
    from .functions import cel

    def one(body: str, stored: dict, asked: dict | None = None, **params: str) -> str:
        holds, missing = cel.decide(body, params or {"n": "int", "total": "int"}, stored, asked)
        return f"{holds} {','.join(missing)}"

    steps = {
        "holds": lambda: one("n < total", {"n": 1, "total": 2}), "fails": lambda: one("n < total", {"n": 3, "total": 2}),
        "missing": lambda: one("n < total", {"n": 3}), "missing by whole words": lambda: one("n < total && nn == 1", {"nn": 1}, n="int", nn="int", total="int", tot="int"),
        "stored wins": lambda: one("n < total", {"n": 1, "total": 2}, {"n": 9}), "unknown names": lambda: one("n == 1", {"n": 1, "other": 2}, n="int"),
        "wrong type": lambda: one("n < total", {"n": "x", "total": 2}), "no boolean": lambda: one("n + total", {"n": 1, "total": 2}), "error": lambda: one("n / total == 1", {"n": 1, "total": 0}),
    }
    return literal(spark, [(name, outcome(f)) for name, f in steps.items()], "step string, result string")


GUARDED = [("closure of 3 steps, 3 allowed", "4"), ("closure of 3 steps, 2 allowed", "DepthError"), ("walk of 3 steps, 5 deep", "member"), ("walk of 3 steps, 3 deep", "DepthError")]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, GUARDED))}) v(step, result)")
def depth_guard(spark, d):
    """Work deeper than the limit raises; nothing is left out."""
    from .model import DepthError
    from .operators import strict

    chain = literal(spark, [("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = literal(spark, [("a", "a")], "start string, node string")
    groups = [(("group", x, "member", "group", y, "member"), (k3.A, frozenset())) for x, y in ("ab", "bc", "cd")] + [(("group", "d", "member", "user", "u", "..."), (k3.A, frozenset()))]
    walked = lambda depth: "member" if strict.Walk(schema(), groups, depth).check(("group", "a", "member"), ("user", "u", "...")) else "notMember"

    def guarded(f) -> str:
        try:
            return str(f())
        except DepthError:
            return "DepthError"

    steps = {
        "closure of 3 steps, 3 allowed": lambda: fixpoint.closure(chain, seeds, 3).count(), "closure of 3 steps, 2 allowed": lambda: fixpoint.closure(chain, seeds, 2).count(),
        "walk of 3 steps, 5 deep": lambda: walked(5), "walk of 3 steps, 3 deep": lambda: walked(3),
    }
    return literal(spark, [(name, guarded(f)) for name, f in steps.items()], "step string, result string")
