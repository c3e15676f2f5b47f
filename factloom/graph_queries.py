"""Queries of the relational, recursive and lexical operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from factloom.functions import names
from factloom.operators import closure, joins, lexical, scoring, snapshots, tiers
from factloom.operators.orphans import clean_id
from factloom.registry import query
from factloom.session import cut
from factloom.sources import bundle
from factloom.sources.tables import table
from factloom.streaming import events as streams

_ID = "lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)))"
_CALLS = f"""calls AS (SELECT DISTINCT {_ID.format('caller_id')} AS src, {_ID.format('callee_method_id')} AS dst, tier FROM call_edges
  WHERE callee_provenance = 'client' AND {_ID.format('caller_id')} NOT IN ('', '-') AND {_ID.format('callee_method_id')} NOT IN ('', '-'))"""


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "call_edges").where(F.col("callee_provenance") == "client")
    return rows.select(clean_id(F.col("caller_id")).alias("src"), clean_id(F.col("callee_method_id")).alias("dst"), "tier").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def _geo(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [t("customer").select(node("C:", "c_custkey").alias("src"), node("N:", "c_nationkey").alias("dst")), t("supplier").select(node("S:", "s_suppkey").alias("src"), node("N:", "s_nationkey").alias("dst")), t("nation").select(node("N:", "n_nationkey").alias("src"), node("R:", "n_regionkey").alias("dst"))]
    return closure.clean_edges(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_GEO = """geo AS (SELECT 'C:' || c_custkey AS src, 'N:' || c_nationkey AS dst FROM customer UNION SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)"""


def _next_part(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    a, b = lines.alias("a"), lines.alias("b")
    hit = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
    return closure.clean_edges(a.join(b, hit).select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")))


_NEXT = """lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
 e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_DEPTH = 4
_WALK_TO = """walk AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT e.dst, w.hops + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.hops < {0}),
 dist AS (SELECT node, min(hops) AS hops FROM walk GROUP BY node)"""
_WALK, _PATH = _WALK_TO.format(_DEPTH), _WALK_TO.format(closure.MAX_DEPTH)


def _seed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").where("p_partkey = 1").select(F.lit("a").alias("query"), F.col("p_partkey").alias("node"))


# projections, filters, set operations


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS owner FROM nation")
def project_rename(spark, folder):
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("owner"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def const_filter(spark, folder):
    return table(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT file_path, start_line, start_column FROM js_method WHERE start_line > 20 OR (start_line = 20 AND start_column >= 2)")
def lexicographic_order(spark, folder):
    at = F.struct("start_line", "start_column")
    return table(spark, folder, "js_method").where(at >= F.struct(F.lit(20), F.lit(2))).select("file_path", "start_line", "start_column")


@query("SELECT id, nullif(nullif(owner_type_id, '-'), '') AS owner, nullif(nullif(access, '-'), '') AS access FROM methods")
def sentinel_nulls(spark, folder):
    return table(spark, folder, "methods").select("id", bundle.sentinel(F.col("owner_type_id")).alias("owner"), bundle.sentinel(F.col("access")).alias("access"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_set(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, folder, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_all_cols(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, folder, "supplier").select("s_nationkey"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_unresolved(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query(f"SELECT l.id, l.qualified_name FROM lib_methods l WHERE EXISTS (SELECT 1 FROM call_edges c WHERE c.callee_provenance = 'lib' AND {_ID.format('c.callee_method_id')} = {_ID.format('l.id')})")
def semi_demand(spark, folder):
    """Only the library rows that a call names."""
    named = table(spark, folder, "call_edges").where("callee_provenance = 'lib'").select(clean_id(F.col("callee_method_id")).alias("k")).distinct()
    return table(spark, folder, "lib_methods").withColumn("k", clean_id(F.col("id"))).join(named, "k", "left_semi").select("id", "qualified_name")


@query("SELECT DISTINCT * EXCLUDE (loaded_at) FROM js_comment")
def distinct_rows(spark, folder):
    return table(spark, folder, "js_comment").drop("loaded_at").distinct()


# aggregates


@query("SELECT o_orderkey, count(DISTINCT l_partkey) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def count_zero_groups(spark, folder):
    """Counts per order, orders without lines with 0."""
    counts = joins.fan(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey").withColumnsRenamed({"l_orderkey": "o_orderkey", "fan": "parts"})
    return table(spark, folder, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("parts", F.lit(0)).alias("parts"))


_CLASS = """classified AS (SELECT o_orderkey, count(DISTINCT l_suppkey) AS targets FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


@query(f"WITH {_CLASS} SELECT o_orderkey, targets, CASE WHEN targets = 0 THEN 'unresolved' WHEN targets = 1 THEN 'known_edge' ELSE 'multi_inferred' END AS tier FROM classified")
def classify_tiers(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return tiers.classify(table(spark, folder, "orders"), lines, "o_orderkey", "l_suppkey")


@query("SELECT o_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_suppkey FROM lineitem) UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def conserve_sites(spark, folder):
    resolved = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    return tiers.conserve(table(spark, folder, "orders"), resolved, "o_orderkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS fan FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 20")
def fan_capped(spark, folder):
    return joins.fan(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey").where("fan > 20")


@query("WITH f AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 20) SELECT DISTINCT l_partkey, l_suppkey FROM lineitem SEMI JOIN f USING (l_partkey)")
def key_join_capped(spark, folder):
    """Links by key, for keys that few share."""
    return joins.capped(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", 20).distinct()


@query("SELECT coalesce(tier, '') AS tier, kind, count(*) AS edges, count(DISTINCT edge_id) AS different FROM call_edges GROUP BY ALL")
def tier_histogram(spark, folder):
    return table(spark, folder, "call_edges").groupBy(F.coalesce("tier", F.lit("")).alias("tier"), "kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("edge_id").alias("different"))


@query("SELECT count(DISTINCT CASE WHEN kind = 'constructor' THEN caller_id END) AS constructing, count(DISTINCT CASE WHEN callee_provenance = 'lib' THEN callee_method_id END) AS library FROM call_edges")
def count_distinct_when(spark, folder):
    when = lambda c, v, x: F.countDistinct(F.when(F.col(c) == v, F.col(x)))
    return table(spark, folder, "call_edges").agg(when("kind", "constructor", "caller_id").alias("constructing"), when("callee_provenance", "lib", "callee_method_id").alias("library"))


@query("SELECT l_suppkey, sum(l_quantity) AS quantity FROM (SELECT DISTINCT l_suppkey, l_partkey, l_quantity FROM lineitem) GROUP BY 1")
def sum_distinct_bindings(spark, folder):
    return table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").distinct().groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier QUALIFY rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) = 1")
def min_join_back(spark, folder):
    return joins.nearest(table(spark, folder, "supplier"), ["s_nationkey"], [F.asc("s_acctbal")]).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS earlier FROM orders")
def count_as_rank(spark, folder):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", (F.dense_rank().over(w) - 1).cast("bigint").alias("earlier"))


@query("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def next_occurrence(spark, folder):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("event_id", "user_id", F.lead("event_id").over(w).alias("next_event"))


# joins

_SPANS = "SELECT DISTINCT id, regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '') AS f, start_line AS a, end_line AS b FROM {0} WHERE file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL"


def _spans(spark, folder, name):
    path = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return table(spark, folder, name).select("id", path.alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b")).where("f IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").distinct()


@query(f"WITH t AS ({_SPANS.format('types')}), m AS ({_SPANS.format('methods')}) SELECT m.id AS method, t.id AS type FROM m JOIN t ON m.f = t.f AND m.a >= t.a AND m.a <= t.b")
def range_join(spark, folder):
    """Types around each method's first line."""
    t, m = _spans(spark, folder, "types"), _spans(spark, folder, "methods")
    return joins.contain(t.withColumnsRenamed({"id": "type", "a": "ta", "b": "tb"}), m.withColumnRenamed("id", "method").drop("b"), "f", "ta", "tb", "a", 128).select("method", "type")


@query(f"""WITH t AS ({_SPANS.format('types')}), m AS ({_SPANS.format('methods')}), h AS (SELECT m.id AS method, m.f, m.a, t.id AS type, t.a AS ta, t.b AS tb FROM m JOIN t ON m.f = t.f AND m.a >= t.a AND m.a <= t.b)
 SELECT method, type FROM h QUALIFY rank() OVER (PARTITION BY method, f, a ORDER BY ta DESC, tb) = 1""")
def innermost_interval(spark, folder):
    """The innermost type around each method."""
    t, m = _spans(spark, folder, "types"), _spans(spark, folder, "methods")
    hit = joins.contain(t.withColumnsRenamed({"id": "type", "a": "ta", "b": "tb"}), m.withColumnRenamed("id", "method").drop("b"), "f", "ta", "tb", "a", 128)
    return joins.nearest(hit, ["method", "f", "a"], [F.desc("ta"), F.asc("tb")]).select("method", "type")


@query("WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size < 10) SELECT p_partkey, p_name, max_by(prefix, length(prefix)) AS prefix FROM part JOIN p ON starts_with(p_name, prefix) GROUP BY 1, 2")
def max_prefix(spark, folder):
    part = table(spark, folder, "part")
    prefixes = part.select(F.split("p_name", " ")[0].alias("prefix")).union(part.where("p_size < 10").select("p_name"))
    return joins.longest_prefix(part.select("p_partkey", "p_name"), "p_name", prefixes, "prefix")


@query("WITH need AS (SELECT DISTINCT o_orderstatus FROM orders) SELECT o_custkey FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM need)")
def division(spark, folder):
    """Customers with orders of every status."""
    orders = table(spark, folder, "orders")
    return joins.divide(orders, "o_custkey", "o_orderstatus", orders)


@query("SELECT s.s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier d WHERE d.s_nationkey = s.s_nationkey AND d.s_acctbal >= s.s_acctbal AND d.s_suppkey <= s.s_suppkey AND (d.s_acctbal > s.s_acctbal OR d.s_suppkey < s.s_suppkey))")
def dominance(spark, folder):
    """Suppliers that none of their nation beats: best balance among those up to each key."""
    best = F.max("s_acctbal").over(W.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(W.unboundedPreceding, -1))
    return table(spark, folder, "supplier").withColumn("best", best).where("best IS NULL OR best < s_acctbal").select("s_suppkey")


@query("""WITH s AS (SELECT DISTINCT regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '') AS f FROM js_module), d AS (SELECT doc_id, file_path FROM documents WHERE file_path IS NOT NULL),
 k AS (SELECT doc_id, file_path, split_part(file_path, '/', -1) AS n FROM d) SELECT k.doc_id, s.f AS module FROM k JOIN s ON split_part(s.f, '/', -1) = k.n AND ends_with(s.f, k.n)""")
def suffix_join(spark, folder):
    """Modules whose path ends in a document's file name, by the name as a derived key."""
    s = table(spark, folder, "js_module").select(F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("module")).distinct()
    d = table(spark, folder, "documents").where("file_path IS NOT NULL").select("doc_id", names.last_segment(F.col("file_path"), "/").alias("n"))
    return d.join(s.withColumn("n", names.last_segment(F.col("module"), "/")), "n").where(F.col("module").endswith(F.col("n"))).select("doc_id", "module")


_SEG = "list_transform(list_filter(string_split({0}, '/'), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, ':') OR contains(s, '{{') OR s = '*' THEN '*' ELSE s END)"
_ROUTES = f"""w AS (SELECT DISTINCT '/' || event_type || '/' || user_id AS route FROM events), r AS (SELECT DISTINCT '/' || event_type || '/:user' AS template FROM events UNION SELECT DISTINCT '/' || event_type || '/' || user_id FROM events WHERE value > 100),
 ws AS (SELECT route, {_SEG.format('route')} AS a FROM w), rs AS (SELECT template, {_SEG.format('template')} AS b FROM r),
 p AS (SELECT route, template, list_sum(list_transform(list_zip(a, b), lambda x: CASE WHEN x[1] = x[2] AND x[1] <> '*' THEN 1 ELSE 0 END)) AS same, list_bool_and(list_transform(list_zip(a, b), lambda x: x[1] = x[2] OR x[1] = '*' OR x[2] = '*')) AS fits FROM ws JOIN rs ON len(a) = len(b) AND a[1] = b[1])"""


@query(f"WITH {_ROUTES} SELECT route, template, CAST(same AS INTEGER) AS same FROM p WHERE fits AND same > 0 QUALIFY rank() OVER (PARTITION BY route ORDER BY same DESC) = 1")
def route_match(spark, folder):
    """Routes written against templates registered; the more literal template wins."""
    e = table(spark, folder, "events")
    route = F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    registered = e.select(F.concat(F.lit("/"), "event_type", F.lit("/:user")).alias("template")).union(e.where("value > 100").select(route))
    return joins.match_routes(e.select(route.alias("route")), registered)


# recursion


@query(f"WITH RECURSIVE {_GEO}, c AS (SELECT src, dst FROM geo UNION SELECT c.src, g.dst FROM c JOIN geo g ON g.src = c.dst) SELECT src, dst FROM c")
def closure_hierarchy(spark, folder):
    return closure.transitive_closure(_geo(spark, folder))


@query(f"WITH RECURSIVE {_NEXT}, r AS (SELECT 1::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def closure_cyclic(spark, folder):
    return closure.bfs(_next_part(spark, folder), _seed(spark, folder)).select("node")


@query(f"WITH RECURSIVE {_NEXT}, {_WALK} SELECT node, hops FROM dist")
def bfs_hops(spark, folder):
    return closure.bfs(_next_part(spark, folder), _seed(spark, folder), _DEPTH).select("node", "hops")


@query(f"WITH RECURSIVE {_NEXT}, {_WALK} SELECT b.node AS node, a.node AS parent, b.hops FROM dist b JOIN e ON e.dst = b.node JOIN dist a ON a.node = e.src AND a.hops = b.hops - 1")
def bfs_parents(spark, folder):
    edges = _next_part(spark, folder)
    return closure.parents(closure.bfs(edges, _seed(spark, folder), _DEPTH), edges).select("node", "parent", "hops")


@query(f"""WITH RECURSIVE {_NEXT}, f AS (SELECT 1::BIGINT AS node, 0 AS h UNION SELECT e.dst, h + 1 FROM f JOIN e ON e.src = f.node WHERE h < 2), g AS (SELECT 2::BIGINT AS node, 0 AS h UNION SELECT e.src, h + 1 FROM g JOIN e ON e.dst = g.node WHERE h < 2)
 SELECT src, dst FROM e WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM g)""")
def between_edges(spark, folder):
    target = table(spark, folder, "part").where("p_partkey = 2").select(F.lit("a").alias("query"), F.col("p_partkey").alias("node"))
    return closure.between(_next_part(spark, folder), _seed(spark, folder), target, 2)


@query(f"""WITH RECURSIVE {_NEXT}, n AS (SELECT src, dst FROM e UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey),
 s AS (SELECT 1::BIGINT AS node, 0 AS h UNION SELECT e.dst, h + 1 FROM s JOIN e ON e.src = s.node WHERE h < 1), o AS (SELECT 1::BIGINT AS node, 0 AS h UNION SELECT n.dst, h + 1 FROM o JOIN n ON n.src = o.node WHERE h < 1)
 SELECT DISTINCT node FROM o WHERE node NOT IN (SELECT node FROM s)""")
def optimistic_bridge(spark, folder):
    """What only links by name reach."""
    return _bridge(spark, folder, 1)


def _bridge(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    edges, seed = _next_part(spark, folder), _seed(spark, folder)
    named = cut(table(spark, folder, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("hub")).where("node IS NOT NULL AND hub IS NOT NULL").distinct(), "names")
    sound = closure.bfs(edges, seed, depth)
    return closure.bfs(edges, seed, depth, named).join(sound.select("node"), "node", "left_anti").select("node").distinct()


# the same walks over the whole of the reference's depth


@query(f"WITH RECURSIVE {_NEXT}, {_PATH} SELECT node, hops FROM dist")
def path_hops(spark, folder):
    return closure.bfs(_next_part(spark, folder), _seed(spark, folder), closure.MAX_DEPTH).select("node", "hops")


@query(f"WITH RECURSIVE {_NEXT}, {_PATH} SELECT b.node AS node, a.node AS parent, b.hops FROM dist b JOIN e ON e.dst = b.node JOIN dist a ON a.node = e.src AND a.hops = b.hops - 1")
def path_parents(spark, folder):
    edges = _next_part(spark, folder)
    return closure.parents(closure.bfs(edges, _seed(spark, folder), closure.MAX_DEPTH), edges).select("node", "parent", "hops")


@query(f"""WITH RECURSIVE {_NEXT}, f AS (SELECT 1::BIGINT AS node, 0 AS h UNION SELECT e.dst, h + 1 FROM f JOIN e ON e.src = f.node WHERE h < {closure.MAX_DEPTH}), g AS (SELECT 2::BIGINT AS node, 0 AS h UNION SELECT e.src, h + 1 FROM g JOIN e ON e.dst = g.node WHERE h < {closure.MAX_DEPTH})
 SELECT src, dst FROM e WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM g)""")
def path_between(spark, folder):
    target = table(spark, folder, "part").where("p_partkey = 2").select(F.lit("a").alias("query"), F.col("p_partkey").alias("node"))
    return closure.between(_next_part(spark, folder), _seed(spark, folder), target, closure.MAX_DEPTH)


@query()
def path_bridge(spark, folder):
    """What only links by name reach, at any hop; all pairs of a name are too many for SQL, a fixture holds it."""
    return _bridge(spark, folder, closure.MAX_DEPTH)


_RANK_SQL = "CASE " + " ".join(f"WHEN tier IN ({', '.join(repr(t) for t in v.split())}) THEN {k}" for k, v in tiers.RANKS.items()) + f" ELSE {tiers.UNLISTED} END"
_ENTRY = "methods m WHERE m.access = 'public' AND m.name LIKE 'visit%'"


@query(f"""WITH RECURSIVE {_CALLS}, e AS (SELECT DISTINCT src, dst FROM calls), s AS (SELECT DISTINCT {_ID.format('m.id')} AS node FROM {_ENTRY}),
 r AS (SELECT node FROM s UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def entry_reachable(spark, folder):
    """Methods reached from the entry points."""
    seeds = table(spark, folder, "methods").where("access = 'public' AND name LIKE 'visit%'").select(F.lit("entry").alias("query"), clean_id(F.col("id")).alias("node"))
    return closure.bfs(closure.clean_edges(_calls(spark, folder)), seeds).select("node")


@query(f"""WITH RECURSIVE {_CALLS}, e AS (SELECT src, dst, min({_RANK_SQL}) AS rank FROM calls GROUP BY 1, 2), s AS (SELECT DISTINCT {_ID.format('m.id')} AS node FROM {_ENTRY}),
 r AS (SELECT node, -1 AS worst FROM s UNION SELECT e.dst, greatest(r.worst, e.rank) FROM r JOIN e ON e.src = r.node) SELECT node, min(worst) AS worst FROM r GROUP BY node""")
def bottleneck_rung(spark, folder):
    """How surely each method is reached: the worst rank on its best route."""
    edges = _calls(spark, folder).groupBy("src", "dst").agg(F.min(tiers.rank(F.col("tier"))).alias("rank"))
    seeds = table(spark, folder, "methods").where("access = 'public' AND name LIKE 'visit%'").select(F.lit("entry").alias("query"), clean_id(F.col("id")).alias("node"))
    return closure.bottleneck(closure.clean_edges(edges, "src", "dst", "rank"), seeds).select("node", "worst")


@query(f"WITH {_CALLS} SELECT m.id, count(DISTINCT c.src) AS callers, min({_RANK_SQL}) AS surest FROM (SELECT DISTINCT id FROM methods) m JOIN calls c ON c.dst = {_ID.format('m.id')} GROUP BY 1")
def impact_direct(spark, folder):
    """Direct callers of each method and how surely it is called."""
    calls = _calls(spark, folder).groupBy("dst").agg(F.countDistinct("src").alias("callers"), F.min(tiers.rank(F.col("tier"))).alias("surest"))
    return table(spark, folder, "methods").select("id").distinct().withColumn("dst", clean_id(F.col("id"))).join(calls, "dst").select("id", "callers", "surest")


@query("""WITH m AS (SELECT DISTINCT id, name, owner_qualified_name AS o FROM methods WHERE owner_qualified_name IS NOT NULL), n AS (SELECT name, count(DISTINCT o) AS owners FROM m GROUP BY 1)
 SELECT m.id, n.owners, CASE WHEN n.owners = 1 THEN 'known_edge' WHEN n.owners <= 4 THEN 'dispatch' ELSE 'fan_capped' END AS tier FROM m JOIN n USING (name)""")
def dispatch_by_name(spark, folder):
    """Candidates of a call by name: few owners are a dispatch, many are capped."""
    m = table(spark, folder, "methods").where("owner_qualified_name IS NOT NULL").select("id", "name", F.col("owner_qualified_name").alias("o")).distinct()
    fan = joins.fan(m, "name", "o").withColumnRenamed("fan", "owners")
    return m.join(fan, "name").select("id", "owners", F.when(F.col("owners") == 1, "known_edge").when(F.col("owners") <= 4, "dispatch").otherwise("fan_capped").alias("tier"))


@query(f"SELECT call_site_id, bool_or(starts_with(tier, 'ambiguous_')) AS ambiguous, min({_RANK_SQL}) AS surest, count(DISTINCT edge_id) AS edges FROM call_edges WHERE call_site_id IS NOT NULL GROUP BY 1")
def unresolved_sites(spark, folder):
    """Sites with an ambiguous edge count as unresolved."""
    rows = table(spark, folder, "call_edges").where("call_site_id IS NOT NULL").groupBy("call_site_id")
    return rows.agg(F.bool_or(F.col("tier").startswith("ambiguous_")).alias("ambiguous"), F.min(tiers.rank(F.col("tier"))).alias("surest"), F.countDistinct("edge_id").alias("edges"))


@query("""WITH g AS (SELECT DISTINCT regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '') AS f, gap_kind FROM js_parse_gap), m AS (SELECT DISTINCT regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '') AS f FROM js_module)
 SELECT m.f AS file_path, g.gap_kind FROM m JOIN g USING (f) UNION ALL SELECT f, 'none' FROM m WHERE f NOT IN (SELECT f FROM g)""")
def parse_gaps(spark, folder):
    """Gaps of each module, with ``none`` for a module without."""
    path = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("file_path")
    m, g = table(spark, folder, "js_module").select(path).distinct(), table(spark, folder, "js_parse_gap").select(path, "gap_kind").distinct()
    return m.join(g, "file_path", "left").select("file_path", F.coalesce("gap_kind", F.lit("none")).alias("gap_kind"))


# sorting, text, scores


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 25")
def topk_ranked(spark, folder):
    return table(spark, folder, "documents").where("n_chars IS NOT NULL").orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 50 AS page, count(*) OVER () AS total FROM documents WHERE n_chars IS NOT NULL")
def result_pages(spark, folder):
    """Pages of a ranked answer with the count of the whole."""
    rows = table(spark, folder, "documents").where("n_chars IS NOT NULL").select("doc_id", "n_chars")
    return bundle.page(rows, [F.desc("n_chars"), F.asc("doc_id")], 50).select("doc_id", "n_chars", "page", "total")


@query("SELECT DISTINCT name, lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '[_ ]+', '-', 'g')) AS kebab FROM methods WHERE name IS NOT NULL")
def kebab_names(spark, folder):
    return table(spark, folder, "methods").where("name IS NOT NULL").select("name", names.kebab(F.col("name")).alias("kebab")).distinct()


@query("SELECT DISTINCT qualified_name, split_part(qualified_name, '.', -1) AS tail FROM methods WHERE qualified_name IS NOT NULL")
def last_segment(spark, folder):
    return table(spark, folder, "methods").where("qualified_name IS NOT NULL").select("qualified_name", names.last_segment(F.col("qualified_name")).alias("tail")).distinct()


@query("SELECT event_id, '${' || event_type || '.user:' || user_id || '}' AS text, event_type || '.user' AS key FROM events")
def placeholder_extract(spark, folder):
    text = F.concat(F.lit("${"), "event_type", F.lit(".user:"), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, folder, "events").select("event_id", text.alias("text")).withColumn("key", F.explode(names.placeholder_keys(F.col("text"))))


@query("SELECT js_module_unique_hash, regexp_replace(governing_package_json_path, '/[^/]*$', '') AS folder, len(string_split(governing_package_json_path, '/')) AS segments FROM js_module WHERE governing_package_json_path IS NOT NULL")
def url_normalise(spark, folder):
    p = F.concat(F.lit("file://host"), "governing_package_json_path", F.lit("?v=1"))
    bare = names.bare_route(p)
    return table(spark, folder, "js_module").where("governing_package_json_path IS NOT NULL").select("js_module_unique_hash", F.regexp_replace(bare, "/[^/]*$", "").alias("folder"), F.size(F.split(bare, "/")).cast("bigint").alias("segments"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_key_read(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_TOK = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM documents"


@query(f"SELECT token, count(*) AS docs FROM ({_TOK}) GROUP BY 1")
def token_index(spark, folder):
    return lexical.token_index(table(spark, folder, "documents"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT token, count(*) AS docs, round(ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))), 6) AS idf FROM ({_TOK}) GROUP BY 1")
def idf_terms(spark, folder):
    docs = table(spark, folder, "documents")
    return lexical.idf(lexical.token_index(docs, "doc_id", "text"), docs.agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT DISTINCT name, file_path, CASE WHEN lower(name) = 'visit' THEN 1000.0 WHEN starts_with(lower(name), 'visit') THEN round(100.0 * 5.0 / greatest(length(name), 1), 6)
 WHEN list_contains(regexp_split_to_array(lower(file_path), '[^a-z0-9]+'), 'visit') THEN 60.0 WHEN contains(lower(name), 'visit') THEN 1.0 ELSE 0.0 END AS score FROM methods WHERE name IS NOT NULL AND file_path IS NOT NULL""")
def lexical_score(spark, folder):
    rows = table(spark, folder, "methods").where("name IS NOT NULL AND file_path IS NOT NULL").select("name", "file_path").distinct()
    return rows.withColumn("score", lexical.field_score(F.col("name"), F.col("file_path"), "visit"))


_LIVE = "SELECT DISTINCT id, start_line, end_line, access FROM types WHERE loaded_at <= TIMESTAMP '{0}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{0}')"
_THEN, _NOW = "2025-06-01 00:00:00", "2025-12-01 00:00:00"


@query(f"""WITH o AS ({_LIVE.format(_THEN)}), n AS ({_LIVE.format(_NOW)}), d AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
 concat_ws(',', CASE WHEN o.start_line IS DISTINCT FROM n.start_line THEN 'start_line' END, CASE WHEN o.end_line IS DISTINCT FROM n.end_line THEN 'end_line' END, CASE WHEN o.access IS DISTINCT FROM n.access THEN 'access' END) AS changed FROM o FULL JOIN n ON o.id = n.id)
 SELECT id, change, changed FROM d WHERE change <> 'changed' OR changed <> ''""")
def snapshot_diff(spark, folder):
    """What changed in the types between two moments, from the versions live at each."""

    def live(at: str) -> DataFrame:
        moment = F.lit(at).cast("timestamp")
        rows = table(spark, folder, "types").where((F.col("loaded_at") <= moment) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > moment)))
        return rows.select("id", "start_line", "end_line", "access").distinct()

    return snapshots.diff(live(_THEN), live(_NOW), "id", ["start_line", "end_line", "access"])


@query("SELECT count(*) AS lost FROM orders WHERE o_orderkey NOT IN (SELECT DISTINCT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def coverage_guard(spark, folder):
    """Sites that classification lost: none."""
    return table(spark, folder, "orders").select("o_orderkey").join(classify_tiers(spark, folder), "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("lost"))


@query("""WITH l AS (SELECT l_returnflag = 'R' AS p, l_quantity > 25 AS a FROM lineitem), c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM l)
 SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def contingency(spark, folder):
    lines = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").alias("p"), (F.col("l_quantity") > 25).alias("a"))
    return scoring.contingency(lines, "p", "a")


@query("SELECT table_name, column_name, value FROM (SELECT DISTINCT 'call_edges' AS table_name, 'kind' AS column_name, kind AS value FROM call_edges UNION SELECT DISTINCT 'call_edges', 'tier', tier FROM call_edges UNION SELECT DISTINCT 'methods', 'kind', kind FROM methods) WHERE value IS NOT NULL AND value NOT IN ('call', 'constructor')")
def catalog_vocabulary(spark, folder):
    """Values observed but not in the authored vocabulary."""
    authored = spark.createDataFrame([("call_edges", "kind", "call"), ("call_edges", "kind", "constructor")], "table_name string, column_name string, value string")
    return bundle.vocabulary({"call_edges": table(spark, folder, "call_edges").select("kind", "tier"), "methods": table(spark, folder, "methods").select("kind")}, authored)


@query("SELECT id, name, 'library' AS language, package_name FROM lib_methods UNION ALL SELECT DISTINCT id, name, 'client', NULL FROM methods")
def multi_graph_scan(spark, folder):
    return bundle.merge_graphs({"library": table(spark, folder, "lib_methods").select("id", "name", "package_name"), "client": table(spark, folder, "methods").select("id", "name").distinct()}).select("id", "name", "language", "package_name")


@query("SELECT CAST(id AS VARCHAR) AS c0, CAST(loaded_at AS DATE)::VARCHAR AS c1 FROM types")
def positional_export(spark, folder):
    return bundle.positional(table(spark, folder, "types").select("id", F.to_date("loaded_at")))


# windows over events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def events_by_window(spark, folder):
    return streams.tumbling(table(spark, folder, "events"), "ts", "1 hour", ["event_type"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT min(ts) AS session_start, user_id, count(*) AS events FROM s GROUP BY user_id, n""")
def event_sessions(spark, folder):
    return streams.sessions(table(spark, folder, "events"), "ts", "30 minutes", ["user_id"])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Who depends on the suppliers of region 0, at how many hops and how surely."""
    t = lambda n: table(spark, folder, n)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    part = lines.select(node("P:", "l_partkey").alias("site"), node("S:", "l_suppkey").alias("target")).distinct()
    order = lines.select(node("O:", "l_orderkey").alias("site"), node("P:", "l_partkey").alias("target")).distinct()
    owner = t("orders").select(node("C:", "o_custkey").alias("site"), node("O:", "o_orderkey").alias("target"))
    links = part.unionByName(order).unionByName(owner)
    classed = tiers.classify(links, links, "site", "target").select("site", tiers.rank(F.col("tier")).alias("rank"))
    edges = closure.clean_edges(links.join(classed, "site"), "target", "site", "rank")
    seeds = t("supplier").join(t("nation").where("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("region 0").alias("query"), node("S:", "s_suppkey").alias("node"))
    sure = closure.bottleneck(edges, seeds)
    return closure.bfs(edges, seeds, 6).join(sure, ["query", "node"]).select("query", "node", "hops", "worst")
