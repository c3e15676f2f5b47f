"""Queries of the verbs over a graph, of members and overloads, of changes and of joins by key and content, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import names
from factloom.graph_queries import _CALLS, _ID, _NEXT, _RANK_SQL, _calls, _next_part
from factloom.operators import changes, closure, joins, members, tiers, verbs
from factloom.operators.orphans import clean_id
from factloom.registry import query
from factloom.session import cut
from factloom.sources.tables import table

_PATH = "regexp_replace(replace({0}, chr(92), '/'), '^(\\./)+', '')"
_AIM = "p_size >= 45 AND p_name = 'red widget'"


def _parts(spark: SparkSession, folder: str, where: str, label=None) -> DataFrame:
    label = F.concat(F.lit("from "), F.col("p_partkey").cast("string")) if label is None else label
    return table(spark, folder, "part").where(where).select(label.alias("query"), F.col("p_partkey").alias("node"))


_WALKS = f"""s AS (SELECT 'from ' || p_partkey AS query, p_partkey AS node, 0 AS hops FROM part WHERE p_partkey IN (1, 2)),
 walk AS (SELECT * FROM s UNION SELECT w.query, e.dst, w.hops + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.hops < {closure.MAX_DEPTH}), dist AS (SELECT query, node, min(hops) AS hops FROM walk GROUP BY ALL),
 near AS (SELECT b.query, b.node, min(a.node) AS parent FROM dist b JOIN e ON e.dst = b.node JOIN dist a ON a.query = b.query AND a.node = e.src AND a.hops = b.hops - 1 GROUP BY ALL),
 chain AS (SELECT d.query, d.node AS target, d.hops AS step, d.node FROM dist d JOIN part ON p_partkey = d.node WHERE {_AIM} UNION ALL SELECT c.query, c.target, c.step - 1, n.parent FROM chain c JOIN near n ON n.query = c.query AND n.node = c.node WHERE c.step > 0)"""


@query(f"WITH RECURSIVE {_NEXT}, {_WALKS} SELECT query, target, step, node FROM chain")
def path_chains(spark, folder):
    """A shortest chain from each of two parts to each part that is aimed at, read back node by node."""
    edges = _next_part(spark, folder)
    levels = closure.bfs(edges, _parts(spark, folder, "p_partkey IN (1, 2)"), closure.MAX_DEPTH)
    return verbs.chains(levels, edges, _aims(spark, folder))


def _aims(spark: SparkSession, folder: str) -> DataFrame:
    starts = spark.createDataFrame([("from 1",), ("from 2",)], "query string")
    return _parts(spark, folder, _AIM).select("node").crossJoin(F.broadcast(starts))  # two stated starts


@query(f"""WITH RECURSIVE {_NEXT}, {_WALKS}, back AS (SELECT p_partkey AS target, p_partkey AS node, 0 AS hops FROM part WHERE {_AIM} UNION SELECT b.target, e.src, b.hops + 1 FROM back b JOIN e ON e.dst = b.node WHERE b.hops < {closure.MAX_DEPTH})
 SELECT d.query, d.node AS target, d.hops AS length, (SELECT min(b.hops) FROM back b JOIN s ON s.node = b.node WHERE b.target = d.node AND s.query = d.query) AS backwards, true AS verified FROM dist d JOIN part ON p_partkey = d.node WHERE {_AIM} AND d.hops > 0""")
def path_verified(spark, folder):
    """The length of each chain as found, the length that a second walk from the target gives, and whether hops and lengths bear each other out."""
    edges, aims = _next_part(spark, folder), _aims(spark, folder)
    levels = closure.bfs(edges, _parts(spark, folder, "p_partkey IN (1, 2)"), closure.MAX_DEPTH)
    hops = cut(verbs.hops_of_chains(verbs.chains(levels, edges, aims), edges.withColumn("rank", F.lit(0))), "hops")
    back = verbs.walk_back(levels, edges, aims)
    ends = hops.groupBy("query", "target").agg(F.max("step").alias("length"), F.min_by("src", "step").alias("start"))
    other = back.select(F.col("query").alias("target"), F.col("node").alias("start"), F.col("hops").alias("backwards"))
    leapt = hops.join(closure.leaps(levels, edges, closure.MAX_DEPTH), "query", "left_semi").select("query", "target")
    wrong = verbs.unverified(hops, levels, back, edges).unionByName(leapt).distinct().withColumn("verified", F.lit(False))
    rows = ends.join(other, ["target", "start"], "left").join(wrong, ["query", "target"], "left")
    return rows.select("query", "target", "length", "backwards", F.coalesce("verified", F.lit(True)).alias("verified"))


_RANKED = f"e AS (SELECT src, dst, min({_RANK_SQL}) AS rank FROM calls GROUP BY 1, 2)"
_TOOLS = f"SELECT DISTINCT {_ID.format('id')} AS node FROM methods WHERE contains({_PATH.format('file_path')}, '/tools/') AND {_ID.format('id')} NOT IN ('', '-')"


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    edges = _calls(spark, folder).groupBy("src", "dst").agg(F.min(tiers.rank(F.col("tier"))).alias("rank"))
    return closure.clean_edges(edges, "src", "dst", "rank")


def _tools(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "methods").where(names.slashed(F.col("file_path")).contains("/tools/")).select(clean_id(F.col("id")).alias("node")).where("node IS NOT NULL").distinct()


@query(f"""WITH RECURSIVE {_CALLS}, {_RANKED}, s AS (SELECT DISTINCT name AS query, {_ID.format('id')} AS node FROM methods WHERE name IN ('visitBucket', 'foldEnvelope')), walk AS (SELECT query, node, 0 AS hops FROM s UNION SELECT w.query, e.src, w.hops + 1 FROM walk w JOIN e ON e.dst = w.node WHERE w.hops < 60),
 d AS (SELECT query, node, min(hops) AS hops FROM walk GROUP BY ALL), r AS (SELECT query, node, -1 AS worst FROM s UNION SELECT r.query, e.src, greatest(r.worst, e.rank) FROM r JOIN e ON e.dst = r.node), w AS (SELECT query, node, min(worst) AS worst FROM r GROUP BY ALL),
 j AS (SELECT d.query, d.node, d.hops, w.worst FROM d JOIN w USING (query, node) WHERE d.hops > 0) SELECT query, CASE WHEN hops = 1 THEN 'calls' ELSE 'reaches' END AS section, node, hops, worst FROM j UNION ALL SELECT query, 'tests', node, hops, worst FROM j WHERE node IN ({_TOOLS})""")
def impact_sections(spark, folder):
    """What depends on the methods of two names: callers, all that reaches them, and which of these are tools, with the surest route's worst rank."""
    targets = table(spark, folder, "methods").where("name IN ('visitBucket', 'foldEnvelope')").select(F.col("name").alias("query"), clean_id(F.col("id")).alias("node"))
    return verbs.impact(_ranked(spark, folder), targets, _tools(spark, folder))


TASK = "Why does visiting a frozen envelope drop the orders of its nested bucket? tools/callee validators"
_TERMS = ", ".join(f"('{t}')" for t in verbs.terms_of(TASK))
_STEM = "regexp_replace({0}, '^(.{{4,}}?)(?:" + "|".join(verbs.SUFFIXES.split()) + ")$', '\\1')"
_SUB = "list_transform(list_filter(regexp_extract_all({0}, '[A-Z]+(?:[^a-zA-Z]|$)|[A-Z]?[a-z]+|[0-9]+|[A-Z]+'), lambda x: length(x) > 1), lambda x: lower(x))"


def _symbols(spark: SparkSession, folder: str) -> DataFrame:
    path = names.slashed(F.col("file_path"))
    rows = table(spark, folder, "methods").where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.min("name").alias("name"), F.min(path).alias("path"))
    return rows.withColumn("is_test", F.coalesce(F.col("path").contains("/tools/"), F.lit(False)))


_CONTEXT = f"""m AS (SELECT id, lower(min(name)) AS name, {_SUB.format('min(name)')} AS own, lower(coalesce(min({_PATH.format('file_path')}), '')) AS path, {_SUB.format("coalesce(min(" + _PATH.format('file_path') + "), '')")} AS dirs, coalesce(contains(min({_PATH.format('file_path')}), '/tools/'), false) AS is_test
  FROM methods WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id), t AS (SELECT col0 AS term FROM (VALUES {_TERMS})), f AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(own) AS term FROM m) GROUP BY 1),
 i AS (SELECT t.term, ln(1 + (SELECT count(*) FROM m) / (1 + coalesce(df, 0))) AS idf FROM t LEFT JOIN f USING (term)),
 h AS (SELECT m.*, i.term, i.idf, list_max([length(i.term) / length(x) FOR x IN list_append(own, m.name) IF starts_with(x, i.term)]) AS ahead, list_max([length(x) / length(i.term) FOR x IN own IF starts_with(i.term, x) AND length(x) >= 4]) AS longer,
  length(i.term) >= 5 AND len([x FOR x IN own IF length(x) >= 4 AND {_STEM.format('x')} = {_STEM.format('i.term')}]) > 0 AS alike FROM m, i),
 w AS (SELECT id, is_test, term, idf * CASE WHEN name = term THEN 1000.0 WHEN ahead IS NOT NULL THEN 100.0 * least(ahead, 1.0) WHEN longer IS NOT NULL THEN 100.0 * least(longer, 1.0) WHEN alike THEN 80.0 WHEN contains(name, term) THEN 1.0 WHEN list_contains(dirs, term) THEN 60.0 WHEN contains(path, term) THEN 0.5 END AS w FROM h),
 c AS (SELECT id, round(sum(w) * (1 + count(*) / (SELECT count(*) FROM t)) * CASE WHEN is_test THEN 0.05 ELSE 1.0 END, 4) AS score, count(*) AS n, list_sort(list(term)) AS matched FROM w WHERE w IS NOT NULL GROUP BY id, is_test)"""


@query(f"WITH {_CONTEXT} SELECT id, score, array_to_string(matched, ' ') AS matched FROM c")
def context_scores(spark, folder):
    """How well each method answers the words of a task."""
    return verbs.context(_symbols(spark, folder), verbs.terms_of(TASK)).withColumn("matched", F.array_join("matched", " "))


@query(f"WITH {_CONTEXT}, x AS (SELECT unnest(matched) AS term, id, score, n FROM c) SELECT term, id, score FROM x QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, n DESC, id) = 1")
def context_seeds(spark, folder):
    """The method to start from for each word of a task."""
    return verbs.seeds(verbs.context(_symbols(spark, folder), verbs.terms_of(TASK))).select("term", "id", "score")


_EDITS = f"ed AS (SELECT {_PATH.format('file_path')} AS file, start_line AS line FROM js_parse_gap WHERE file_path IS NOT NULL AND start_line IS NOT NULL UNION SELECT {_PATH.format('file_path')}, start_line + 1 FROM js_method WHERE file_path IS NOT NULL AND start_line IS NOT NULL)"
_HELD = "SELECT DISTINCT id, {0} AS file, start_line AS a, end_line AS b FROM {1} WHERE id IS NOT NULL AND start_line <= end_line"
_LOCATED = f"""{_EDITS}, mm AS ({_HELD.format(_PATH.format('file_path'), 'methods')}), tt AS ({_HELD.format(_PATH.format('file_path'), 'types')}),
 im AS (SELECT DISTINCT ed.file, line, CASE WHEN line = a THEN 'signature' ELSE 'body' END AS part, id FROM (SELECT ed.*, mm.id, mm.a, mm.b, rank() OVER (PARTITION BY ed.file, ed.line ORDER BY mm.a DESC, mm.b) AS r FROM ed JOIN mm ON mm.file = ed.file AND ed.line BETWEEN mm.a AND mm.b) ed WHERE r = 1),
 it AS (SELECT DISTINCT ed.file, line, CASE WHEN line = a THEN 'type' ELSE 'inside' END AS part, id FROM (SELECT ed.*, tt.id, tt.a, tt.b, rank() OVER (PARTITION BY ed.file, ed.line ORDER BY tt.a DESC, tt.b) AS r FROM ed JOIN tt ON tt.file = ed.file AND ed.line BETWEEN tt.a AND tt.b) ed WHERE r = 1),
 located AS (SELECT * FROM im UNION ALL SELECT * FROM it WHERE (file, line) NOT IN (SELECT (file, line) FROM im) UNION ALL SELECT file, line, 'file', NULL FROM ed WHERE (file, line) NOT IN (SELECT (file, line) FROM im UNION SELECT (file, line) FROM it))"""


def _located(spark: SparkSession, folder: str) -> DataFrame:
    file = names.slashed(F.col("file_path")).alias("file")
    edits = table(spark, folder, "js_parse_gap").select(file, F.col("start_line").alias("line")).unionByName(table(spark, folder, "js_method").select(file, (F.col("start_line") + 1).alias("line")))
    own = lambda t: table(spark, folder, t).select("id", file, "start_line", "end_line")
    return changes.locate(edits, own("methods"), own("types"))


@query(f"WITH {_LOCATED} SELECT file, line, part, id FROM located")
def changed_declarations(spark, folder):
    """What each changed line belongs to: a method's header or body, a type's, or the file."""
    return _located(spark, folder)


@query(f"""WITH RECURSIVE {_CALLS}, e AS (SELECT DISTINCT src, dst FROM calls), {_LOCATED}, r AS (SELECT DISTINCT {_ID.format('id')} AS node, 0 AS hops FROM located WHERE part IN ('signature', 'body') UNION SELECT e.src, r.hops + 1 FROM r JOIN e ON e.dst = r.node WHERE r.hops < 60)
 SELECT node AS test, min(hops) AS hops FROM r WHERE node IN ({_TOOLS}) GROUP BY 1""")
def affected_tests(spark, folder):
    """The tools from which a changed method can be reached, nearest first by their hops."""
    changed = _located(spark, folder).where("part IN ('signature', 'body')").select(clean_id(F.col("id")).alias("node"))
    return changes.affected(changed, _calls(spark, folder).select("src", "dst"), _tools(spark, folder))


_TYPES = """up AS (SELECT 'C:' || c_custkey AS type, 'C:' || c_custkey AS owner, 0 AS depth FROM customer UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 1 FROM customer UNION ALL SELECT 'C:' || c_custkey, 'R:' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'N:' || n_nationkey, 'N:' || n_nationkey, 0 FROM nation UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 1 FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'R:' || r_regionkey, 0 FROM region),
 co AS (SELECT c_custkey, c_nationkey, n_regionkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
 decl AS (SELECT DISTINCT 'C:' || c_custkey AS owner, o_orderpriority AS member FROM co WHERE o_totalprice > 200000 UNION SELECT 'N:' || c_nationkey, o_orderpriority FROM co WHERE o_totalprice > 300000 UNION SELECT 'R:' || n_regionkey, o_orderpriority FROM co),
 found AS (SELECT up.type, d.member, d.owner, up.depth FROM up JOIN decl d USING (owner) QUALIFY rank() OVER (PARTITION BY up.type, d.member ORDER BY up.depth) = 1)"""


def _members(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = lambda n: table(spark, folder, n)
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    n, c = t("nation"), t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = [(c, "C:", "c_custkey", "C:", "c_custkey", 0), (c, "C:", "c_custkey", "N:", "c_nationkey", 1), (c, "C:", "c_custkey", "R:", "n_regionkey", 2), (n, "N:", "n_nationkey", "N:", "n_nationkey", 0), (n, "N:", "n_nationkey", "R:", "n_regionkey", 1), (t("region"), "R:", "r_regionkey", "R:", "r_regionkey", 0)]
    up = None
    for df, a, x, b, y, depth in rows:
        part = df.select(node(a, x).alias("type"), node(b, y).alias("owner"), F.lit(depth).alias("depth"))
        up = part if up is None else up.unionByName(part)
    sold = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    own = lambda least, letter, key: sold.where(F.col("o_totalprice") > least).select(node(letter, key).alias("owner"), F.col("o_orderpriority").alias("member"))
    return up, own(200000, "C:", "c_custkey").unionByName(own(300000, "N:", "c_nationkey")).unionByName(own(-1, "R:", "n_regionkey")).distinct(), sold.where("o_orderstatus = 'P'").select(node("C:", "c_custkey").alias("type")).distinct()


@query(f"WITH {_TYPES} SELECT DISTINCT type, member, owner, depth FROM found")
def member_lookup(spark, folder):
    """The nearest declaration of each member for each customer, nation and region, what is nearer shadowing the rest."""
    up, declared, _ = _members(spark, folder)
    return members.lookup(up, declared)


@query(f"""WITH {_TYPES}, live AS (SELECT DISTINCT 'C:' || c_custkey AS type FROM co WHERE o_orderstatus = 'P'), fan AS (SELECT up.owner AS type, f.member, count(DISTINCT f.owner) AS targets FROM up JOIN live ON live.type = up.type JOIN found f ON f.type = up.type GROUP BY ALL),
 site AS (SELECT o_orderkey AS site, 'N:' || c_nationkey AS type, o_orderpriority AS member FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT site, coalesce(targets, 0) AS targets, CASE WHEN targets IS NULL THEN 'unresolved' WHEN targets = 1 THEN 'known_edge' WHEN targets <= 4 THEN 'dispatch' ELSE 'fan_capped' END AS tier FROM site LEFT JOIN fan USING (type, member)""")
def member_dispatch(spark, folder):
    """Where calls typed by a nation can go among its customers that occur."""
    up, declared, live = _members(spark, folder)
    sites = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sites = sites.select(F.col("o_orderkey").alias("site"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("type"), F.col("o_orderpriority").alias("member"))
    return members.dispatch(sites, up, declared, live, 4)


@query("""WITH d AS (SELECT *, split_part(p_name, ' ', 2) AS noun, left(p_brand, 7) AS line FROM part), a AS (SELECT p_partkey AS call, 0 AS pos, p_name AS type FROM d WHERE p_size >= 40 UNION ALL SELECT p_partkey, 1, p_brand FROM d WHERE p_size >= 40),
 k AS (SELECT DISTINCT p_type, noun, CASE WHEN p_brand < 'Brand#2' THEN noun ELSE p_name END AS t0, CASE WHEN p_brand > 'Brand#15' THEN line ELSE p_brand END AS t1 FROM d WHERE p_size = 1), kk AS (SELECT *, p_type || '/' || t0 || '/' || t1 AS candidate FROM k),
 p AS (SELECT DISTINCT candidate, 0 AS pos, t0 AS type FROM kk UNION ALL SELECT DISTINCT candidate, 1, t1 FROM kk), c AS (SELECT DISTINCT d.p_partkey AS call, candidate FROM d JOIN kk ON d.p_type = kk.p_type AND d.noun = kk.noun WHERE d.p_size >= 40),
 st AS (SELECT DISTINCT p_name AS arg, noun AS param FROM d UNION SELECT p_brand, line FROM d), x AS (SELECT DISTINCT p_name AS x, noun AS k FROM d UNION SELECT p_brand, line FROM d), lo AS (SELECT x.x AS arg, y.x AS param FROM x JOIN x y ON x.k = y.k),
 way AS (SELECT c.call, c.candidate, max(CASE WHEN a.type = p.type OR st.arg IS NOT NULL THEN 1 WHEN lo.arg IS NOT NULL THEN 2 ELSE 3 END) AS way FROM c JOIN a ON a.call = c.call JOIN p ON p.candidate = c.candidate AND p.pos = a.pos LEFT JOIN st ON st.arg = a.type AND st.param = p.type LEFT JOIN lo ON lo.arg = a.type AND lo.param = p.type GROUP BY ALL),
 l AS (SELECT * FROM way WHERE way < 3 QUALIFY rank() OVER (PARTITION BY call ORDER BY way) = 1),
 beat AS (SELECT x.call, y.candidate FROM l x JOIN l y ON x.call = y.call AND x.candidate <> y.candidate JOIN p xp ON xp.candidate = x.candidate JOIN p yp ON yp.candidate = y.candidate AND yp.pos = xp.pos LEFT JOIN st ON st.arg = xp.type AND st.param = yp.type GROUP BY x.call, x.candidate, y.candidate HAVING bool_and(xp.type = yp.type OR st.arg IS NOT NULL) AND bool_or(xp.type <> yp.type))
 SELECT call, candidate, CASE way WHEN 1 THEN 'strict' ELSE 'loose' END AS phase FROM l WHERE (call, candidate) NOT IN (SELECT (call, candidate) FROM beat)""")
def overload_choice(spark, folder):
    """Which signatures a part means, with its name and brand as the types of two arguments; signatures ask for a name or
    only its noun, for a brand or only its line, so there are few however many parts."""
    rows = table(spark, folder, "part").withColumns({"noun": F.split("p_name", " ")[1], "line": F.left("p_brand", F.lit(7))})
    both = lambda df, key, a, b: df.select(key, F.lit(0).alias("pos"), F.col(a).alias("type")).unionByName(df.select(key, F.lit(1).alias("pos"), F.col(b).alias("type")))
    calls = rows.where("p_size >= 40").withColumnRenamed("p_partkey", "call")
    named, branded = F.when(F.col("p_brand") < "Brand#2", F.col("noun")).otherwise(F.col("p_name")), F.when(F.col("p_brand") > "Brand#15", F.col("line")).otherwise(F.col("p_brand"))
    known = rows.where("p_size = 1").select("p_type", "noun", named.alias("t0"), branded.alias("t1")).distinct().withColumn("candidate", F.concat_ws("/", "p_type", "t0", "t1"))
    pairs = calls.join(known, ["p_type", "noun"]).select("call", "candidate")
    kinds = rows.select(F.col("p_name").alias("x"), F.col("noun").alias("k")).union(rows.select("p_brand", "line")).distinct()  # names and brands, a fixed few
    strict = kinds.select(F.col("x").alias("arg"), F.col("k").alias("param"))
    loose = kinds.select(F.col("x").alias("arg"), "k").join(kinds.select(F.col("x").alias("param"), "k"), "k").select("arg", "param")
    return members.overloads(both(calls, "call", "p_name", "p_brand"), both(known, "candidate", "t0", "t1").distinct(), pairs, strict, loose)


@query("""WITH w AS (SELECT DISTINCT name AS key, js_method_unique_hash AS writer FROM js_method WHERE name IS NOT NULL AND js_method_unique_hash IS NOT NULL), r AS (SELECT DISTINCT name AS key, id AS declared FROM methods WHERE name IS NOT NULL AND id IS NOT NULL),
 few AS (SELECT key FROM w GROUP BY 1 HAVING count(*) <= 4 INTERSECT SELECT key FROM r GROUP BY 1 HAVING count(*) <= 4) SELECT w.writer, r.declared, w.key FROM w JOIN r USING (key) WHERE key IN (SELECT key FROM few) AND w.writer <> r.declared""")
def key_join_both_capped(spark, folder):
    """Functions and the methods that their names register, for names that few write and few register."""
    writes = table(spark, folder, "js_method").select(F.col("name").alias("key"), F.col("js_method_unique_hash").alias("writer"))
    registers = table(spark, folder, "methods").select(F.col("name").alias("key"), F.col("id").alias("declared"))
    return joins.capped_both(writes, registers, "key", "writer", "declared", 4, 4)


@query("SELECT m.q AS qualified_name, l.name FROM (SELECT DISTINCT qualified_name AS q FROM methods) m JOIN (SELECT DISTINCT name FROM lib_methods WHERE length(name) >= 3) l ON contains(m.q, l.name)")
def substring_join(spark, folder):
    """Methods whose qualified name contains the name of a library method."""
    return joins.containing(table(spark, folder, "methods"), "qualified_name", table(spark, folder, "lib_methods").select("name"), "name")


@query(f"WITH RECURSIVE {_NEXT}, r AS (SELECT 1::BIGINT AS node, 0 AS odd UNION SELECT e.dst, 1 - r.odd FROM r JOIN e ON e.src = r.node) SELECT node, odd FROM r")
def mutual_recursion(spark, folder):
    """Parts at an even and at an odd number of steps from part 1: two relations that define each other."""
    edges = _next_part(spark, folder)
    step = lambda fresh, known: fresh.join(edges, fresh.node == edges.src).select(F.col("dst").alias("node"))
    start = table(spark, folder, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    both = closure.fixpoint({"even": start, "odd": start.limit(0)}, [("odd", "even", step), ("even", "odd", step)])
    return both["even"].withColumn("odd", F.lit(0)).unionByName(both["odd"].withColumn("odd", F.lit(1)))


@query(f"""WITH RECURSIVE {_CALLS}, e AS (SELECT src, dst FROM calls UNION SELECT DISTINCT {_ID.format('id')}, {_ID.format('owner_type_id')} FROM methods WHERE {_ID.format('owner_type_id')} NOT IN ('', '-')), s AS (SELECT DISTINCT {_ID.format('id')} AS node FROM methods WHERE name LIKE 'visit%'),
 r AS (SELECT node, 0 AS h FROM s UNION SELECT e.dst, h + 1 FROM r JOIN e ON e.src = r.node WHERE h < 6) SELECT node, min(h) AS hops FROM r GROUP BY 1""")
def two_kind_reach_six(spark, folder):
    """What visitors reach over calls and owners within six steps, as far as the notes beside a file look."""
    owned = table(spark, folder, "methods").select(clean_id(F.col("id")).alias("src"), clean_id(F.col("owner_type_id")).alias("dst"))
    seeds = table(spark, folder, "methods").where("name LIKE 'visit%'").select(F.lit("a").alias("query"), clean_id(F.col("id")).alias("node"))
    return closure.bfs(closure.clean_edges(_calls(spark, folder).select("src", "dst").unionByName(owned)), seeds, 6).select("node", "hops")
