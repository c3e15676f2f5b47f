"""Queries of the operators that resolve names and follow versions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names
from factloom.graph_queries import _CALLS, _GEO, _ID, _calls, _geo
from factloom.operators import closure, resolution
from factloom.operators.orphans import clean_id
from factloom.registry import query
from factloom.sources.tables import table

_PATH = "regexp_replace(replace({0}, chr(92), '/'), '^(\\./)+', '')"
_OWNER = r"regexp_replace(qualified_name, '\.[^.]*$', '')"


@query(f"""WITH i AS (SELECT DISTINCT name, {_OWNER} AS owner, {_PATH.format('file_path')} AS file FROM js_method),
 c AS (SELECT DISTINCT {_ID.format('id')} AS id, name, owner_qualified_name AS owner, {_PATH.format('file_path')} AS file FROM methods),
 a AS (SELECT name, owner, count(DISTINCT id) AS n, min(id) AS t FROM c WHERE owner IS NOT NULL GROUP BY ALL), b AS (SELECT name, file, count(DISTINCT id) AS n, min(id) AS t FROM c WHERE file IS NOT NULL GROUP BY ALL), d AS (SELECT name, count(DISTINCT id) AS n, min(id) AS t FROM c GROUP BY ALL)
 SELECT i.name, i.owner, i.file, CASE WHEN a.n > 0 THEN 0 WHEN b.n > 0 THEN 1 WHEN d.n > 0 THEN 2 END AS depth, coalesce(a.n, b.n, d.n) AS candidates, CASE WHEN coalesce(a.n, b.n, d.n) = 1 THEN coalesce(a.t, b.t, d.t) END AS id
 FROM i LEFT JOIN a ON i.name = a.name AND i.owner = a.owner LEFT JOIN b ON i.name = b.name AND i.file = b.file LEFT JOIN d ON i.name = d.name""")
def scope_lookup(spark, folder):
    """Each function's declaration: in its owner, else in its file, else anywhere."""
    file = names.slashed(F.col("file_path")).alias("file")
    items = table(spark, folder, "js_method").select("name", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("owner"), file).distinct()
    known = table(spark, folder, "methods").select(clean_id(F.col("id")).alias("id"), "name", F.col("owner_qualified_name").alias("owner"), file)
    return resolution.by_scope(items, known, "id", [["name", "owner"], ["name", "file"], ["name"]])


@query(f"""WITH e AS (SELECT DISTINCT edge_id, {_ID.format('callee_method_id')} AS k FROM call_edges), m AS (SELECT {_ID.format('id')} AS k, min(name) AS v FROM methods GROUP BY 1), l AS (SELECT {_ID.format('id')} AS k, min(name) AS v FROM lib_methods GROUP BY 1)
 SELECT edge_id, coalesce(m.v, l.v) AS callee, CASE WHEN m.v IS NOT NULL THEN 'client' WHEN l.v IS NOT NULL THEN 'library' END AS source FROM e LEFT JOIN m ON e.k = m.k LEFT JOIN l ON e.k = l.k""")
def callee_names(spark, folder):
    """Each edge's callee by name, from the client's methods or else from the library's."""
    own = lambda t: table(spark, folder, t).select(clean_id(F.col("id")).alias("k"), F.col("name").alias("callee"))
    edges = table(spark, folder, "call_edges").select("edge_id", clean_id(F.col("callee_method_id")).alias("k")).distinct()
    return resolution.first_source(edges, "k", [("client", own("methods")), ("library", own("lib_methods"))], "callee").drop("k")


_REACH = "c AS (SELECT src, dst FROM geo UNION SELECT c.src, g.dst FROM c JOIN geo g ON g.src = c.dst)"


@query(f"WITH RECURSIVE {_GEO}, {_REACH}, n AS (SELECT a.src, a.dst, count(DISTINCT x.dst) AS n FROM c a JOIN c x ON a.src = x.src JOIN c b ON b.src = x.dst AND b.dst = a.dst GROUP BY ALL) SELECT src, dst, coalesce(n, 0) AS position FROM c LEFT JOIN n USING (src, dst)")
def linear_order(spark, folder):
    """The order of ancestors where each type has one base; a fixture holds that of several bases."""
    return resolution.linear_order(_geo(spark, folder).withColumn("place", F.lit(0)))


@query(f"""WITH RECURSIVE {_GEO}, {_REACH}, l AS (SELECT 'nation ' || n_name AS listener, 'N:' || n_nationkey AS type FROM nation UNION SELECT 'region ' || r_name, 'R:' || r_regionkey FROM region UNION SELECT 'all', '*'),
 h AS (SELECT 'S:' || s_suppkey AS type, 'S:' || s_suppkey AS heard FROM supplier UNION SELECT src, dst FROM c WHERE starts_with(src, 'S:') UNION SELECT 'S:' || s_suppkey, '*' FROM supplier) SELECT DISTINCT h.type, l.listener FROM h JOIN l ON h.heard = l.type""")
def event_listeners(spark, folder):
    """Who hears of each supplier: its nation, its region, and whoever hears everything."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    own = lambda df, kind, letter, key, name: df.select(F.concat(F.lit(kind), name).alias("listener"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("type"))
    listening = own(n, "nation ", "N:", "n_nationkey", "n_name").unionByName(own(r, "region ", "R:", "r_regionkey", "r_name")).unionByName(spark.createDataFrame([("all", "*")], "listener string, type string"))
    published = table(spark, folder, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("type"))
    return resolution.listeners(published, listening, closure.transitive_closure(_geo(spark, folder)), "*")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS viewed FROM events")
def last_assignment(spark, folder):
    """The last view before each event of a user, as the last assignment before a use."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    return resolution.last_before(rows, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "view", "viewed").select("event_id", "user_id", "viewed")


@query("SELECT id, unnest([k FOR k IN range(length(qualified_name)) IF qualified_name[k + 1] = '.']) AS place FROM (SELECT DISTINCT id, qualified_name FROM lib_methods)")
def dot_positions(spark, folder):
    rows = table(spark, folder, "lib_methods").select("id", "qualified_name").distinct()
    return rows.select("id", F.explode(names.positions(F.col("qualified_name"), ".")).alias("place")).withColumn("place", F.col("place").cast("bigint"))


@query(f"SELECT file, line, count(*) AS methods FROM (SELECT file, name, start_line, unnest(range(start_line, end_line + 1)) AS line FROM (SELECT DISTINCT {_PATH.format('file_path')} AS file, name, start_line, end_line FROM js_method WHERE start_line <= end_line)) GROUP BY ALL")
def line_cover(spark, folder):
    """How many functions cover each line."""
    rows = table(spark, folder, "js_method").where("start_line <= end_line").select(names.slashed(F.col("file_path")).alias("file"), "name", "start_line", "end_line").distinct()
    return rows.select("file", F.explode(F.sequence(F.col("start_line").cast("bigint"), F.col("end_line").cast("bigint"))).alias("line")).groupBy("file", "line").agg(F.count(F.lit(1)).alias("methods"))


@query("""SELECT doc_id, md5(regexp_replace(text, '(?s)/\\*.*?\\*/|//[^\\n]*|"[^"\\n]*"', ' ', 'g')) AS code FROM documents WHERE source = 'source_file' AND text IS NOT NULL""")
def stripped_code(spark, folder):
    """A fingerprint of each file without comments and strings."""
    rows = table(spark, folder, "documents").where("source = 'source_file' AND text IS NOT NULL")
    return rows.select("doc_id", F.md5(names.without_comments(F.col("text"))).alias("code"))


@query("WITH j AS (SELECT DISTINCT name, lower(regexp_replace(name, '[-_.]', '', 'g')) AS k FROM js_method), m AS (SELECT DISTINCT name AS other, lower(regexp_replace(name, '[-_.]', '', 'g')) AS k FROM methods) SELECT j.name, m.other FROM j JOIN m USING (k) WHERE j.name <> m.other")
def relaxed_binding(spark, folder):
    """Names that other files spell differently, as configuration keys are bound whatever the spelling."""
    own = lambda t, c: table(spark, folder, t).select(F.col("name").alias(c), names.relaxed(F.col("name")).alias("k")).distinct()
    return own("js_method", "name").join(own("methods", "other"), "k").where("name != other").select("name", "other")


@query("SELECT DISTINCT owner_qualified_name AS owner, p || upper(name[1]) || name[2:] AS member FROM methods, (VALUES ('get'), ('set')) v(p) WHERE owner_qualified_name IS NOT NULL AND name IS NOT NULL")
def generated_members(spark, folder):
    """Accessors that a generator would add to each owner."""
    both = F.explode(F.array(*[names.accessor(F.col("name"), p) for p in ("get", "set")])).alias("member")
    return table(spark, folder, "methods").where("owner_qualified_name IS NOT NULL AND name IS NOT NULL").select(F.col("owner_qualified_name").alias("owner"), both).distinct()


@query(f"""WITH {_CALLS}, m AS (SELECT DISTINCT {_ID.format('id')} AS id, name, access FROM methods), r AS (SELECT id, 'public' AS reason FROM m WHERE access = 'public' UNION SELECT id, 'visitor' FROM m WHERE name LIKE 'visit%' UNION SELECT id, 'uncalled' FROM m WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = m.id))
 SELECT id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1""")
def entry_reasons(spark, folder):
    """Why each method counts as an entry point."""
    m = table(spark, folder, "methods").select(clean_id(F.col("id")).alias("id"), "name", "access").where("id IS NOT NULL").distinct()
    uncalled = m.join(_calls(spark, folder).select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit("uncalled").alias("reason"))
    reasons = m.where("access = 'public'").select("id", F.lit("public").alias("reason")).unionByName(m.where("name LIKE 'visit%'").select("id", F.lit("visitor").alias("reason"))).unionByName(uncalled)
    return reasons.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("SELECT l_returnflag AS flag, count(*) AS rows, round(100.0 * count(*) FILTER (WHERE l_quantity > 25) / count(*), 6) AS selected, CAST(median(l_quantity) AS DOUBLE) AS median_quantity FROM lineitem GROUP BY 1")
def selection_metrics(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("rows"), F.round(100.0 * F.count_if(F.col("l_quantity") > 25) / n, 6).alias("selected"), F.median("l_quantity").cast("double").alias("median_quantity"))


@query(f"WITH f AS (SELECT {_PATH.format('file_path')} AS file, count(DISTINCT id) AS methods FROM methods WHERE file_path IS NOT NULL GROUP BY 1), t AS (SELECT * FROM f ORDER BY methods DESC, file LIMIT 20) SELECT file, methods, CAST((SELECT sum(methods) FROM f) - (SELECT sum(methods) FROM t) AS BIGINT) AS remaining FROM t")
def top_files(spark, folder):
    """The files with the most methods, and how many methods the others hold."""
    f = table(spark, folder, "methods").where("file_path IS NOT NULL").groupBy(names.slashed(F.col("file_path")).alias("file")).agg(F.countDistinct("id").alias("methods"))
    top = f.orderBy(F.desc("methods"), "file").limit(20)
    total = lambda df: df.agg(F.sum("methods")).scalar()
    return top.select("file", "methods", (total(f) - total(top)).alias("remaining"))


@query("""WITH v AS (SELECT DISTINCT id, loaded_at, deleted_at, file_path, access FROM methods), l AS (SELECT *, row_number() OVER w AS k, lag(deleted_at) OVER w AS d, lag(file_path) OVER w AS f, lag(access) OVER w AS a FROM v
 WINDOW w AS (PARTITION BY id ORDER BY loaded_at NULLS FIRST, deleted_at NULLS FIRST, file_path NULLS FIRST, access NULLS FIRST)),
 c AS (SELECT id, loaded_at, k, concat_ws(',', CASE WHEN deleted_at IS DISTINCT FROM d THEN 'deleted_at' END, CASE WHEN file_path IS DISTINCT FROM f THEN 'file_path' END, CASE WHEN access IS DISTINCT FROM a THEN 'access' END) AS changed FROM l)
 SELECT id, loaded_at, changed FROM c WHERE k > 1 AND changed <> ''""")
def version_changes(spark, folder):
    """What each version of a method changed."""
    return resolution.version_changes(table(spark, folder, "methods"), "id", "loaded_at", ["deleted_at", "file_path", "access"])


@query("SELECT signature, count(DISTINCT owner_qualified_name) AS owners FROM methods WHERE signature IS NOT NULL GROUP BY 1 HAVING count(DISTINCT owner_qualified_name) >= 2")
def override_classes(spark, folder):
    """Signatures that more than one owner declares, as classes rather than pairs."""
    rows = table(spark, folder, "methods").where("signature IS NOT NULL").groupBy("signature").agg(F.countDistinct("owner_qualified_name").alias("owners"))
    return rows.where("owners >= 2")


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents WHERE source = 'source_file') SELECT name, count(*) AS documents FROM w WHERE name IN (SELECT name FROM types) GROUP BY 1")
def type_use(spark, folder):
    """How many files name each type."""
    words = table(spark, folder, "documents").where("source = 'source_file'").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return words.join(table(spark, folder, "types").select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count_distinct("doc_id").alias("documents"))


@query("""WITH o AS (SELECT name, id, bool_or(coalesce(access = 'public', false)) AS p FROM methods WHERE name IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2), t AS (SELECT name, count(*) AS n, min(id) AS any_id, count(*) FILTER (WHERE p) AS np, min(id) FILTER (WHERE p) AS own FROM o GROUP BY 1)
 SELECT name, n, CASE WHEN n = 1 THEN any_id WHEN np = 1 THEN own END AS chosen FROM t""")
def sole_candidate(spark, folder):
    """The method a name means if only one has it, or only one public one."""
    return resolution.sole_candidate(table(spark, folder, "methods"), "name", "id", F.col("access") == "public")


def _seeds(spark, folder):
    return table(spark, folder, "methods").where("name LIKE 'visit%'").select(F.lit("a").alias("query"), clean_id(F.col("id")).alias("node"))


_SEEDS = f"s AS (SELECT DISTINCT {_ID.format('id')} AS node FROM methods WHERE name LIKE 'visit%')"


@query(f"WITH RECURSIVE {_CALLS}, e AS (SELECT DISTINCT src, dst FROM calls), {_SEEDS}, r AS (SELECT node FROM s UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r")
def reverse_reach(spark, folder):
    """All methods from which a visitor can be reached."""
    return closure.bfs(closure.reverse(closure.clean_edges(_calls(spark, folder))), _seeds(spark, folder)).select("node")


_OWN = f"SELECT DISTINCT {_ID.format('id')} AS src, {_ID.format('owner_type_id')} AS dst FROM methods WHERE {_ID.format('owner_type_id')} NOT IN ('', '-')"


@query(f"""WITH RECURSIVE {_CALLS}, e AS (SELECT src, dst FROM calls UNION {_OWN}), {_SEEDS}, r AS (SELECT node, 0 AS h FROM s UNION SELECT e.dst, h + 1 FROM r JOIN e ON e.src = r.node WHERE h < 3) SELECT node, min(h) AS hops FROM r GROUP BY 1""")
def two_kind_reach(spark, folder):
    """What visitors reach within three steps over calls and owners."""
    owned = table(spark, folder, "methods").select(clean_id(F.col("id")).alias("src"), clean_id(F.col("owner_type_id")).alias("dst"))
    edges = closure.clean_edges(_calls(spark, folder).select("src", "dst").unionByName(owned))
    return closure.bfs(edges, _seeds(spark, folder), 3).select("node", "hops")


@query("SELECT prefix, count(*) AS names FROM (SELECT qualified_name, unnest([array_to_string(string_split(qualified_name, '.')[1:k], '.') FOR k IN range(1, least(3, len(string_split(qualified_name, '.'))) + 1)]) AS prefix FROM (SELECT DISTINCT qualified_name FROM types WHERE qualified_name IS NOT NULL)) GROUP BY 1")
def prefix_nesting(spark, folder):
    """How many types lie below each of the first three levels of names."""
    rows = table(spark, folder, "types").where("qualified_name IS NOT NULL").select("qualified_name").distinct()
    return rows.select(F.explode(names.prefixes(F.col("qualified_name"), 3)).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("names"))
