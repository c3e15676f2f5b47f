"""The queries of the core operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import resolution_queries, verb_queries  # noqa: F401  register their queries
from factloom.graph_queries import flagship
from factloom.operators import orphans, rejects
from factloom.registry import QUERIES, SQL, query
from factloom.sources.tables import table

__all__ = ["QUERIES", "SQL", "flagship"]

def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    methods, edges = table(spark, folder, "methods"), table(spark, folder, "call_edges")
    to = F.col("callee_provenance")
    refs = (
        orphans.references(methods, "methods", "owner_type_id", F.col("id"), "loaded_at", F.lit("types"))
        .unionByName(orphans.references(edges, "call_edges", "caller_id", F.col("edge_id"), "recorded_at", F.lit("methods")))
        .unionByName(orphans.references(edges, "call_edges", "callee_method_id", F.col("edge_id"), "recorded_at", F.when(to == "client", "methods").when(to == "lib", "lib_methods")))
    )
    parents = [orphans.versions(table(spark, folder, t), t) for t in ("methods", "types", "lib_methods")]
    return refs, parents[0].unionByName(parents[1]).unionByName(parents[2])


_BARE = "lower(trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)))"
_ORPHANS = f"""
WITH refs AS (
  SELECT 'methods' AS ref_table, 'owner_type_id' AS ref_column, id AS ref_key, 'types' AS target, {_BARE.format('owner_type_id')} AS k, loaded_at AS t FROM methods
  UNION ALL SELECT 'call_edges', 'caller_id', CAST(edge_id AS VARCHAR), 'methods', {_BARE.format('caller_id')}, recorded_at FROM call_edges
  UNION ALL SELECT 'call_edges', 'callee_method_id', CAST(edge_id AS VARCHAR), CASE callee_provenance WHEN 'client' THEN 'methods' ELSE 'lib_methods' END, {_BARE.format('callee_method_id')}, recorded_at
    FROM call_edges WHERE callee_provenance IN ('client', 'lib')
), parents AS (
  SELECT 'methods' AS target, {_BARE.format('id')} AS k, loaded_at AS a, deleted_at AS b FROM methods
  UNION ALL SELECT 'types', {_BARE.format('id')}, loaded_at, deleted_at FROM types
  UNION ALL SELECT 'lib_methods', {_BARE.format('id')}, loaded_at, deleted_at FROM lib_methods
), bad AS (
  SELECT * FROM refs r WHERE k NOT IN ('', '-') AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.target = r.target AND p.k = r.k AND (r.t IS NULL OR ((p.a IS NULL OR p.a <= r.t) AND (p.b IS NULL OR r.t < p.b))))
)"""


@query(_ORPHANS + " SELECT DISTINCT ref_table, ref_column, ref_key FROM bad")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references."""
    return orphans.find_orphans(*_references(spark, folder)).select("ref_table", "ref_column", "ref_key").distinct()


@query(
    _ORPHANS
    + """, total AS (SELECT ref_table, ref_column, coalesce(strftime(t, '%Y-%m'), '') AS m, count(DISTINCT ref_key) AS n FROM refs WHERE k NOT IN ('', '-') GROUP BY ALL),
  lost AS (SELECT ref_table, ref_column, coalesce(strftime(t, '%Y-%m'), '') AS m, count(DISTINCT ref_key) AS n FROM bad GROUP BY ALL)
  SELECT t.ref_table, t.ref_column, t.m AS month, t.n AS "references", coalesce(l.n, 0) AS orphans FROM total t LEFT JOIN lost l USING (ref_table, ref_column, m)"""
)
def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """References and orphans per table, column and month of the referring row."""
    refs, parents = _references(spark, folder)
    return orphans.orphan_report(refs, orphans.find_orphans(refs, parents))


def _staged(spark: SparkSession, folder: str) -> DataFrame:
    layout_of = rejects.layouts(table(spark, folder, "raw_sources"), table(spark, folder, "raw_columns"))
    return rejects.read_staged(table(spark, folder, "raw_rows"), layout_of)


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Staged rows that fail, with the reason."""
    return _staged(spark, folder).where(F.col("reason").isNotNull()).select("row_id", "reason").distinct()


@query()
def p3_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Staged rows that hold, with their fields."""
    return _staged(spark, folder).where(F.col("reason").isNull()).select("row_id", "csv_file", "values")


@query()
def p3_typed(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows loaded under their columns' names and types: one struct for each file's layout, set where the row is of that file."""
    layout_of = rejects.layouts(table(spark, folder, "raw_sources"), table(spark, folder, "raw_columns"))
    return rejects.typed(rejects.read_staged(table(spark, folder, "raw_rows"), layout_of), layout_of)


@query()
def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per file and outcome."""
    return _staged(spark, folder).groupBy("csv_file", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))
