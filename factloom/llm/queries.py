"""The queries of the operators for text and code, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import documented, handwritten, packing, parsing, personal, tagger, tokens
from factloom.session import cut
from factloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document; an empty list for an empty or null text."""
    return tokens.encode(table(spark, folder, "documents"), tokens.tokenizer_path())


@query
def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, ids, characters that the offsets reach, and texts that decoding doesn't give back."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    path = tokens.tokenizer_path()
    coded = tokens.encode_with_offsets(docs, path)
    back = tokens.decode(coded, path).select("doc_id", F.xxhash64("text").alias("back"))
    sizes = coded.select("doc_id", F.size("ids").alias("n"), F.coalesce(F.try_element_at("starts", F.lit(-1)), F.lit(-1)).alias("last"))
    own = docs.select("doc_id", "source", F.xxhash64("text").alias("own"), F.length("text").alias("chars"))
    joined = own.join(back, "doc_id").join(sizes, "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("ids"), F.sum("chars").alias("chars"), F.sum((F.col("own") != F.col("back")).cast("int")).alias("changed"), F.sum((F.col("last") >= F.col("chars")).cast("int")).alias("offsets_beyond"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    windows = table(spark, folder, "context_windows").where(F.col("tokenizer") == tokens.DEFAULT_TOKENIZER)
    capacities = {r.window_id: r.capacity for r in windows.collect()}  # a fixed table of window kinds
    counts = tokens.token_counts(table(spark, folder, "documents"), tokens.tokenizer_path())
    return packing.pack(cut(counts, "token-counts"), capacities), capacities


@query
def p7_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The window of every document, or of each piece of one larger than the capacity, for each kind of window."""
    return _packed(spark, folder)[0]


@query
def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many windows were used and how full they are."""
    return packing.report(*_packed(spark, folder))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Source files that do not parse."""
    return parsing.faults(table(spark, folder, "documents")).select("doc_id")


@query
def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of files that do not parse, per repository and language."""
    docs = table(spark, folder, "documents")
    return parsing.rates(docs, parsing.faults(docs))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documented functions of the files that parse."""
    docs = table(spark, folder, "documents")
    found = documented.documented(docs).select("doc_id", "method_name", "start_line").distinct()
    return found.join(parsing.faults(documented.readable(docs)).select("doc_id"), "doc_id", "left_anti")


@query
def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of documented functions, from broken files too, without templates."""
    return documented.pairs(table(spark, folder, "documents"))


def _paths(spark: SparkSession, folder: str) -> list[DataFrame]:
    own = handwritten.clean_path(F.col("file_path"))
    out = [table(spark, folder, t).select(own.alias("file_path"), own.alias("judged")) for t in ("documents", "methods", "js_module")]
    governing = handwritten.clean_path(F.col("governing_package_json_path"))
    return [*out, table(spark, folder, "js_module").select(own.alias("file_path"), F.regexp_replace(governing, "^/checkout/", "").alias("judged"))]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.col("file_path").isNotNull())


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that were not written by hand."""
    docs = _files(spark, folder)
    paths = _paths(spark, folder)
    return handwritten.found(docs, paths, handwritten.fit(docs, paths)).select("file_path").distinct()


@query
def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The source documents that remain once the others are out."""
    docs = _files(spark, folder)
    paths = _paths(spark, folder)
    bad = handwritten.found(docs, paths, handwritten.fit(docs, paths)).select("file_path").distinct()
    return docs.select("doc_id", "repo", handwritten.clean_path(F.col("file_path")).alias("file_path")).join(bad, "file_path", "left_anti")


@query
def p1_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How the classifiers judge the repositories kept for validation against the labels, and where only one of the two
    calls a case."""
    models = handwritten.fit(_files(spark, folder), _paths(spark, folder))
    rows = [(name, int(m.report["rows"]), round(m.report["precision"], 4), round(m.report["recall"], 4), int(m.report["found_alone"]), int(m.report["labelled_alone"])) for name, m in zip(("path", "text", "opening"), models)]
    return spark.createDataFrame(rows, "classifier string, labelled bigint, precision double, recall double, found_alone bigint, labelled_alone bigint")


def _tagger(spark: SparkSession, folder: str) -> tagger.Tagger:
    """A tagger trained on a bounded sample of a folder's documents."""
    return personal.train(personal.sample_windows(table(spark, folder, "documents")))


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of personal information."""
    return personal.mentions(table(spark, folder, "documents"), _tagger(spark, folder)).select("doc_id", "pii_type", "start_char").distinct()


@query
def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with each mention replaced by a placeholder of its type."""
    return personal.redact(table(spark, folder, "documents"), _tagger(spark, folder))


@query
def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions, those whose decoded span was put on other limits, and documents with mentions, per source and type."""
    docs = table(spark, folder, "documents")
    found = personal.mentions(docs, _tagger(spark, folder)).dropDuplicates(["doc_id", "pii_type", "start_char"])
    per = found.groupBy("doc_id", "pii_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_if("snapped").alias("snapped"))
    joined = per.join(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    return joined.groupBy("source", "pii_type").agg(F.sum("mentions").alias("mentions"), F.sum("snapped").alias("snapped"), F.count(F.lit(1)).alias("docs"))
