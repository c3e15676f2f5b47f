"""Source files that do not parse in the language of their extension.

Texts are lexed in Arrow batches into rows, one per token. A token row whose pair with the token before it is missing
from the permitted pairs of the language's grammar breaks the file: an anti-join with a broadcast table whose size the
grammars fix. Of the other rows only brackets, statement ends and the heads of Python's statements are shuffled by
file; windows over them give the nesting depth, the bracket that each one closes, and what stands before and behind it,
against which nesting and statement productions are held. One reduction per file says whether and why it fails.

Defined cases: texts that are null, empty or blank and files of other extensions are no cases and are left out;
repeated rows of a document are judged one by one and give one row; an empty table gives no rows. A file with a
language's extension is read as that language whatever ``lang`` says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.llm import grammars, lexers

#: Characters of text lexed at a time within a batch.
PART = 1 << 20
#: Tokens of a file that can be told apart by position: 2 ** 28.
_BITS = {"next": 9, "prev": 9, "kind": 9, "lang": 3, "role": 4}


def _pack(pos: np.ndarray, role: np.ndarray, lang: int, kind: np.ndarray, prev: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Position, role and classes in one number that sorts by position."""
    return ((((pos << 4 | role) << 3 | lang) << 9 | kind) << 9 | prev) << 9 | after


def _unpack(c: Column) -> dict[str, Column]:
    out, at = {}, 0
    for name, bits in _BITS.items():
        out[name] = F.shiftright(c, at).bitwiseAND((1 << bits) - 1).cast("int")
        at += bits
    return out


def _parts(texts: list[str]) -> Iterator[range]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PART:
            yield range(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def token_rows(files: DataFrame) -> DataFrame:
    """``(doc_id, row, pair, packed)`` of ``files (doc_id, row, file_path, text)``: a row per token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column(0), batch.column(1)
            languages, texts = lexers.known(batch.column(2).to_pylist()), batch.column(3).to_pylist()
            for lang, number in lexers.CODES.items():
                own = [k for k, x in enumerate(languages) if x == lang]
                for part in _parts([texts[k] for k in own]):
                    at = np.array([own[k] for k in part])
                    code, doc, _, newline = lexers.lex([texts[k] for k in at], lang)
                    role = lexers.roles(code, doc, lang)
                    code = code.astype(np.int64)
                    prev, after = np.roll(code, 1), np.roll(code, -1)
                    pos = np.arange(len(code)) - np.searchsorted(doc, doc)
                    pair = grammars.pair_number(number, prev, code, newline.astype(np.int64))
                    kept = pos > 0  # BOF has no token before it
                    where = pa.array(at[doc[kept]])
                    yield pa.RecordBatch.from_arrays([ids.take(where), row.take(where), pa.array(pair[kept].astype(np.int32)), pa.array(_pack(pos, role, number, code, prev, after)[kept])], ["doc_id", "row", "pair", "packed"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "row", "file_path", "text").mapInArrow(run, f"doc_id {kind}, row bigint, pair int, packed bigint")


def source_files(docs: DataFrame) -> DataFrame:
    """The documents that are files of a known language with a text, each row with a number of its own."""
    ends = "|".join(sorted(lexers.LANGUAGES))
    out = docs.where(F.col("file_path").rlike(rf"(?i)\.(?:{ends})$") & F.col("text").rlike(r"\S"))
    return out.withColumn("row", F.monotonically_increasing_id())


def _number(words: list[str]) -> list[int]:
    n = lexers.classes()
    return [n[w] for w in words]


def _production_keys() -> tuple[list[int], list[int]]:
    """Words bound to a bracket, and the permitted (language, word, bracket, next) quadruples, as numbers."""
    n, bound, held = lexers.classes(), set(), set()
    for lang, code in lexers.CODES.items():
        for word, bracket, after in grammars.productions(lang):
            if all(x in n for x in (word, bracket, after)):
                bound.add((code * 512 + n[word]) * 512 + n[bracket])
                held.add(((code * 512 + n[word]) * 512 + n[bracket]) * 512 + n[after])
    return sorted(bound), sorted(held)


def faults(docs: DataFrame) -> DataFrame:
    """``(doc_id, fault)``: the gravest fault of each file that fails: ``token_pair``, ``nesting`` or ``statement``."""
    spark, n = docs.sparkSession, lexers.classes()
    tokens = token_rows(source_files(docs))
    # the anti-join, written as an outer one since the rows that pass are needed for the windows
    pairs = F.broadcast(spark.createDataFrame(grammars.pair_rows(), "pair int").withColumn("permitted", F.lit(True)))
    role = F.shiftright("packed", 30).bitwiseAND(15)
    checked = tokens.join(pairs, "pair", "left").withColumn("broken", F.col("permitted").isNull())
    kept = checked.where(F.col("broken") | (role != 0)).select("doc_id", "row", "packed", "broken")

    file = ["doc_id", "row"]
    rows = kept.select(*file, "packed", "broken", *[c.alias(k) for k, c in _unpack(F.col("packed")).items()])
    step = F.when(F.col("role") == lexers.OPENS, 1).when(F.col("role") == lexers.CLOSES, -1).otherwise(0)
    by_pos = W.partitionBy(*file).orderBy("packed")
    depth = F.sum(step).over(by_pos.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("depth", depth).withColumn("level", F.col("depth") + (F.col("role") == lexers.CLOSES).cast("int"))
    level = W.partitionBy(*file, "level").orderBy("packed")
    opener = F.last(F.when(F.col("role") == lexers.OPENS, F.col("packed")), ignorenulls=True).over(level.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("opener", opener).withColumn("behind", F.lead("role").over(level))

    own, head = _unpack(F.col("opener")), F.col("role")
    opened, word = F.coalesce(own["kind"], F.lit(-1)), F.coalesce(own["prev"], F.lit(-1))
    is_role = lambda r: F.col("role") == r
    closes = {c: o for o, c in zip(_number(list(lexers.OPEN)), _number(list(lexers.CLOSE)))}
    unmatched = is_role(lexers.CLOSES) & ((F.col("level") <= 0) | ~F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in closes.items() for x in kv]), F.col("kind")) == opened, F.lit(False)))
    left_open = is_role(lexers.END) & (F.col("depth") != 0)
    semicolon = is_role(lexers.SEMICOLON) & (F.col("level") > 0) & ((opened == n["["]) | (opened == n["("]) & ~word.isin(_number(["for", "try"])))
    bound, held = _production_keys()
    key = (F.col("lang").cast("bigint") * 512 + word) * 512 + opened
    production = is_role(lexers.CLOSES) & key.isin(bound) & ~(key * 512 + F.col("next")).isin(held)
    python, json = F.col("lang") == lexers.CODES["python"], F.col("lang") == lexers.CODES["json"]
    raises = F.col("kind") == n["raise"]
    behind = F.coalesce(F.col("behind"), F.lit(0))
    statement = python & (head == lexers.HEAD) & F.when(raises, behind == lexers.COMMA).otherwise(behind != lexers.COLON)
    member = json & (is_role(lexers.COLON) & (opened != n["{"]) | is_role(lexers.COMMA) & (F.col("level") > 0) & ((opened == n["{"]) != (F.col("next") == n["key"])))
    rank = F.when(F.col("broken"), 3).when(unmatched | left_open, 2).when(semicolon | production | statement | member, 1).otherwise(0)
    found = rows.groupBy(*file).agg(F.max(rank).alias("rank")).where("rank > 0")
    return found.groupBy("doc_id").agg(F.max("rank").alias("rank")).select("doc_id", F.element_at(F.array(F.lit("statement"), F.lit("nesting"), F.lit("token_pair")), F.col("rank")).alias("fault"))


def rates(docs: DataFrame, failed: DataFrame) -> DataFrame:
    """Files, failing files and their share per repository and language of the extension; '' for no repository."""
    end = F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in lexers.LANGUAGES.items() for x in kv]), end)
    files = source_files(docs).select("doc_id", F.coalesce("repo", F.lit("")).alias("repo"), language.alias("language")).distinct()
    marked = files.join(failed.select("doc_id").withColumn("bad", F.lit(1)), "doc_id", "left")
    out = marked.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
