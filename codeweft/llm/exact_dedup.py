"""Exact deduplication by content-defined chunk recipes (native).

A text is cut where its own content says so, each chunk gets an identifier,
and the text's recipe is the ordered list of its chunks' identifiers. The
chunk dictionary verifies that no identifier stands for two different chunks,
so equal recipes mean equal texts; from then on only recipes (16 bytes for
some hundred characters) move, never the texts.

Defined results: a null text counts as empty, and all empty texts are equal
(their recipe has no chunks). Rows of one text with the same largest
``doc_id`` (repeated rows) are all marked kept, each counts in
``group_size``. A null ``doc_id`` is smaller than any other. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm._store import materialise

#: Least and most characters of a chunk; between them it ends after the first
#: line break or end of a sentence.
MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of ``text`` in order; joined they give ``text`` again."""
    rule = rf"(?s).{{{least}}}.{{0,{most - least}}}?(?:(?<=\n)|(?<=[.!?] )|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.md5(chunk)


def conflicts(docs: DataFrame, ident=chunk_id) -> DataFrame:
    """``id`` of every identifier that stands for more than one chunk. Each
    distinct chunk moves once to get here."""
    each = docs.select(F.explode(chunks(F.coalesce("text", F.lit("")))).alias("chunk"))
    distinct = each.select(F.unhex(ident(F.col("chunk"))).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def recipes(docs: DataFrame, ident=chunk_id) -> DataFrame:
    """``doc_id, text_sha256, recipe`` for each row, with verified recipes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    plan = base.select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.unhex(F.array_join(F.transform(chunks(F.col("text")), ident), "")).alias("recipe"),
    )
    bad = materialise(conflicts(base, ident), "conflicts")
    if bad.isEmpty():
        return plan
    # A recipe that uses an ambiguous identifier is told apart by the text itself.
    listed = base.withColumn("__row", F.monotonically_increasing_id()).withColumn("ids", F.transform(chunks(F.col("text")), lambda c: F.unhex(ident(c))))
    listed = materialise(listed, "listed")
    hit = listed.select("__row", F.explode("ids").alias("id")).join(bad, "id", "left_semi").select("__row").distinct().withColumn("unsure", F.lit(True))
    joined = F.unhex(F.array_join(F.transform("ids", F.hex), ""))
    return listed.join(hit, "__row", "left").select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.when(F.col("unsure"), F.concat(joined, F.lit("|").cast("binary"), F.col("text").cast("binary"))).otherwise(joined).alias("recipe"),
    )


def exact_dedup(docs: DataFrame, ident=chunk_id) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row."""
    listed = materialise(recipes(docs, ident), "recipes")
    # Only recipes of several rows are joined, from a table of their own: a
    # very frequent one is then a skewed join that Spark can split.
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    out = listed.join(materialise(groups, "groups"), "recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
