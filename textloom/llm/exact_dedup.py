"""Exact duplicates with a heavy-hitter split, in DataFrame operations alone.

Misra-Gries summaries of fixed-size chunks of rows are merged into at most `k` candidate digests; every digest
with more than rows / (k + 1) copies is among them. The candidates' winners are counted and chosen by map-side
aggregation and broadcast (at most k rows), so hot groups never meet in one task. All other digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.shared import materialise, table


def _pruned(items, k: int):
    """Misra-Gries prune of an array<struct<n, key>>: subtract the (k+1)th largest count, keep what stays positive."""
    top = F.slice(F.sort_array(items, asc=False), 1, k + 1)

    def lowered(top, least):
        return F.filter(F.transform(top, lambda x: F.struct((x["n"] - least).alias("n"), x["key"].alias("key"))), lambda x: x["n"] > 0)

    # each array of one element binds a value, so that it is computed once and not for every entry
    pruned = lambda top: F.get(F.transform(F.array(F.when(F.size(top) > k, F.element_at(top, -1)["n"]).otherwise(F.lit(0))), lambda least: lowered(top, least)), F.lit(0))
    return F.get(F.transform(F.array(top), pruned), F.lit(0))


def frequent_keys(rows: DataFrame, key: str, k: int, chunk_bits: int = 16) -> DataFrame:
    """At most k rows (key, n): a merged Misra-Gries summary; holds every key with more than rows / (k + 1) rows."""
    counted = rows.select(F.col(key).alias("key"), F.shiftright(F.monotonically_increasing_id(), chunk_bits).alias("chunk")).groupBy("chunk", "key").agg(F.count(F.lit(1)).alias("n"))
    chunks = counted.groupBy("chunk").agg(F.collect_list(F.struct("n", "key")).alias("items"))
    merged = chunks.select(F.inline(_pruned(F.col("items"), k))).groupBy("key").agg(F.sum("n").alias("n"))
    top = merged.orderBy(F.desc("n"), "key").limit(k + 1).agg(F.collect_list(F.struct("n", "key")).alias("items"))
    return top.select(F.inline(_pruned(F.col("items"), k)))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_code_points, digest): SHA-256 of the text without `[\\x20\\x09-\\x0D]`; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.length(whole).cast("long").alias("n_code_points"), F.unhex(F.sha2(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, k: int = 256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (white space aside) the longest original stays, then the smallest doc_id. Null and empty texts are
    equal to each other; a null doc_id loses to any other; rows that repeat one doc_id and text are kept or dropped together.
    Other columns of docs are ignored, whatever their names. An empty table gives no rows.
    """
    rows = materialise(digests(docs, text, doc_id), "digests").withColumn("key", F.xxhash64("digest"))
    best = F.max(F.struct("n_code_points", (-F.col("doc_id")).alias("minus_id")))
    heavy = frequent_keys(rows, "key", k).select("key")  # at most k rows
    winners = materialise(rows.join(F.broadcast(heavy), "key").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    by = W.partitionBy("digest")
    rest = marked.filter(F.col("group_size").isNull()).drop("group_size", "best").withColumns({"group_size": F.count(F.lit(1)).over(by), "best": best.over(by)})
    both = marked.filter(F.col("group_size").isNotNull()).unionByName(rest)
    keep = -F.col("best.minus_id")
    return both.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
