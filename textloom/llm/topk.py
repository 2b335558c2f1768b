"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are held in blocks; a block sorts one list per dimension. A query goes down all lists at once (from the top
where its weight is positive, from the bottom where it is negative) in growing steps, scores every vector it meets in
full, and stops when the sum of weight times the value reached cannot tie or beat its kth score. The kth score carries
over from block to block. Queries are sent out chunk by chunk: a chunk's broadcast is gone before the next one is made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import fresh_path, materialise, partitions_for, table

BLOCK_ROWS, QUERIES_PER_CHUNK, FIRST_DEPTH = 8192, 4096, 32


class Lists:
    """Sorted lists of one block: ids long[n], vectors long[n, d]."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").astype(np.int32)

    def top(self, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) among `best` and this block; ties go to the smaller id, the query's own id takes no part."""
        n, d = self.vectors.shape
        used = np.flatnonzero(query)
        flipped = query[used] < 0
        seen, depth, step = np.zeros(n, bool), 0, FIRST_DEPTH
        while depth < n:
            until = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[depth:until, used[~flipped]]] = True
            met[self.order[n - until : n - depth, used[flipped]]] = True
            if not len(used):
                met[:], until = True, n  # all scores are 0
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            depth, step = until, step * 2
            new = new[self.ids[new] != query_id]
            scores = self.vectors[new] @ query
            if len(best) == k:
                keep = scores >= -best[-1][0]
                new, scores = new[keep], scores[keep]
            if len(new):
                first = np.lexsort((self.ids[new], -scores))[:k]
                best = sorted([*best, *zip((-scores[first]).tolist(), self.ids[new[first]].tolist(), strict=True)])[:k]
            at = np.where(flipped, self.order[n - depth, used], self.order[depth - 1, used])
            if len(best) == k and int(query[used] @ self.vectors[at, used]) < -best[-1][0]:
                break
        return best


def usable(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, vec array<int>): floor(scale * x); drops vectors that are null or empty or hold null or non-finite components."""
    x = F.col(embedding)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0)).filter(fine).select(F.col(vec_id).alias("vec_id"), scaled.alias("vec"))


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best candidates of every query id.

    Candidates are all rows but those with the query's own id; only vectors of the query's length take part (others have
    no inner product with it). Fewer than k candidates give fewer rows; an empty table gives none. Repeated ids are
    candidates each; as queries they are one, with the smallest of their scaled vectors (compared from the first component
    on), and none of their rows is a candidate of it. A null id is no query and no candidate. Extra columns are ignored.
    """
    rows = materialise(usable(vectors, vec_id, embedding, scale).filter(F.col("vec_id").isNotNull()), "vectors")
    spark, n = rows.sparkSession, rows.count()
    queries = materialise(rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    chunks = max(1, math.ceil(queries.count() / QUERIES_PER_CHUNK))
    spread = rows.coalesce(partitions_for(rows, n, BLOCK_ROWS * 4))
    folder, kinds = fresh_path(spark, "hits"), "query_id long, score long, vec_id long"
    for c in range(chunks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()  # about QUERIES_PER_CHUNK rows
        sent = spark.sparkContext.broadcast([(r[0], np.array(r[1], np.int64)) for r in part])
        spread.mapInArrow(lambda it, sent=sent: _search(it, sent.value, k), kinds).write.parquet(f"{folder}/chunk={c}")
        sent.destroy()
    found = spark.read.schema(kinds).parquet(folder)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id").alias("vec_id")))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def _blocks(batches):
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lens = np.diff(np.asarray(vecs.offsets))
        flat, starts = np.asarray(vecs.values), np.asarray(vecs.offsets)[:-1]
        for d in np.unique(lens):
            which = np.flatnonzero(lens == d)
            for i in range(0, len(which), BLOCK_ROWS):
                w = which[i : i + BLOCK_ROWS]
                a, b = held.setdefault(int(d), ([], []))
                a.append(ids[w])
                b.append(flat[starts[w][:, None] + np.arange(d)])
                if sum(map(len, a)) >= BLOCK_ROWS:
                    yield np.concatenate(a), np.concatenate(b)
                    del held[int(d)]
    for a, b in held.values():
        yield np.concatenate(a), np.concatenate(b)


def _search(batches, queries: list[tuple[int, np.ndarray]], k: int):
    best: list[list] = [[] for _ in queries]
    for ids, vectors in _blocks(batches):
        block = Lists(ids, vectors.astype(np.int64))
        for i, (q, query) in enumerate(queries):
            if len(query) == vectors.shape[1]:
                best[i] = block.top(q, query, k, best[i])
    rows = [(q, -m, v) for (q, _), hits in zip(queries, best, strict=True) for m, v in hits]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query_id", "score", "vec_id"])


def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP8_SQL = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
