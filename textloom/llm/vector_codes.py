"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry, in exact integers.

A task screens a block of parts by one float32 matrix product. The rounding error of such a product has a bound that holds for
any order of its sums, so every squared distance is known to lie in an interval; the entries whose interval reaches the best
upper end are computed again in int64, and equal distances go to the smaller index. Only sums by entry (entries x dimensions
numbers) leave the tasks in a round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import materialise, table

PARTS, ENTRIES, ROUNDS, SCALE, SLICE = 4, 256, 4, 1024, 2048
#: Components below it keep the squared distances of 2^11 of them in int64.
LARGEST = 2**25
#: Unit roundoff of float32.
ROUNDOFF = 2.0**-24


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of int64 rows[n, d] against book[m, d]; ties go to the smaller index."""
    n, d = rows.shape
    if not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # |fl(x.c) - x.c| <= g |x||c|: d roundings of products and sums, and one of each factor
    g = (d + 2) * ROUNDOFF / (1 - (d + 2) * ROUNDOFF)
    norms, entry_norms = (np.sqrt((a.astype(np.float64) ** 2).sum(1)) for a in (rows, book))
    dots = (rows.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    middle = entry_norms**2 - 2 * dots
    # the last term covers what float64 rounds in these lines
    radius = (2 * g * norms)[:, None] * entry_norms * (1 + 1e-9) + 1e-13 * (np.abs(middle) + (entry_norms**2)[None, :])
    best = (middle + radius).min(1)
    i, j = np.nonzero(middle - radius <= best[:, None])
    exact = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 16):
        at = slice(a, a + (1 << 16))
        apart = rows[i[at]] - book[j[at]]
        exact[at] = (apart * apart).sum(1)
    order = np.lexsort((j, exact, i))
    first = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(order) else order
    return j[first], exact[first]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, vec array<long>): floor(1024 * x); without vectors that are null or empty or hold null or non-finite components."""
    x = F.col(embedding)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    kept = vectors.filter(x.isNotNull() & (F.size(x) > 0)).filter(fine)
    return kept.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("long")).alias("vec"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(flat) // d, d)


def _coded(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes[n, parts], summed squared distances[n])."""
    width = vectors.shape[1] // len(books)
    found = [nearest(vectors[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.sum([f[1] for f in found], axis=0)


def _sums(batches, books: list[np.ndarray], d: int):
    """(part, entry, n, sums) of a partition, one row for each entry that is used."""
    width = d // len(books)
    n = [np.zeros(len(b), np.int64) for b in books]
    sums = [np.zeros((len(b), width), np.int64) for b in books]
    for batch in batches:
        vectors = _matrix(batch.column("vec"), d)
        for a in range(0, len(vectors), SLICE):
            codes = _coded(vectors[a : a + SLICE], books)[0]
            for p in range(len(books)):
                np.add.at(sums[p], codes[:, p], vectors[a : a + SLICE, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=len(n[p]))
    for p in range(len(books)):
        used = np.flatnonzero(n[p])
        if len(used):
            yield pa.RecordBatch.from_pydict({"part": np.full(len(used), p), "entry": used, "n": n[p][used], "sums": pa.array(list(sums[p][used]), pa.list_(pa.int64()))})


def _assigned(batches, books: list[np.ndarray], d: int):
    for batch in batches:
        vectors = _matrix(batch.column("vec"), d)
        for a in range(0, len(vectors), SLICE):
            codes, errors = _coded(vectors[a : a + SLICE], books)
            part = batch.slice(a, SLICE)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([bytes(c).hex() for c in codes.astype(np.uint8)]), pa.array(errors)], names=["vec_id", "label", "code", "error"])


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of every vector that takes part, the codebooks as int64[entries, width] by part).

    Null or empty vectors and those with null or non-finite components take no part, nor do those of another length than the
    first vector's (the smallest vec_id, then the smallest vector; null ids come last), which has to be a multiple of `parts`. A codebook
    starts with its parts of the `entries` first vectors, fewer if there are fewer; at most 256. Repeated ids and vectors are
    rows of their own; extra columns are ignored. An empty table gives no rows and empty codebooks. Components of 2^15 or more (2^25 when scaled)
    raise an error, as their squares would not fit into 64 bits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = materialise(usable(vectors, vec_id, embedding, label), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(1).collect()
    if not first:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, [np.zeros((0, 0), np.int64) for _ in range(parts)]
    d = len(first[0]["vec"])
    if d % parts:
        raise ValueError(f"vectors of {d} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("vec") == d)
    if rows.select(F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))).first()[0] >= LARGEST or d // parts > 2**11:
        raise ValueError("components of 2^15 or more, or parts of more than 2048 components")
    seeds = np.array([r["vec"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()], np.int64)  # `entries` rows
    books = [np.ascontiguousarray(x) for x in np.split(seeds, parts, axis=1)]
    for _ in range(rounds):
        sums = rows.select("vec").mapInArrow(lambda it, books=books: _sums(it, books, d), "part long, entry long, n long, sums array<long>")
        by_place = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "x"))
        means = by_place.groupBy("part", "entry", "pos").agg(F.floor(F.sum("x") / F.sum("n")).alias("rough"), F.sum("x").alias("x"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in means.collect():  # at most entries x dimensions rows
            books[r["part"]][r["entry"], r["pos"]] = r["x"] // r["n"]
    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return rows.mapInArrow(lambda it: _assigned(it, books, d), kinds), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = materialise(coded, "codes")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    labels = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """The rounds as plain SQL over all entries; for vectors of one length and distinct ids."""
    apart = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, v, min(d) AS d, CAST(arg_min(entry, d * {ENTRIES} + entry) AS BIGINT) AS entry
  FROM (SELECT vec_id, part, v, entry, CAST({apart} AS BIGINT) AS d FROM p JOIN b{r} USING (part)) GROUP BY vec_id, part, v)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM (
  SELECT part, entry, i, CAST(sum(v[i]) // count(*) - CASE WHEN sum(v[i]) < 0 AND sum(v[i]) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS x
  FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry)""")
            steps.append(f"b{r + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""
WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, vec[part * (len(vec) // {PARTS}) + 1 : (part + 1) * (len(vec) // {PARTS})] AS v FROM t, range({PARTS}) r(part)),
b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM t ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(steps)},
e AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN t USING (vec_id), s
"""


OP13_SQL = _op13_sql()
