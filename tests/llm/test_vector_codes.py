"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from textloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vec int"


def brute(rows, entries=256):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    books = [[r[1][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(4)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(v, p):
        return min((apart(v[p * width : (p + 1) * width], c), j) for j, c in enumerate(books[p]))

    for _ in range(4):
        new = []
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(assign(v, p)[1], []).append(v[p * width : (p + 1) * width])
            new.append([[sum(x) // len(x) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in kept:
        found = [assign(v, p) for p in range(4)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return sorted(out, key=repr), books


def rows_of(seed, n, d=8):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=d).astype(np.float32)], int(rng.integers(3)) if rng.random() < 0.9 else None) for i in rng.permutation(n)]
    rows += [(i + n, list(rows[i][1]), 1) for i in range(10)]  # repeated vectors: ties
    return [*rows, (3, [0.5] * d, None), (None, [0.25] * d, 0), (n + 50, None, 1), (n + 51, [float("nan")] * d, 1), (n + 52, [float("inf")] * d, 1), (n + 53, [None, *[1.0] * (d - 1)], 2), (n + 54, [], 0)]


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_plain_arithmetic(spark, entries):
    rows = rows_of(entries, 60)
    coded, books = vector_codes.compress(spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3), entries=entries)
    want, want_books = brute(rows, entries)
    assert sorted(map(tuple, coded.collect()), key=repr) == want
    assert [b.tolist() for b in books] == want_books


def test_query_sums_errors_by_label(spark, tmp_path):
    rows = rows_of(3, 40)
    spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()), key=repr)
    want, books = brute(rows)
    total = {}
    for _, label, _, e in want:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    assert got == sorted([(i, code, e, total[label], digest) for i, label, code, e in want], key=repr)


def test_screening_keeps_every_nearest_entry():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 2**24):
        book = rng.integers(-scale, scale + 1, (200, 16))
        book[150:] = book[:50]  # equal entries: the smaller index
        near = book[rng.integers(200, size=300)] + rng.integers(-1, 2, (300, 16))  # midpoints and near ties
        rows = np.concatenate([near, (book[:100] + book[100:]) // 2])
        index, distance = vector_codes.nearest(rows, book)
        exact = ((rows[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_what_takes_no_part(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(empty)[0].collect() == []
    other = [(1, [1.0] * 8, 0, "", 0), (2, [1.0] * 4, 0, "", 0)]
    assert [r[0] for r in vector_codes.compress(spark.createDataFrame(other, SCHEMA))[0].collect()] == [1]
    for bad in ([1.0] * 6, [40_000.0] * 4):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame([(1, bad, 0, "", 0)], SCHEMA))
