"""The Merkle manifest against a tree built row by row."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from textloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, k string, node string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if lower and text is not None else text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(top, siblings and run with place of each node, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16))
        at = [i // 16 for i in at]
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        tops[s] = (mine, *tree([leaf_of(r) for r in mine]))
    root, above = tree([tops[s][1] for s in order])
    for s, upper in zip(order, above, strict=True):
        mine, subroot, paths = tops[s]
        for r, path in zip(mine, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h, others = leaf_of(r, tampered), ""
            for run, i in [*path, *upper]:
                others += "".join(run[:i] + run[i + 1 :])
                h = sha("".join([*run[:i], h, *run[i + 1 :]]))
            out.append((r[0], leaf_of(r), subroot, root, sha(others), h, h == root))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_manifest_equals_a_tree_built_row_by_row(spark):
    rng = random.Random(1)
    rows = [(i, f"Text {i} Ärger", "en", rng.choice(["hot", "hot", "b", "é", "", None]), 9) for i in rng.sample(range(-3000, 3000), 700)]
    rows += [(None, None, None, None, None), (None, "null id", "en", "hot", 7), (5000, "", "en", "hot", 0), (5001, None, "en", "hot", None), (5002, "L" * 300_000, "en", "only one", 300_000)]
    rows += [(7777, "Copy", "en", "hot", 4)] * 20 + [(7777, f"Same id {i}", "en", "hot", 9) for i in range(400)]
    check(spark, rows)


def test_small_manifests(spark):
    check(spark, [(1, "One", "en", "a", 3)])
    check(spark, [(1, "One", "en", None, 3), (2, "Two", "en", "a", 3)])
    check(spark, [(i, "x", "en", "a", 1) for i in range(17)])
    check(spark, [(3, "x", "en", f"s{i}", 1) for i in range(300)])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_shows(spark):
    rows = [(i, "Capital" if i % 2 else "none", "en", "a", 7) for i in range(60)]
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA)).collect()}
    assert {i for i, fine in got.items() if not fine} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0 and i % 2}


def test_ranks_need_no_large_bucket(spark):
    n = 3000
    rows = spark.range(n).select((F.col("id") * 7919 - 1_000_000).alias("doc_id"), F.lit("k").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(2).cast("long").alias("n"))
    got = merkle.ranked(rows, ["k"], merkle.id_digits(rows), [F.col("doc_id")], 8).orderBy("doc_id").select("rank").collect()
    assert [r[0] for r in got] == list(range(0, 2 * n, 2))


def test_many_copies_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 4)
    check(spark, [(1, "x", "en", "a", 1)] * 13 + [(0, "y", "en", "a", 1), (2, "z", "en", "a", 1)])
