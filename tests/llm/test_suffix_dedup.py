"""Suffix order against sorting, and removal of repeated strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import suffix_dedup
from textloom.llm.suffix_order import ONE_IN, repeated, suffix_order

SCHEMA = "doc_id long, text string, key long, seg string, runs int"


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    cases = [[], [1], [1] * 50, list(range(1, 40)), list(range(40, 0, -1)), [2, 1] * 30, [1, 2] * 30, [1, 1, 2] * 20]
    for _ in range(3000):
        cases.append([rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randint(1, 40))])
    for _ in range(30):
        part = [rng.randint(1, 3) for _ in range(9)]
        cases.append(part * 20 + [rng.randint(1, 3)] + part * 20)
    for s in cases:
        assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:]), s


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[p : p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, window, anchor, most=4096):
    docs = spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(docs, window, anchor, most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, window)


def sample(seed, n=60, unit=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(unit // 2, unit * 4)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.3 else text(rng.randint(1, unit * 3)) for _ in range(rng.randint(1, 6))]
        t = " ".join(parts)
        if rows and rng.random() < 0.3:  # a near copy
            t = list(rng.choice([r for r in rows if r[1]])[1])
            t[rng.randrange(len(t))] = "Z"
            t = "".join(t)
        rows.append((i, t))
    return rows


@pytest.mark.parametrize(("seed", "window", "anchor", "most"), [(1, 24, 8, 4096), (2, 60, 16, 4096), (3, 60, 16, 3), (4, 200, 32, 4096)])
def test_removal_equals_all_windows(spark, seed, window, anchor, most):
    rows = sample(seed, unit=window // 8)
    rows += [(100, None), (101, ""), (102, "short"), (None, rows[3][1] + " end"), (None, "x" * 900), (103, "ab" * 700 + "c" + "ab" * 300), (104, rows[5][1]), (104, rows[5][1])]
    rows += [(105, "q" * (window - 1)), (106, "\0" * (window + 3)), (107, "日本語の長い文" * 120)]
    check(spark, rows, window, anchor, most)


def test_hot_segments_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = word(150)  # shorter than a window: many different segments with one anchor
    rows = [(i, word(rng.randint(0, 120)) + passage + word(rng.randint(0, 200))) for i in range(150)]
    check(spark, rows, 200, 32, 20)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    long = word(30_000)
    found = [r for b in suffix_dedup._anchors(_batches([long, "tiny", long[500:9000] + "!"]), 200, 32) for r in b.to_pylist()]
    for row, text in enumerate([long, None, long[500:9000] + "!"]):
        covered = sorted((r["at"], r["at"] + r["n"]) for r in found if r["doc_id"] == row)
        if text is not None:  # every window is in one segment
            assert covered[0][0] == 0 and covered[-1][1] == len(text) - 199 and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def _batches(texts):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], names=["doc_id", "th", "text"])


def test_lengths_of_pieces_agree():
    rng = random.Random(9)
    shared = bytes(rng.choice(b"ab c") for _ in range(400))
    texts = [shared[i : i + 250] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for i in range(0, 150, 7)]
    starts = np.array([len(t) - 199 for t in texts])
    ones = np.ones(len(texts), np.int64)
    count = Counter(t[i : i + 200] for t, n in zip(texts, starts, strict=True) for i in range(n))
    want = [count[t[i : i + 200]] > 1 for t, n in zip(texts, starts, strict=True) for i in range(n)]
    for one_in in ONE_IN:
        assert repeated(texts, starts, ones, 200, one_in).tolist() == want


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
