"""Removal of byte strings that repeat anywhere in the corpus, by suffix order of the places where they may.

Of the 32-byte strings in a window of 200 bytes the one with the least hash is its anchor: equal windows have equal anchors.
Windows that follow one another mostly share an anchor, and their bytes are the anchor's segment (100 to 368 bytes). Segments
whose anchor occurs once in the corpus repeat nothing. All others meet by anchor, equal ones as one with a weight, and are put into
suffix order block by block (suffix_order.py), which shows the repeated windows. An anchor with more different segments than a
block should hold is settled window by window instead, by counting in a shuffle.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import materialise, partitions_for, release, slices, string_parts, table, tidy
from textloom.llm.suffix_order import ONE_IN, TRIGGER, longest_piece, repeated

WINDOW, ANCHOR = 200, 32
#: Bytes that a task hashes at once, bytes of a block, different segments of an anchor in one block, bytes of segments in a partition.
PIECE, BLOCK, MOST, PARTITION = 1 << 17, 1 << 19, 4096, 16 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        each = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.ones(size, np.uint64)
            k, step = 1, base
            while k < size:
                x[k : 2 * k] = x[:k] * np.uint64(step)
                k, step = 2 * k, step * step % (1 << 64)
            each.append(x)
        _powers[size] = (each[0], each[1])
    return _powers[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(first window, windows, anchor hash, hash of the bytes) of every segment of the texts that lie one after the other in data and end at `ends`."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(data) - window + 1
    if n <= 0:
        return none
    h, k = data.astype(np.uint64) + np.uint64(1), 1
    while k < anchor:  # anchor is a power of two
        h = h[:-k] * np.uint64(pow(BASE, k, 1 << 64)) + h[k:]
        k *= 2
    h = _mixed(h)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, k = window - anchor + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if width > k:
        least = np.minimum(least[: n], least[width - k : width - k + n])
    at = (least[:n] & low).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    whole = np.zeros(len(data) + 1, np.int32)
    fit = ends - starts >= window
    np.add.at(whole, starts[fit], 1)
    np.add.at(whole, ends[fit] - window + 1, -1)
    fine = np.cumsum(whole[:n]) > 0
    new = np.r_[True, (at[1:] != at[:-1]) | (fine[1:] != fine[:-1])]
    new[starts[starts < n]] = True
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], n]
    heads, tails = heads[fine[heads]], tails[fine[heads]]
    if not len(heads):
        return none
    up, down = powers(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]
    content = _mixed((sums[tails + window - 1] - sums[heads]) * down[heads])
    return heads, tails - heads, h[at[heads]], content


def _anchors(batches, window: int, anchor: int):
    """Rows (doc_id, th, key, seg, at, n) of the segments of each text."""
    for batch in batches:
        data, offsets = string_parts(batch.column(2))
        for a, b in slices(np.diff(offsets), PIECE):
            base, until = offsets[a], offsets[b]
            parts = [(base, until)] if until - base <= 2 * PIECE or b - a > 1 else [(x, min(until, x + PIECE + window - 1)) for x in range(base, max(base + 1, until - window + 1), PIECE)]
            for x, y in parts:
                rows = np.array([a]) if b - a == 1 else np.arange(a, b)
                ends = np.array([y - x]) if b - a == 1 else offsets[a + 1 : b + 1] - x
                head, n, key, seg = segments(data[x:y], ends, window, anchor)
                if len(head):
                    row = rows[np.searchsorted(ends, head, "right")]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(head + x - offsets[row]), pa.array(n)], names=["doc_id", "th", "key", "seg", "at", "n"])


def _cut(batches, window: int):
    """Texts of wanted segments: (key, seg, n, weight, text)."""
    last, made, size = None, [], 0
    kinds = {"key": pa.int64(), "seg": pa.int64(), "n": pa.int64(), "weight": pa.int64(), "text": pa.binary()}

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for batch in batches:
        wanted = batch.column(3)
        for i in range(len(batch)):
            name = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if name == last:  # an equal row
                continue
            last = name
            raw = batch.column(2)[i].as_buffer()
            for w in wanted[i].as_py():
                made.append((w["key"], w["seg"], w["n"], w["weight"], bytes(raw[w["at"] : w["at"] + w["n"] + window - 1])))
                size += len(made[-1][4])
                if size > 4 * BLOCK:
                    yield packed()
                    made, size = [], 0
    if made:
        yield packed()


def _judged(batches, window: int):
    """(key, seg, runs) of segments with repeated windows; runs: first and behind last, in turn. Rows come sorted by key."""
    held, size = [], 0

    def settle():
        if not held:
            return None
        keys, segs, n, weights, texts = zip(*held, strict=True)
        n, weights = np.array(n), np.array(weights)
        starts = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]]
        lens = np.array([len(t) for t in texts])
        data, names = np.frombuffer(b"".join(texts), np.uint8), np.array(keys)
        level = np.zeros(len(texts), np.int64)
        for k, one_in in enumerate(ONE_IN[:-1]):  # all segments of an anchor are cut alike
            long = longest_piece(data, starts, lens, one_in) > window - TRIGGER
            level[(level == k) & np.isin(names, names[long])] = k + 1
        rows = []
        for k, one_in in enumerate(ONE_IN):
            mine = np.flatnonzero(level == k)
            if not len(mine):
                continue
            found = repeated([texts[i] for i in mine], n[mine], weights[mine], window, one_in)
            ends = np.cumsum(n[mine])
            edge = np.flatnonzero(np.diff(np.r_[False, found, False].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                i = int(np.searchsorted(ends, a, "right"))
                while a < b:  # a run may go on in the next segment
                    base, until = int(ends[i] - n[mine[i]]), min(b, int(ends[i]))
                    rows.append((keys[mine[i]], segs[mine[i]], a - base, until - base))
                    a, i = until, i + 1
        held.clear()
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "seg", "first", "behind"])

    last = None
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[0] != last and size >= BLOCK:
                if (out := settle()) is not None:
                    yield out
                size = 0
            last = r[0]
            held.append(r)
            size += len(r[4])
    if (out := settle()) is not None:
        yield out


def _windows(batches, window: int):
    """Every window of segments with hot anchors: (a, b, weight, key, seg, first), where a and b are its hash."""
    for batch in batches:
        for key, seg, n, weight, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashes = np.frombuffer(b"".join(hashlib.blake2b(text[i : i + window], digest_size=16).digest() for i in range(n)), np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(pa.array(np.full(n, x, np.int64)) for x in (weight, key, seg)), pa.array(np.arange(n))], names=["a", "b", "weight", "key", "seg", "first"])


def _removed(batches, window: int):
    """(rows as they came, text, n_bytes, n_removed, n_spans, spans, kept_sha256): texts without what their runs of repeated windows cover."""
    for batch in batches:
        texts, runs = batch.column(0), batch.column(1)
        made = []
        for i in range(len(batch)):
            raw = texts[i].as_buffer()
            found = runs[i].as_py() or []
            spans: list[list[int]] = []
            for first, behind in sorted((r["first"], r["behind"]) for r in found):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], behind + window - 1)
                else:
                    spans.append([first, behind + window - 1])
            parts, at = [], 0
            for a, b in spans:
                parts.append(bytes(raw[at:a]))
                at = b
            kept = b"".join([*parts, bytes(raw[at : len(raw)])])
            made.append((kept, len(raw), sum(b - a for a, b in spans), len(spans), [x for s in spans for x in s], hashlib.sha256(kept).hexdigest()))
        for a, b in slices(np.array([len(m[0]) + 64 for m in made]), 16 << 20):
            kinds = (pa.large_binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*made[a:b], strict=True), kinds, strict=True)]
            columns[0] = columns[0].cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[2:]), *columns], names=[*batch.schema.names[2:], "kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans, spans (from and to, in turn), kept_sha256.

    A byte of a text in UTF-8 goes if a string of `window` bytes that covers it also starts elsewhere, in the same text or in any other; it
    is judged on the input. Null texts count as empty; texts shorter than a window stay whole. Rows that repeat one doc_id and text are
    occurrences of their own, so they lose all windows. A null doc_id is a name like any other. Spans may cut characters of several bytes, so
    what stays is binary. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if anchor & (anchor - 1) or not TRIGGER < anchor < window:
        raise ValueError("anchor must be a power of two between 8 and the window")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    kinds = "doc_id long, th long, key long, seg long, at long, n long"
    all_segments = materialise(texts.mapInArrow(lambda it: tidy(_anchors(it, window, anchor)), kinds), "segments")
    # a table of its own, so that the join can split an anchor with many segments
    often = materialise(all_segments.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "often")
    met = materialise(all_segments.join(often, "key"), "met")
    release(all_segments, often)
    distinct = materialise(met.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "th", "at", "n")).alias("one")), "distinct")
    n = distinct.count()
    hot = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most).select("key", F.lit(True).alias("hot"))
    asked = F.collect_list(F.struct(F.col("one.at").alias("at"), F.col("one.n").alias("n"), "key", "seg", "weight")).alias("wanted")
    wanted = distinct.groupBy(F.col("one.doc_id").alias("d"), F.col("one.th").alias("t")).agg(asked)
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "wanted")
    cut = materialise(found.mapInArrow(lambda it: tidy(_cut(it, window)), "key long, seg long, n long, weight long, text binary"), "cut")
    marked = cut.join(hot, "key", "left")
    parts = partitions_for(cut, n * (2 * window), PARTITION)
    ordered = marked.filter("hot IS NULL").drop("hot").repartition(parts, "key").sortWithinPartitions("key")
    runs = ordered.mapInArrow(lambda it: tidy(_judged(it, window)), "key long, seg long, first long, behind long")
    by_window = marked.filter("hot").select("key", "seg", "n", "weight", "text").mapInArrow(lambda it: _windows(it, window), "a long, b long, weight long, key long, seg long, first long")
    windows = materialise(by_window, "windows")
    twice = windows.groupBy("a", "b").agg(F.sum("weight").alias("w")).filter("w > 1").drop("w")
    hits = windows.join(twice, ["a", "b"]).select("key", "seg", "first", (F.col("first") + 1).alias("behind"))
    run = F.collect_list(F.struct("first", "behind")).alias("runs")
    marks = runs.unionByName(hits).groupBy("key", "seg").agg(run)
    placed = met.join(marks, ["key", "seg"]).select("doc_id", "th", F.transform("runs", lambda r: F.struct((r["first"] + F.col("at")).alias("first"), (r["behind"] + F.col("at")).alias("behind"))).alias("runs"))
    gone = materialise(placed.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.flatten(F.collect_set("runs")).alias("runs")), "gone")
    release(cut, windows, distinct, met)
    joined = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("text", "runs", "doc_id")
    return joined.mapInArrow(lambda it: tidy(_removed(it, window)), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: All windows by their text, in hexadecimal so that a byte is two characters.
OP12_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, {2 * WINDOW})) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {WINDOW - 1})) AS p FROM t WHERE len(x) >= {2 * WINDOW})),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + {WINDOW} AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list_concat([0], list(b ORDER BY a)) AS f, list(a ORDER BY a) AS u FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN f IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(f) + 1), lambda i: substring(x, 2 * f[i] + 1, 2 * (coalesce(u[i], len(x) // 2) - f[i]))), '') END)) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
