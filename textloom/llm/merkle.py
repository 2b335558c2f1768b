"""A Merkle manifest of a dataset: one leaf a document, a tree for every source, and one above the sources.

No row is sorted globally. Rank of a row in its group: histograms of its key's leading digits, one level below the other, say
how many rows of the group lie before the row's bucket (siblings below one parent, of which there are at most 4096, are summed), and a bucket
holds so few rows that it is ordered by itself. The digits of the rank in the base of the fanout are the path in the trie: all
but the last digit name a node's parent, so a level is reduced by that prefix, and the levels get smaller by the fanout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.shared import materialise, release, table

FANOUT, BUCKET_ROWS, DIGIT_BITS, COPIES = 16, 256, 12, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes in UTF-8, `:` and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(k, doc_id, leaf, changed, n) of distinct rows: k orders sources (null first, then by bytes), changed is the leaf after tampering, n the number of equal rows."""
    row = lambda text: hashed(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", UPPER, LOWER)
    marked = docs.select(F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), "source")).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), row(F.col("text")).alias("leaf"), F.when(tampered & (lowered != F.col("text")), row(lowered)).alias("changed"))
    return marked.groupBy("k", "doc_id", "leaf", "changed").agg(F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, group: list[str], digits: list[Column], order: list, most: int = BUCKET_ROWS) -> DataFrame:
    """rows(.., n) with `rank`: the sum of n of the rows before each in its group, from hierarchical histograms of `digits`.

    Digits, the most significant first, must agree with `order`; as many of them are used as leave at most `most` rows in a bucket.
    """
    for depth in range(len(digits) + 1):
        names = [f"__d{i}" for i in range(depth)]
        keyed = rows.withColumns(dict(zip(names, digits, strict=False))) if names else rows
        finest = keyed.groupBy(*group, *names).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        if depth == len(digits):
            break
        if (finest.agg(F.max("rows")).first()[0] or 0) <= most:
            break
    levels = [finest.drop("rows")]
    for i in range(depth - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*group, *names[:i]).agg(F.sum("n").alias("n")))
    before = None
    for i in range(depth):
        parents = [*group, *names[:i]]
        smaller = F.sum("n").over(W.partitionBy(*(parents or [F.lit(0)])).orderBy(names[i]).rowsBetween(W.unboundedPreceding, -1))
        level = levels[i].select(*parents, names[i], F.coalesce(smaller, F.lit(0)).alias("below"))
        if before is not None:
            level = joined(level, before, parents).select(*parents, names[i], (F.col("below") + F.col("above")).alias("below"))
        before = level.withColumnRenamed("below", "above")
    inside = F.sum("n").over(W.partitionBy(*([*group, *names] or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = keyed.withColumn("rank", F.coalesce(inside, F.lit(0)))
    if before is not None:
        placed = joined(placed, before, [*group, *names]).withColumn("rank", F.col("rank") + F.col("above")).drop("above")
    return placed.drop(*names)


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys that may be null."""
    b = b.withColumnsRenamed({k: f"{k}__" for k in keys})
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys], how).drop(*(f"{k}__" for k in keys))


def id_digits(rows: DataFrame) -> list[Column]:
    """Leading digits of doc_id as far as its range needs them, then of the leaf (for repeated ids): shifts keep the order of signed numbers."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    bits = 0 if low is None else (64 if (low < 0) != (high < 0) else (low ^ high).bit_length())
    shifts = range(max(0, bits - DIGIT_BITS), -DIGIT_BITS, -DIGIT_BITS)
    of_leaf = [F.conv(F.substring("leaf", a, 3), 16, 10).cast("long") for a in (1, 4, 7, 10)]
    return [F.shiftright("doc_id", max(0, s)) for s in shifts] + of_leaf


def source_digits(longest: int) -> list[Column]:
    return [F.hex(F.substring("k", 1 + i, 1).cast("binary")) for i in range(longest)]


def expanded(rows: DataFrame) -> DataFrame:
    """A row for each of n equal rows; many copies are dealt out in blocks before."""
    many = (rows.agg(F.max("n")).first()[0] or 0) > COPIES
    blocks = rows.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))) if many else rows.withColumn("__b", F.lit(0).cast("long"))
    blocks = blocks.repartition("k", "leaf", "__b") if many else blocks
    first = F.col("__b") * COPIES
    return blocks.withColumn("__i", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1))).withColumn("rank", F.col("rank") + F.col("__i")).drop("__b", "__i", "n")


STEPS = "array<struct<digit:int,members:array<string>>>"


def _trie(runs: DataFrame, group: list[str], most: int, tag: str) -> tuple[DataFrame, DataFrame | None]:
    """(tops(group, node), steps(group, at, steps) of the lowest runs if there are higher ones) of runs(group, at, members).

    runs holds, for every group, its nodes by runs of FANOUT; `most` is the number of nodes of the largest group. A run of one at place 0 is
    a group that has come down to one node, which is its top. A step is a run on the way up and the place in it.
    """
    tops, levels = [], []
    lone = (F.col("at") == 0) & (F.size("members") == 1)
    while most > 1:
        tops.append(runs.filter(lone).select(*group, F.get("members", F.lit(0)).alias("node")))
        nodes = runs.filter(~lone).select(*group, "at", hashed(F.array_join("members", "")).alias("node"))
        runs = materialise(in_runs(nodes, group), f"{tag}-level")
        levels.append(runs.filter(~lone))
        most = -(-most // FANOUT)
    tops.append(runs.select(*group, F.get("members", F.lit(0)).alias("node")))
    above = None
    for level in reversed(levels):
        each = level.select(*group, F.col("at").alias("__at"), "members", F.explode(F.sequence(F.lit(0), F.size("members") - 1)).alias("digit"))
        step = F.array(F.struct("digit", "members"))
        if above is not None:
            each = joined(each, above.withColumnRenamed("at", "__at"), [*group, "__at"], "left")
            step = F.concat(step, F.coalesce("steps", F.array().cast(STEPS)))
        above = materialise(each.select(*group, (F.col("__at") * FANOUT + F.col("digit")).alias("at"), step.cast(STEPS).alias("steps")), f"{tag}-steps")
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return out, above


def in_runs(nodes: DataFrame, group: list[str], *more: str) -> DataFrame:
    """nodes(group, at, node, more..) as runs (group, at, members[, rows]): FANOUT consecutive places each, in order."""
    rows = F.sort_array(F.collect_list(F.struct("at", "node", *more)))
    runs = nodes.groupBy(*group, F.floor(F.col("at") / FANOUT).alias("__run")).agg(rows.alias("rows")).withColumnRenamed("__run", "at")
    runs = runs.withColumn("members", F.transform("rows", lambda x: x["node"]))
    return runs if more else runs.drop("rows")


def siblings(steps: Column) -> Column:
    """All other members of the runs on a path, from the lowest run up, left to right."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: F.filter(s["members"], lambda m, i: i != s["digit"]))), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The top that a leaf leads to if it stands in its place on the path."""
    put = lambda h, s: F.array_join(F.transform(s["members"], lambda m, i: F.when(i == s["digit"], h).otherwise(m)), "")
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(put(h, s).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text (nulls are `-`); a source's leaves ascend by doc_id (null first), equal ids
    by leaf. Runs of 16 nodes become their hash until one is left: the source's subroot; the subroots, by source (null first), give the
    root. The proof are the other members of each run from the leaf to the root. Equal rows are leaves of their own. A document whose id
    has a CRC-32 divisible by 5 is tampered with (its text in lower case), and its proof then leads to another root, unless the text had
    no capital. Null and empty texts differ. Other columns are ignored. An empty table gives no rows.
    """
    rows = materialise(leaves(docs), "leaves")
    placed = expanded(ranked(rows, ["k"], id_digits(rows), [F.col("doc_id"), F.col("leaf")])).withColumnsRenamed({"rank": "at", "leaf": "node"})
    runs = materialise(in_runs(placed, ["k"], "doc_id", "changed"), "runs")
    release(rows)
    most = runs.groupBy("k").agg(F.sum(F.size("members")).alias("n")).agg(F.max("n")).first()[0] or 0
    tops, steps = _trie(runs.drop("rows"), ["k"], most, "source")
    tops = materialise(tops, "subroots")
    n, longest = tops.agg(F.count(F.lit(1)), F.max(F.octet_length("k"))).first()
    order = ranked(tops.withColumn("n", F.lit(1).cast("long")), [], source_digits(longest or 0), [F.col("k")]).drop("n").withColumnRenamed("rank", "at")
    upper = materialise(in_runs(order, [], "k"), "sources")
    top, above = _trie(upper.drop("rows"), [], n, "corpus")
    sources = _on_path(upper, above, []).select(F.col("row.k").alias("k"), F.col("row.node").alias("subroot"), F.col("steps").alias("above"))
    sources = materialise(sources.crossJoin(F.broadcast(top.withColumnRenamed("node", "root"))), "sources")  # top: one row, or none
    proven = _on_path(runs, steps, ["k"], sources).withColumn("path", F.concat("steps", "above"))
    leaf = F.col("row.node").alias("leaf")
    judged = proven.select("row.doc_id", leaf, "subroot", "root", hashed(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("row.changed", "row.node"), F.col("path")).alias("folded_root"))
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))


def _on_path(runs: DataFrame, above: DataFrame | None, group: list[str], more: DataFrame | None = None) -> DataFrame:
    """runs(.., rows) joined with the steps above them (and with more by the group) while they are few, then a row for each of `rows` with its own step put first."""
    runs = runs.withColumn("steps", F.array().cast(STEPS)) if above is None else joined(runs, above, [*group, "at"], "left")
    runs = runs if more is None else joined(runs, more, group)
    each = runs.select("*", F.posexplode("rows").alias("digit", "row")).drop("rows")
    own = F.when((F.col("at") == 0) & (F.size("members") == 1), F.array().cast(STEPS)).otherwise(F.array(F.struct("digit", "members")).cast(STEPS))
    return each.withColumn("steps", F.concat(own, F.coalesce("steps", F.array().cast(STEPS))))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: CRC-32 bit by bit: each byte is put in with eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"""


def _op11_sql(levels: int = 6) -> str:
    """A tree of fixed depth, in which a group with one node keeps it; for distinct ids and up to 16^levels documents a source."""
    put = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    row = lambda text: "sha256(" + " || ".join(put(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps, path, fold = [], [], []
    for side, key in (("d", "k"), ("s", "one")):
        for i in range(levels):
            steps.append(f"""{side}g{i} AS (SELECT {key}, r // 16 AS r, list(h ORDER BY r) AS hs, (SELECT count(*) FROM {side}{i} y WHERE y.{key} = x.{key}) AS n FROM {side}{i} x GROUP BY {key}, r // 16),
{side}{i + 1} AS (SELECT {key}, r, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {side}g{i})""")
        if side == "d":
            steps.append(f"s0 AS (SELECT 0 AS one, k, row_number() OVER (ORDER BY k) - 1 AS r, h FROM d{levels})")
    names = [(side, i) for side in "ds" for i in range(levels)]
    for side, i in names:
        at = f"{side}.r // {16**i}"
        path.append(f"CASE WHEN {side}{i}.n = 1 THEN '' ELSE array_to_string(list_concat({side}{i}.hs[: ({at}) % 16], {side}{i}.hs[({at}) % 16 + 2 :]), '') END")
    joins = " ".join(f"JOIN {side}g{i} {side}{i} ON {side}{i}.{'k' if side == 'd' else 'one'} = {side}.{'k' if side == 'd' else 'one'} AND {side}{i}.r = {side}.r // {16 ** (i + 1)}" for side, i in names)
    for j, (side, i) in enumerate(names):
        at = f"(r{side} // {16**i}) % 16"
        fold.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN n_{side}{i} = 1 THEN h ELSE sha256(array_to_string(list_concat(list_append(hs_{side}{i}[: {at}], h), hs_{side}{i}[{at} + 2 :]), '')) END AS h) FROM f{j})")
    columns = ", ".join(f"{side}{i}.n AS n_{side}{i}, {side}{i}.hs AS hs_{side}{i}" for side, i in names)
    return f"""
WITH t AS (SELECT *, {row("text")} AS leaf, coalesce('+' || source, '') AS k, {_CRC} % 5 = 0 AS tampered, {row("translate(text, '" + UPPER + "', '" + LOWER + "')")} AS lowered FROM documents),
d0 AS (SELECT k, doc_id, leaf AS h, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS r FROM t),
{", ".join(steps)},
f0 AS (SELECT d.doc_id, d.r AS rd, s.r AS rs, s.h AS subroot, CASE WHEN t.tampered THEN t.lowered ELSE d.h END AS h, d.h AS leaf, sha256({" || ".join(path)}) AS proof_sha256, {columns}
  FROM d0 d JOIN t ON t.doc_id = d.doc_id JOIN s0 s ON s.k = d.k {joins}),
{", ".join(fold)}
SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM f{len(names)}, (SELECT h AS root FROM s{levels})
"""


OP11_SQL = _op11_sql()
