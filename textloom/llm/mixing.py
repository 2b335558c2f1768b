"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents are summed to cells (source, language, topic). Sweeps rescale the cells' token weights to each marginal's
targets in turn until no weight moves by more than `tolerance`. A document is drawn with the probability
min(1, c * weight / tokens of its cell), where c is calibrated so that the expected tokens meet the budget.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import joinable, materialise, table

DIMS, BROADCAST_ROWS, NONE, MISSED = ("source", "lang", "topic"), 100_000, "\0none", 0.001


def tokens_of(text):
    """Words of a text as its number of tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def topic_of(text):
    """A coarse topic from the form of a text: `long` from 4000 code points, `short` below 800, `prose` between."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n >= 4000, "long").when(n < 800, "short").otherwise("prose")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, target): shares of the tokens raised to a power, which lifts small values and lowers hot ones."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    shares = sums.select(F.col(dim), F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    return shares.crossJoin(F.broadcast(shares.agg(F.sum("p").alias("all")))).select(dim, (F.col("p") / F.col("all")).alias("target"))  # one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, sweeps: int = 50, strict: bool = False) -> DataFrame:
    """cells (a written table of dims and tokens) with `weight`, whose sums over each dim's values meet `targets` (shares of 1).

    A value without a target gets none of the weight; values that no cell has are left out and the others share theirs. If the
    cells cannot meet all targets together, so that a sum is off by more than MISSED at the end, a warning says so, or with
    `strict` ArithmeticError is raised. No cells stay no cells.
    """
    cells = materialise(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for dim, want in targets.items():
        want = want.toDF(dim, "target")
        present = want.join(cells.select(dim).distinct(), dim, "left_semi")
        targets = targets | {dim: materialise(present.crossJoin(F.broadcast(present.agg(F.sum("target").alias("all")))).select(dim, (F.col("target") / F.col("all")).alias(f"want_{dim}")), f"target-{dim}")}
    for _ in range(sweeps):
        now = cells.withColumn("before", F.col("weight"))
        for dim, want in targets.items():
            sums = now.groupBy(dim).agg(F.sum("weight").alias("sum")).join(want, dim, "left")
            ratio = sums.select(dim, F.when(F.col("sum") > 0, F.coalesce(f"want_{dim}", F.lit(0.0)) / F.col("sum")).otherwise(0.0).alias("ratio"))
            now = now.join(ratio, dim).withColumn("weight", F.col("weight") * F.col("ratio")).drop("ratio")
        now = materialise(now, "raked")
        moved = now.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0]
        cells = now.drop("before")
        if moved is None or moved <= tolerance:
            break
    gap = 0.0
    for dim, want in targets.items():
        sums = cells.groupBy(dim).agg(F.sum("weight").alias("sum")).join(want, dim, "left")
        gap = max(gap, sums.agg(F.max(F.abs(F.col("sum") - F.coalesce(f"want_{dim}", F.lit(0.0))))).first()[0] or 0.0)
    if gap > MISSED:
        if strict:
            raise ArithmeticError(f"a target is missed by {gap:.4f}: the cells cannot meet all of them")
        warnings.warn(f"a target is missed by {gap:.4f}", stacklevel=2)
    return cells


def calibrated(cells: DataFrame, share: float) -> DataFrame:
    """cells with `probability` = min(1, c * weight / tokens); expected tokens are `share` of all, or all that have weight."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = cells.withColumn("ratio", ratio)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    c, cut = 0.0, float("inf")
    while True:  # cells over 1 are taken whole and the others raised; the cut falls until none is over 1
        s = cells.agg(F.sum(F.when(F.col("ratio") >= cut, F.col("tokens"))).alias("whole"), F.sum(F.when(F.col("ratio") < cut, F.col("weight"))).alias("open")).first()
        c = max(0.0, share * total - (s["whole"] or 0)) / s["open"] if s["open"] else 0.0
        if not c or 1 / c >= cut:
            break
        if cells.filter((F.col("ratio") < cut) & (F.col("ratio") * c > 1)).isEmpty():
            break
        cut = 1 / c
    return cells.withColumn("probability", F.when(F.col("ratio") >= cut, 1.0).otherwise(F.least(F.lit(1.0), F.col("ratio") * c))).drop("ratio")


def mix_sources(docs: DataFrame, share: float = 0.8, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 17, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of docs and tokens, probability, sampled.

    Marginal targets are given as tables (value, target), whose columns may have any names, or come from tempering the
    corpus' own shares with `powers`; given ones have to be met. An empty table gives no rows, and an empty text has no tokens. Null
    sources and languages are a value of their own. A document without tokens stays: there is nothing to weigh. The draw
    depends on doc_id and seed alone, so rows that repeat a doc_id fall together within a cell. docs needs source and lang; topics come from
    the text's form unless docs has a column topic. Columns named tokens, probability or sampled raise ValueError.
    """
    if clash := {"tokens", "probability", "sampled"} & set(docs.columns):
        raise ValueError(f"clashing names: {sorted(clash)}")
    powers = powers or {"source": 0.7, "lang": 0.7, "topic": 0.9}
    key = {d: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) if d in docs.columns else topic_of(F.col(text)) for d in DIMS}
    rows = docs.withColumns({"tokens": tokens_of(F.col(text)), **{f"__{d}": k for d, k in key.items()}})
    cells = materialise(rows.groupBy(*(F.col(f"__{d}").alias(d) for d in DIMS)).agg(F.sum("tokens").alias("tokens")), "cells")
    want = {d: (targets or {}).get(d) or tempered(cells, d, powers[d]) for d in DIMS}
    odds = materialise(calibrated(rake(cells, want, strict=bool(targets)), share).select(*(F.col(d).alias(f"__{d}") for d in DIMS), "probability"), "odds")
    joined = rows.join(joinable(odds, odds.count(), BROADCAST_ROWS), [f"__{d}" for d in DIMS])
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    probability = F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("probability"))
    return joined.select(*docs.columns, "tokens", probability.alias("probability"), ((F.col("tokens") == 0) | (draw < probability)).alias("sampled"))


def op4_rake_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "tokens", F.round("probability", 6).alias("probability"), "sampled")
