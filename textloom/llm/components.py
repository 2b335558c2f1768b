"""Connected components by alternating large-star and small-star steps, with written tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import materialise, release


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node that can be reached. Null ends are ignored."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, _print(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, materialise(small, "small-star")
        release(old, large)
        before, now = now, _print(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def extend(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of components that links(a, b) join; roots: those found before, or None."""
    if roots is None:
        return materialise(components(links), "roots")
    root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    over = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = components(over).withColumnRenamed("root", "top")
    old = roots.join(more.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(roots, "node", "left_anti").select("node", F.col("top").alias("root"))
    return materialise(old.unionByName(new), "roots")


SMALL_BAND, LEADER_ROUNDS, BLOCK = 24, 2, 128


class Linker:
    """Components of nodes that share bands, without all-pairs lists.

    bands(band, node, size, mark): members of bands with at least two; near(mark, mark) drops pairs before anything is
    shuffled (both optional). verify(pairs(a, b)) returns the linked pairs.
    link_block(left, right, find, band, minor) yields the places of linked rows of two lists of (node, root, *details); pairs
    whose roots find() already gives one component may be left out, and so may one order of a pair whose right row is minor, as
    that row stands on the left elsewhere, and pairs that another shared band compares. details(node, ...) holds the columns
    that it needs.
    First each band's members are compared with one leader; then only members that the links so far leave in other
    components are compared further: small bands in full, large ones with new leaders and at last block by block.
    """

    def __init__(self, bands: DataFrame, verify, link_block, details: DataFrame, near=None):
        if near is None:
            bands = bands.withColumn("mark", F.lit(0))
        self.near = near or (lambda x, y: F.lit(True))
        self.bands, self.verify, self.link_block, self.details = bands, verify, link_block, details
        self.tested, self.roots, self.scrap = None, None, []

    def labelled(self) -> DataFrame:
        """(band, node, root, size) of the bands that hold more than one component."""
        if self.roots is None:
            return self.bands.withColumn("root", F.col("node"))
        rows = self.bands.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = rows.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("band")
        self.scrap.append(materialise(rows.join(open_, "band"), "open-bands"))
        return self.scrap[-1]

    def test(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        links = materialise(self.verify(pairs).select("a", "b"), "links")
        self.scrap += [pairs, links]
        if links.take(1):
            self._join(links)

    def _join(self, links: DataFrame) -> None:
        before, self.roots = self.roots, extend(self.roots, links)
        if before is not None:
            release(before)

    def _leaders(self, rows: DataFrame, seed: int) -> DataFrame:
        first = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("leader"), F.col("root").alias("led"), F.col("mark").alias("led_mark"))).alias("l")).select("band", "l.leader", "l.led", "l.led_mark")
        return rows.join(first, "band").filter("root <> led").filter(self.near(F.col("mark"), F.col("led_mark"))).select(F.col("leader").alias("a"), F.col("node").alias("b"))

    def run(self) -> DataFrame | None:
        """(node, root) of all linked nodes, or None if there are no links. What else was written is removed."""
        roots = self._run()
        release(*self.scrap)
        return roots

    def _run(self) -> DataFrame | None:
        self.test(self._leaders(self.labelled(), 0))
        for seed in range(1, LEADER_ROUNDS + 1):
            rows = self.labelled()
            few, many = rows.filter(F.col("size") <= SMALL_BAND), rows.filter(F.col("size") > SMALL_BAND)
            x = few.select("band", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("mark").alias("ma"))
            y = few.select("band", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("mark").alias("mb"))
            within = x.join(y, "band").filter("a < b AND ra <> rb").filter(self.near(F.col("ma"), F.col("mb"))).select("a", "b")  # at most SMALL_BAND partners a row
            last = not many.take(1)
            self.test(within if last else within.unionByName(self._leaders(many, seed)))
            if last:
                return self.roots
        self._blocks(self.labelled().filter(F.col("size") > SMALL_BAND))
        return self.roots

    def _blocks(self, rows: DataFrame) -> None:
        """What is still open in large bands: members outside a band's largest component against all members, block by block.

        A block links its own members in full and returns a spanning forest, at most one link for each of its members.
        """
        if not rows.take(1):
            return
        sizes = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all")).select("band", F.col("m.root").alias("main"), F.col("all"), (F.col("all") - F.col("m.n")).alias("minor"))
        rows = materialise(rows.select("band", "node", "root").join(main, "band"), "open-members")
        count = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
        own = lambda c: F.pmod(F.xxhash64("node"), count(c)).cast("int")
        minor = rows.filter("root <> main").select("band", "node", "root", F.lit(True).alias("left"), F.lit(True).alias("minor_row"), own("minor").alias("x"), F.explode(F.sequence(F.lit(0), count("all") - 1)).alias("y"))
        whole = rows.select("band", "node", "root", F.lit(False).alias("left"), (F.col("root") != F.col("main")).alias("minor_row"), F.explode(F.sequence(F.lit(0), count("minor") - 1)).alias("x"), own("all").alias("y"))
        more, link = [c for c in self.details.columns if c != "node"], self.link_block
        dealt = minor.unionByName(whole).join(self.details, "node")

        def block(pdf):
            import pandas as pd

            part = lambda flag: list(pdf.loc[pdf["left"] == flag, ["node", "root", *more]].itertuples(index=False, name=None))
            left, right = part(True), part(False)
            top = {r: r for _, r, *_ in left + right}

            def find(r):
                while top[r] != r:
                    top[r] = top[top[r]]
                    r = top[r]
                return r

            out = []
            for i, j in link(left, right, find, pdf["band"].iloc[0], pdf.loc[~pdf["left"], "minor_row"].to_numpy(bool)):
                a, b = find(left[i][1]), find(right[j][1])
                if a != b:
                    top[a] = b
                    out.append((left[i][0], right[j][0]))
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        links = materialise(dealt.groupBy("band", "x", "y").applyInPandas(block, "a long, b long"), "links")
        self.scrap += [rows, links]
        if links.take(1):
            self._join(links)
