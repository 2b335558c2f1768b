"""Relating documents: embeddings, topics, clusters, the similarity graph and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.blocks import BLOCK, products
from textloom.operators.export import numbered
from textloom.operators.terms import counted, fit_embedding, fit_topics, term_counts
from textloom.tables import materialise, release

#: Similarity above which documents are related, cosine distance up to which clusters merge, words of a topic.
EDGE_ABOVE, MERGE_UP_TO, TOPIC_WORDS, CENTRAL = 0.5, 0.5, 9, 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity_edges(vectors: DataFrame, node: str, vector: str, above: float = EDGE_ABOVE, block: int = BLOCK) -> DataFrame:
    """(source, target, similarity) of all pairs source < target whose dot product exceeds `above`.

    Two blocks of vectors meet in one task, which multiplies them as matrices, if a bound on their dot products exceeds the
    threshold (see blocks.py); a task's memory stays bounded and neither side is broadcast. Vectors have one length.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"  # products are doubles in any case
    rows = vectors.select(F.col(node).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")

    def edges(ids, i, j, dots):
        a, b = ids[i], ids[j]
        apart = a != b
        return np.minimum(a, b)[apart], np.maximum(a, b)[apart], dots[apart]

    return products(rows, above, block, edges, "source long, target long, similarity double")


def degree_centrality(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, centrality): degree over n - 1; a single node has 1."""
    ends = edges.select(F.col("source").alias(node)).unionByName(edges.select(F.col("target").alias(node))).groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(node).join(ends, node, "left").crossJoin(F.broadcast(n)).select(node, F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).alias("centrality"))


def central_documents(centrality: DataFrame, node: str, k: int = CENTRAL) -> DataFrame:
    return centrality.orderBy(F.desc("centrality"), node).limit(k)


def average_linkage(vectors: np.ndarray, most: float = MERGE_UP_TO, sizes: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers by average-linkage merging on cosine distance while the smallest is at most `most`; numbered by first member.

    With sizes, a row is the mean of the unit vectors of a cluster of that size.
    """
    n = len(vectors)
    unit = vectors if sizes is not None else vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    d = unit @ unit.T
    np.subtract(1.0, d, out=d)
    np.fill_diagonal(d, np.inf)
    size, owner, done, chain, start = np.ones(n) if sizes is None else np.array(sizes, float), np.arange(n), np.zeros(n, bool), [], 0
    while True:  # chains of nearest neighbours give the merges of the smallest distance first in n^2 steps
        if not chain:
            while start < n and done[start]:
                start += 1
            if start == n:
                break
            chain = [start]
        i = chain[-1]
        j = int(d[i].argmin())
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if not d[i, j] <= most:  # and those before in the chain are farther still
            done[chain] = True
            chain = []
        elif len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = merged, merged
            d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
            size[i] += size[j]
            done[j] = True
            owner[owner == j] = i
        else:
            chain.append(j)
    return np.unique(owner, return_inverse=True)[1]


def _nearest(clusters: DataFrame, at_least: float, block: int) -> DataFrame:
    """(id, other, similarity) of clusters(id, n, s) that have another one with a mean inner product of at least `at_least`; the smallest id of equals."""

    def best(ids, i, j, dots):
        one, two, both = np.r_[ids[i], ids[j]], np.r_[ids[j], ids[i]], np.r_[dots, dots]
        order = np.lexsort((two, -both, one))
        first = order[np.r_[True, one[order][1:] != one[order][:-1]]] if len(order) else order
        return one[first], two[first], both[first]

    means = clusters.select("id", F.transform("s", lambda x: x / F.col("n")).alias("v"))
    each = products(means, at_least, block, best, "id long, other long, similarity double", strict=False)
    top = F.max(F.struct("similarity", (-F.col("other")).alias("minus")))
    return each.groupBy("id").agg(top.alias("top")).select("id", (-F.col("top.minus")).alias("other"), F.col("top.similarity").alias("similarity"))


def _last_merges(clusters: DataFrame, most: float) -> DataFrame:
    """(child, parent) of the few clusters(id, n, s) that are left, all at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n = pdf["id"].to_numpy(), pdf["n"].to_numpy()
        number = average_linkage(np.stack(pdf["s"].to_list()) / n[:, None], most, n)
        heads = ids[np.unique(number, return_index=True)[1]]
        return pd.DataFrame({"child": ids, "parent": heads[number]})[lambda x: x["child"] != x["parent"]]

    return clusters.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "child long, parent long")


def merges(vectors: DataFrame, most: float = MERGE_UP_TO, block: int = BLOCK) -> DataFrame:
    """(child, parent) of ids that end in one cluster; the parent is the cluster's smallest id. vectors: (id, v array<double>).

    The mean distance of two clusters is 1 minus the inner product of their sums of unit vectors over their sizes, so a cluster is one
    row (id, n, s). A round merges all pairs of clusters that are each other's nearest; with average linkage these are merges of
    the whole hierarchy, in whatever order they come. A cluster without another in reach never has one again and leaves. Rounds end when no cluster is
    left; up to `block` of them are finished in one task.
    """
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-300)))
    # equal vectors are one cluster from the start
    equal = materialise(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")), "equal")
    made = [vectors.join(equal.withColumnRenamed("id", "parent"), "v").select(F.col("id").alias("child"), "parent").filter("child <> parent")]
    left = materialise(equal.select("id", "n", F.transform(unit(F.col("v")), lambda x: x * F.col("n")).alias("s")), "clusters")
    while (count := left.count()) > block:
        near = materialise(_nearest(left, 1 - most, block), "nearest")
        back = near.select(F.col("id").alias("b"), F.col("other").alias("a"))
        mutual = materialise(near.join(back, (F.col("id") == F.col("a")) & (F.col("other") == F.col("b"))).filter("id < other").select(F.col("other").alias("child"), F.col("id").alias("parent")), "mutual")
        made.append(mutual)
        one = left.join(near.select("id"), "id").join(mutual, F.col("id") == F.col("child"), "left")
        total = F.transform(F.sequence(F.lit(0), F.size(F.first("s")) - 1), lambda i: F.aggregate(F.collect_list("s"), F.lit(0.0), lambda t, x: t + F.get(x, i)))  # two rows at most
        after = materialise(one.groupBy(F.coalesce("parent", "id").alias("id")).agg(F.sum("n").alias("n"), total.alias("s")), "clusters")
        release(left)
        left = after
    if count > 1:
        made.append(_last_merges(left, most))
    links = made[0]
    for m in made[1:]:
        links = links.unionByName(m)
    links = materialise(links, "links")
    while True:  # a parent may have become a child in a later round; every pass halves the way
        up = links.select(F.col("child").alias("c"), F.col("parent").alias("p"))
        after = materialise(links.join(up, F.col("parent") == F.col("c"), "left").select("child", F.coalesce("p", "parent").alias("parent"), F.col("p").isNotNull().alias("moved")), "links")
        moved = not after.filter("moved").isEmpty()
        release(links)
        links = after.drop("moved")
        if not moved:
            return links


def cluster_hierarchy(vectors: DataFrame, node: str, vector: str, most: float = MERGE_UP_TO, block: int = BLOCK) -> DataFrame:
    """(node, cluster_id) by average linkage over all vectors, while the mean cosine distance is at most `most`; clusters are numbered by their smallest node.

    Null nodes and vectors take no part; vectors have one length, nodes are integers and differ.
    """
    rows = vectors.select(F.col(node).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    heads = rows.select("id").join(merges(rows, most, block), F.col("id") == F.col("child"), "left").select("id", F.coalesce("parent", "id").alias("head"))
    heads = materialise(heads, "heads")
    numbers = numbered(heads.filter("id = head").select("head"), ["head"], "number")
    return heads.join(numbers, "head").select(F.col("id").alias(node), F.concat(F.lit("cluster_"), F.col("number").cast("string")).alias("cluster_id"))


def embed(docs: DataFrame, text: str, out: str = "embedding", size: int = 768) -> DataFrame:
    """Offline embedding: hashed word counts at unit length. Any column of arrays can take its place."""
    tokens = RegexTokenizer(inputCol=text, outputCol="__t", pattern=r"(?U)\b\w\w+\b", gaps=False)
    model = Pipeline(stages=[tokens, HashingTF(inputCol="__t", outputCol="__f", numFeatures=size), Normalizer(inputCol="__f", outputCol="__n")]).fit(docs)
    return model.transform(docs).withColumn(out, vector_to_array("__n", "float32")).drop("__t", "__f", "__n")


def topic_count(documents: int, most: int = 5) -> int:
    return min(most, max(2, documents - 1))


def topics(docs: DataFrame, text: str, most: int = 5, iterations: int = 10, node: str | None = None):
    """(topics(topic_id, words), documents with `topic_share` arrays) over all terms; stop words are English.

    `node` tells the rows of docs apart; without it they are numbered, in a stage table. Documents without a term have equal shares.
    """
    key = node or "__row"
    docs = docs if node else materialise(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    counts, terms = counted(docs, key, text)
    model = fit_topics(counts, terms, topic_count(docs.count(), most), iterations)
    shares = materialise(model.shares(counts), "shares")
    even = F.array_repeat(F.lit(1.0 / model.k), model.k)
    shared = docs.join(shares, docs[key] == shares["doc"], "left").withColumn("topic_share", F.coalesce("topic_share", even)).drop("doc", *[key] * (node is None))
    return materialise(model.described(TOPIC_WORDS), "topics"), shared


def main_topic(shares: DataFrame, cluster: str, share: str) -> DataFrame:
    """(cluster, topic_id) with the greatest mean share; the first of equals."""
    means = shares.select(cluster, F.posexplode(share).alias("topic_id", "p")).groupBy(cluster, "topic_id").agg(F.avg("p").alias("p"))
    return means.groupBy(cluster).agg(F.max(F.struct(F.col("p"), (-F.col("topic_id")).alias("minus"))).alias("m")).select(cluster, (-F.col("m.minus")).alias("topic_id"))


@dataclass
class Structure:
    status: str
    topics: DataFrame | None = None
    clusters: DataFrame | None = None
    central: DataFrame | None = None
    relationships: DataFrame | None = None
    message: str | None = None


def structure_documents(docs: DataFrame, min_similarity: float = 0.5, max_topics: int = 5, honour_similarity: bool = False) -> Structure:
    """docs(ix, filename, content[, embedding]) to topics, clusters, central documents and relationships; failures give status `error`.

    Every result is written before the status is known, so what fails while it is computed is an error too. min_similarity changes nothing unless honour_similarity is set. If topics can't be fitted, each document's name is one.
    """
    try:
        if docs.schema["content"].dataType.simpleString() != "string":
            raise ValueError("content has to be text")
        docs = docs if "embedding" in docs.columns else fit_embedding(docs, "ix", "content").fitted(docs, "ix")
        docs = materialise(docs, "docs")
        try:
            named, shares = topics(docs, "content", max_topics, node="ix")
        except Exception:
            named, shares = docs.select(F.col("ix").cast("int").alias("topic_id"), F.array("filename").alias("words")), None
        clusters = cluster_hierarchy(docs, "ix", "embedding")
        sizes = clusters.join(docs.select("ix", "filename"), "ix").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list(F.struct("ix", "filename"))).alias("documents"))
        if shares is not None:
            best = main_topic(shares.select("ix", "topic_share").join(clusters, "ix"), "cluster_id", "topic_share")
            sizes = sizes.join(best, "cluster_id").join(F.broadcast(named), "topic_id").withColumnRenamed("words", "main_topic").drop("topic_id")  # named: one row per topic
        edges = similarity_edges(docs, "ix", "embedding", min_similarity if honour_similarity else EDGE_ABOVE)
        central = central_documents(degree_centrality(docs, edges, "ix"), "ix").join(docs.select("ix", "filename"), "ix")
        name = lambda end: docs.select(F.col("ix").alias(end), F.col("filename").alias(f"{end}_name"))
        related = edges.join(name("source"), "source").join(name("target"), "target").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "similarity")
        return Structure("success", *(materialise(x, "structure") for x in (named, sizes, central, related)))
    except Exception as e:
        return Structure("error", message=str(e))
