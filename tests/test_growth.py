"""What operators send, hold and repeat as their input grows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import chunking, sentences
from textloom.operators import blocks, structure, terms


def sent(df):
    """Bytes that the shuffles of df's last run have written, by exchange."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if p.nodeName() == "Exchange":
            out.append(p.metrics().apply("shuffleRecordsWritten").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_blocks_travel_together(spark):
    """each block was sent once for each block that it met, here 12 times; groups of blocks take a third of that."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1280, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    out = structure.similarity_edges(rows, "id", "v", 0.5, 40)
    got = {(r["source"], r["target"]) for r in out.collect()}
    dots = v.astype(float) @ v.astype(float).T
    i, j = np.nonzero(np.triu(dots > 0.5, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))
    n = max(sent(out))
    assert n <= 1280 * (blocks.GROUPS + 10)


def test_words_are_counted_where_they_are_read(spark):
    """patterns saw every word of every text; they now see each different word once, with its number."""
    docs = spark.createDataFrame([(i, "The dog met Dr. Who. " * 50) for i in range(40)], "doc_id long, text string")
    rows = sentences.words(docs, "text").collect()
    assert len(rows) <= 7
    assert {(r["type"], r["dot"], r["before"]): r["n"] for r in rows} == {("the", False, None): 40, ("the", False, "Who."): 1960, ("dog", False, None): 2000, ("met", False, None): 2000, ("dr", True, None): 2000, ("who", True, "Dr."): 2000}


def test_term_counts_shuffle_repeated_documents_only(spark):
    """every word went into one table of hashes; now only rows that share their number meet."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "cc"), (4, "")], "id long, text string")
    out = terms.term_counts(docs, "id", "text")
    assert sorted(map(tuple, out.collect())) == [(1, "aa", 2), (1, "bb", 1), (3, "cc", 1)] and not sent(out)
    twice = docs.unionByName(spark.createDataFrame([(1, "aa cc"), (None, "dd"), (None, "dd ee")], docs.schema))
    got = sorted(map(tuple, terms.term_counts(twice, "id", "text").collect()), key=str)
    assert got == sorted([(1, "aa", 3), (1, "bb", 1), (1, "cc", 1), (3, "cc", 1), (None, "dd", 2), (None, "ee", 1)], key=str)


def test_chunking_holds_little(spark):
    """four MB of text at a time made some 20 MB of chunks, offsets and code points."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["One sentence of a text. And one more that is longer! " * 60] * 1500)
    batch = pa.RecordBatch.from_arrays([texts, pa.array(range(1500))], names=["text", "doc_id"])
    for strategy in ("Length-based", "Semantic"):
        tracemalloc.start()
        n = sum(len(b) for b in chunking.chunk_batches([batch], strategy, 500, 10))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n >= 9000 and peak < 8 << 20


def test_vectors_are_sent_once_a_block(spark):
    """each word of each document took its term's vector through the shuffle."""
    docs = spark.range(400).selectExpr("id AS doc")
    counts = docs.crossJoin(spark.range(20).selectExpr("id AS term")).selectExpr("doc", "term", "1L AS n")
    vectors = spark.range(20).selectExpr("id AS term", "array(CAST(id AS DOUBLE), 1.0D) AS vec")

    def work(starts, docs, ids, n, vec):
        yield terms._summed(vec * n[:, None], ids)

    out = terms.swept(counts, vectors, work, "term long, vec array<double>")
    parts = out.collect()
    blocks_ = spark.sparkContext.defaultParallelism
    assert len(parts) <= 20 * blocks_ and sorted((r["term"], r["vec"]) for r in terms.summed(out).collect()) == [(i, [400.0 * i, 400.0]) for i in range(20)]


def test_embedding_keeps_points_and_not_directions_of_terms(spark, monkeypatch):
    """every sweep wrote a vector of all dimensions for each term, and sent one to each block and back."""
    rng = random.Random(5)
    texts = [" ".join([f"w{rng.randrange(40)}" for _ in range(12)] + [f"only{i}x{j}" for j in range(20)]) for i in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (500, ""), (501, None)], "id int, text string").repartition(3)
    written, write = {}, terms.materialise

    def noted(df, tag):
        written.setdefault(tag, []).append((df.columns, (out := write(df, tag)).count()))
        return out

    monkeypatch.setattr(terms, "materialise", noted)
    monkeypatch.setattr(terms, "COLUMNS", 4)
    model = terms.fit_embedding(docs, "id", "text", size=6, sweeps=6)
    assert max(n for tables in written.values() for _, n in tables) <= 150 and len(written["columns"]) == 6 * 4
    got, again = ({r["id"]: np.array(r["embedding"]) for r in df.collect()} for df in (model.fitted(docs, "id"), model.transform(docs, "id", "text")))
    assert len(got) == 152 and not got[500].any() and len(got[501]) == 6
    assert all(np.allclose(got[i], again[i], atol=1e-5) for i in got)
    bags = terms._bags(docs, "id", "text")[0]
    points = write(terms._thrown(bags, 3, 1), "points")
    back = terms._back(bags, points, False)
    assert back.select("term").distinct().count() == 40 and back.schema["vec"].dataType.elementType.simpleString() == "float"


def test_pdf_tokens_look_up_no_patterns(monkeypatch):
    """F8: every token of a PDF went through the lookup of a pattern by its text, and every operator through an exception."""
    from textloom.sources import pdf

    def fail(*_):
        raise AssertionError("a pattern is looked up for a token")

    data, out, at = b"12 +3 -4.5 .5 7 0 R 8 0 RG /A#42c /Tj Tj T* n nan1 i true null <4a4> (a) 1.2.3 ' \" --5 W*", [], 0
    with monkeypatch.context() as m:
        m.setattr(pdf.re, "fullmatch", fail)
        m.setattr(pdf.re, "sub", fail)
        while at >= 0:
            v, at = pdf.parse(data, at)
            out.append(v)
    assert out == [12, 3, -4.5, 0.5, pdf.Ref(7), 8, 0, b"RG", "/ABc", "/Tj", b"Tj", b"T*", b"n", b"nan1", b"i", True, None, b"J@", b"a", b"1.2.3", b"'", b'"', b"--5", b"W*", None]
    assert [isinstance(v, pdf.Word) for v in out[7:8] + out[10:15] + out[19:24]] == [True] * 11


def test_cleaning_leaves_alone_what_has_nothing_to_clean(spark):
    """each step rewrote each text, spaces one by one and line ends by splitting, also where it had nothing to change."""
    from textloom.functions import cleaning

    plan = spark.range(1).select(cleaning.line_count(F.col("id").cast("string")), cleaning.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan
    texts = ["", "a b", "a  b", " a　b\t", "a\n\nb\r\n", "\r\n", "\n", "a\rb\x85c ", "x\x1cy \xa0 z", "  q", "a\r\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", cleaning.collapse_spaces(F.col("t")).alias("c"), cleaning.line_count(F.col("t")).alias("n"), cleaning.strip(F.col("t")).alias("s")).collect()
    for r in rows:
        assert (r["c"], r["n"], r["s"]) == (re.sub(r"\s+", " ", r["t"]), len(r["t"].splitlines()), r["t"].strip())


def test_percentages_round_as_in_sql(spark, tmp_path):
    """at ties of two places Spark rounded 2.8249999999999997 to 2.82 and 8.075 to 8.08, the SQL to 2.83 and 8.07; a text cleaned to nothing is one line there."""
    import __spark_entry__
    import duckdb

    texts = ["a" + " " * (n + 1) + "b" * (3998 - n) for n in (113, 323, 343, 557, 731, 40)] + ["   ", "a\nb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["clean_stats"](spark, str(tmp_path)).orderBy("doc_id").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()["clean_stats"] + " ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got] == want
    assert [r["reduction_percentage"] for r in got[:2]] == [2.83, 8.07]


def test_counting_words_gives_memory_back(monkeypatch):
    """workers kept what they had freed after each task, while the tasks of other stages ran in them."""
    import pyarrow as pa

    called = []
    monkeypatch.setattr(terms, "give_back", lambda: called.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([["a", "b", "a"], []])], names=["doc", "words"])
    assert sum(map(len, terms._each([batch]))) == 2 and called
