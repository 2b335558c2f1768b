import base64
import io
import json
import os
import random
import re
import zipfile
import zlib
from datetime import datetime, timedelta
from html import escape

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import chunking, languages, mojibake, sentences, sql
from textloom.functions.cleaning import CleanOptions, clean_stats, clean_text, fix_line_breaks, remove_headers_footers, repair_unicode
from textloom.operators import blocks, export, structure, terms
from textloom.plans import catalog, ingest
from textloom.sources import files, pdf


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("H\na\nb\nH\nc\nd", "a\nb\nc\nd"), ("a\nb\nPage 1 of 3\nc\n12\nd", "a\nb\nc\nd"), ("x\nx\ny", "y")])
def test_headers(spark, text, want):
    assert one(spark, text, remove_headers_footers) == want


@pytest.mark.parametrize(("text", "want"), [("a\nb\nc", "a\nb\nc"), ("a\nb", "a b"), ("Hello wor-\nld. Next", "Hello world. Next"), ("", ""), (None, None)])
def test_clean(spark, text, want):
    assert one(spark, text, clean_text) == want


def test_clean_steps(spark):
    off = dict(remove_headers_footers=False, fix_line_breaks=False, remove_multiple_spaces=False)
    assert one(spark, "see http://a.b/c?d=1#x ok", lambda t: clean_text(t, CleanOptions(remove_urls=True, **off))) == "see #x ok"
    assert one(spark, 'a#b "c" d-e!', lambda t: clean_text(t, CleanOptions(remove_special_characters=True, **off))) == "ab c d-e!"
    assert one(spark, "A.\nB", fix_line_breaks) == "A.\n\nB"
    stats = spark.createDataFrame([("abcd", "ab")], "a string, b string").select(*(v.alias(k) for k, v in clean_stats(F.col("a"), F.col("b")).items())).first()
    assert tuple(stats) == (4, 2, 50.0, 2, 1, 1)


def spans(spark, text, strategy, size=500, overlap=10):
    return [(r["start"], r["end"], r["text"]) for r in chunking.chunk(spark.createDataFrame([(1, text)], "id int, text string"), strategy, size, overlap).orderBy("chunk_ix").collect()]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("a" * 480, 500, 10, [(0, 500, "a" * 480)]),
        ("a" * 495, 500, 10, [(0, 500, "a" * 495), (490, 990, "a" * 5)]),
        ("a" * 89 + "." + "b" * 60, 100, 10, [(0, 90, "a" * 89 + "."), (80, 180, "a" * 9 + "." + "b" * 60)]),
        ("a" * 60 + "\n\n" + "b" * 20 + "." + "c" * 67, 100, 0, [(0, 60, "a" * 60), (60, 160, "b" * 20 + "." + "c" * 67)]),
        ("", 500, 10, []),
    ],
)
def test_length(spark, text, size, overlap, want):
    assert spans(spark, text, "Length-based", size, overlap) == want


def test_stuck_and_refused(spark):
    stuck = "a" * 50 + "\n\n" + "b" * 100
    assert spans(spark, stuck, "Length-based", 100, 50) == [(None, None, None)]
    rows = chunking.chunk(spark.createDataFrame([(1, stuck), (2, "fine"), (3, None)], "id int, text string"), "Length-based", 100, 50, errors=True).collect()
    assert [(r["id"], r["chunk_ix"], r["text"], r["error"] is None) for r in sorted(rows)] == [(1, None, None, False), (2, 0, "fine", True)]
    with pytest.raises(ValueError, match="size"):
        spans(spark, "a", "Length-based", 40, 0)
    with pytest.raises(ValueError, match="strategy"):
        spans(spark, "a", "none")


def test_semantic_and_structure(spark):
    text = "A b. C d. E f. G h."
    assert spans(spark, text, "Semantic", 10) == [(0, 9, "A b. C d."), (5, 14, "C d. E f."), (10, 19, "E f. G h.")]
    assert spans(spark, text, "Semantic", 14) == [(0, 14, "A b. C d. E f."), (5, 19, "C d. E f. G h.")]
    assert spans(spark, "# A\nfoo\n## B\nbar", "Structure-based") == [(-1, 7, "# A\n\nfoo"), (-1, 8, "## B\n\nbar")]
    assert spans(spark, "# Title only", "Structure-based") == []
    assert spans(spark, "p1\n\n\n\np2", "Structure-based") == [(0, 2, "p1"), (4, 6, "p2")]


def chunks_by_hand(text, strategy, size, overlap):
    """(start, end, chunk) straight from the rules, place by place."""
    if strategy == "Length-based":
        out, start = [], 0
        while start < len(text):
            end = start + size
            if end < len(text):
                breaks = [q for q in range(end - 50, end + 49) if text[q : q + 2] == "\n\n"]
                dots = [q + 1 for q in range(end - 30, end + 30) if text[q : q + 1] == "."]
                end = (breaks or dots or [end])[0]
            if end - overlap <= start:
                return [(None, None, None)]
            out += [(start, end, text[start:end].strip())] if text[start:end].strip() else []
            start = end - overlap
        return out
    if strategy == "Semantic":
        parts, out, i = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()], [], 0
        mine = []
        while i < len(parts):
            if mine and sum(len(parts[k]) for k in [*mine, i]) > size:
                out.append(mine)
                mine = mine[-2:] if len(mine) > 2 else mine[-1:]
            mine = [*mine, i]
            i += 1
        return [(text.find(parts[m[0]]), text.find(parts[m[-1]]) + len(parts[m[-1]]), " ".join(parts[k] for k in m)) for m in [*out, mine] if m]
    out, at = [], 0
    for x in text.split("\n\n"):
        if x.strip():
            out.append((at, at + len(x), x.strip()))
            at += len(x) + 2
    return out


@pytest.mark.parametrize(("strategy", "size", "overlap"), [("Length-based", 100, 0), ("Length-based", 100, 50), ("Length-based", 130, 20), ("Length-based", 50, 0), ("Semantic", 40, 0), ("Semantic", 300, 0), ("Structure-based", 100, 0)])
def test_chunks_of_random_texts(spark, monkeypatch, strategy, size, overlap):
    rng = random.Random(size + overlap)
    letters = "aé😀  ." + "\n" * 2 + "bcdefghijklmnop" * rng.randint(1, 9) + "!?"
    texts = ["".join(rng.choice(letters) + rng.choice(("", "", "\n\n", ". ")) * (rng.random() < 0.03) for _ in range(rng.choice((0, 5, 90, 101, 700, 3000)))).strip() for _ in range(60)]
    texts = ["x" + t if t.startswith("#") else t for t in [*texts, "y" * 20_000, "one. " * 3000, "\n\n" * 300 + "end"]]
    monkeypatch.setattr(chunking, "BATCH_BYTES", 5000)
    rows = chunking.chunk(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), strategy, size, overlap).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["chunk_ix"] or 0)):
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["text"]))
    assert got == {i: want for i, t in enumerate(texts) if (want := chunks_by_hand(t, strategy, size, overlap))}


def test_table_functions_of_sql(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(i, f"One {i}. Two. " * (i % 7), "clash", i) for i in range(1500)] + [(1500, None, "", 0), (1501, "a" * 50 + "\n\n" + "b" * 100, "", 0)], "id int, body string, strategy string, level int").repartition(3)
    docs.createOrReplaceTempView("sql_docs")
    for strategy, size, overlap in (("Semantic", 30, 0), ("Length-based", 100, 50), ("Structure-based", 100, 10)):
        got = spark.sql(f"SELECT * FROM chunk_text(TABLE(sql_docs), '{strategy}', {size}, overlap => {overlap}, text_column => 'body')")
        want = chunking.chunk(docs, strategy, size, overlap, "body", errors=True)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for call, why in (("TABLE(sql_docs), 'none', text_column => 'body'", "strategy"), ("TABLE(sql_docs)", "no column"), ("TABLE(sql_docs), 'Length-based', 40, text_column => 'body'", "size")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM chunk_text({call})").collect()
    raw = spark.createDataFrame([("a.TXT", bytearray(b"x"), 1), ("p.pdf", bytearray(pdf.page_of("in a pdf")), 2), ("t.csv", bytearray(b"1"), 3), (None, None, 4)], "filename string, content binary, n int")
    got = spark.sql("SELECT * FROM document_text(TABLE({raw}))", raw=raw).collect()
    assert sorted((r["n"], r["type"], r["text"], r["error"] is None) for r in got) == [(1, "text", "x", True), (2, "pdf", "in a pdf", True), (3, None, None, False), (4, "text", "", True)]
    names = ["X.MD", "noend", "b.txt.gz", "b.tgz", ".csv", "dir.csv/x", "a.unknown", ".md", "a.", "q\\w.HTM", "a.webp"]
    kinds = spark.createDataFrame([(n,) for n in names], "f string").select("f", files.type_of(F.col("f")).alias("t")).collect()
    assert {r["f"]: r["t"] for r in kinds} == {n: files.kind_of(n) for n in names}


def test_exact_places(spark):
    texts = {1: "A b. A b. Long one here. A b.", 2: "# T\nbody one\n### Sub  \n\n text two \n## Empty\n", 3: "#tag first\n\n# H\nx", 4: "p1\n\n\n\n  p2 \n\np1"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    for strategy in ("Semantic", "Structure-based"):
        rows = chunking.chunk(docs, strategy, 12, exact=True).orderBy("id", "chunk_ix").collect()
        for r in rows:
            assert "".join(texts[r["id"]][r["start"] : r["end"]].split()) == "".join(r["text"].split())
        if strategy == "Structure-based":
            assert [(r["id"], r["start"], r["level"]) for r in rows] == [(1, 0, 0), (2, 0, 1), (2, 13, 3), (3, 0, 0), (3, 12, 1), (4, 0, 0), (4, 8, 0), (4, 13, 0)]
        else:
            assert [(r["start"], r["end"]) for r in rows if r["id"] == 1] == [(0, 9), (5, 24), (10, 29)]
    chunks = spark.createDataFrame([("f", i, f"t{i}") for i in range(5)], "filename string, start int, text string")
    ids = lambda df: {r["text"]: r["id"] for r in export.vector_records(df, ["start"], ["filename", "start", "text"]).collect()}
    assert ids(chunks.filter("start > 2")).items() <= (whole := ids(chunks)).items() and len(set(whole.values())) == 5


def test_sentences_are_learned(spark):
    rng = random.Random(2)
    nouns = ["house", "river", "stone", "garden", "window", "letter", "summer", "winter", "market", "village"]
    lines = []
    for i in range(400):
        a, b = rng.sample(nouns, 2)
        lines.append(rng.choice([f"The {a} was near the {b}.", f"Dr. Miller saw the {a} at 3.5 km.", f"In the {a}, Prof. Smith met Mr. Jones.", f"This {b} is old, z. B. the {a}.", f"We met J. Brown approx. 3 times by the {b}.", f"No {a}! The {b}?"]))
    docs = spark.createDataFrame([(i, " ".join(lines[i : i + 8])) for i in range(0, 400, 8)] + [(1, None), (2, "")], "id int, text string")
    model = sentences.learn(docs)
    assert {"dr", "prof", "mr", "approx"} <= model.abbreviations and not set(nouns) & model.abbreviations
    assert {"this", "we"} <= model.starters and "miller" not in model.starters
    text = "Dr. Miller met Mr. Jones (approx. 5 m away). The house, z. B. by J. R. Smith, cost 3.5 m. We saw it! \"It ended.\" Then... nothing. In 1999. the end"
    want = ["Dr. Miller met Mr. Jones (approx. 5 m away).", "The house, z. B. by J. R. Smith, cost 3.5 m.", "We saw it!", '"It ended."', "Then... nothing.", "In 1999. the end"]
    assert model.split(text)[:3] == want[:3] and model.split(text)[-2:] == want[-2:]
    assert sentences.SentenceModel().split("One. Two! A. Smith ") == ["One.", "Two!", "A. Smith"] and model.split(" \n") == []
    chunks = chunking.chunk(spark.createDataFrame([(1, text)], "id int, text string"), "Semantic", 40, model=model).orderBy("chunk_ix").collect()
    assert chunks[0]["text"] == want[0] and chunks[0]["end"] == len(want[0])
    assert sentences.learn(docs.limit(0)) == sentences.SentenceModel()


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return bytearray(out.getvalue())


def test_files(spark):
    ns = 'xmlns:r="http://r"'
    rels = '<R xmlns="x"><Relationship Id="i1" Target="{}"/></R>'
    xlsx = _zip({"xl/workbook.xml": f'<w {ns}><sheets><sheet name="S" r:id="i1"/></sheets></w>', "xl/_rels/workbook.xml.rels": rels.format("s1.xml"), "xl/s1.xml": '<s><row><c><v>1</v></c><c/><c t="inlineStr"><is><t>x</t></is></c></row><row><c/></row></s>'})
    docx = _zip({"word/document.xml": "<d><body><p><t>one</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl><p><t>two</t></p></body></d>"})
    pptx = _zip({"ppt/presentation.xml": f'<p {ns}><sldId r:id="i1"/></p>', "ppt/_rels/presentation.xml.rels": rels.format("s.xml"), "ppt/s.xml": "<s><spTree><sp><txBody><p><t>hi</t></p></txBody></sp></spTree></s>"})
    rows = [("x.txt", b"a\xffb"), ("X.MD", b"# T"), ("a.html", b"<title>t</title><script>x</script><meta name=a content=1><meta name=a content=2><meta property=p content=qrs><p>b<b>c"), ("a.XLSX", xlsx), ("a.docx", docx), ("a.pptx", pptx), ("a.pdf", b"%PDF"), ("a.csv", b"1"), ("bad.docx", b"zz")]
    raw = spark.createDataFrame([(n, i, bytearray(d)) for i, (n, d) in enumerate(rows)], "filename string, ordinal long, content binary")
    got = {r["filename"]: r for r in files.extract_documents(raw).collect()}
    assert got["x.txt"]["content"] == "ab" and got["x.txt"]["metadata"]["size"] == 3
    assert got["X.MD"]["html_content"] == "<h1>T</h1>"
    assert got["a.html"]["content"] == "t\nb\nc" and got["a.html"]["metadata"]["meta_tags"] == {"a": "2", "p": "qrs"} and got["a.html"]["metadata"]["size"] == 3
    assert got["a.XLSX"]["content"] == "\n### Worksheet: S ###\n\n1 | x"
    assert got["a.docx"]["content"] == "one\ntwo\na | b"
    assert got["a.pptx"]["content"] == "\n### Slide 1 ###\n\nhi"
    assert all(got[n]["error"] for n in ("a.pdf", "a.csv", "bad.docx"))
    assert files.confident([(0, "a", 0.5), (0, "b", 0.51)]) == "b"
    text, meta = files.read_pdf(b"", lambda d: (["x" * 99, "y" * 100], {}), lambda d, i: [(0, f"o{i}", 0.9)])
    assert text == "x" * 99 + "\no0\n" + "y" * 100 and meta["pages"] == 3


@pytest.mark.parametrize("late", [False, True])
def test_dates_of_sheets(late):
    formats = ["General", "yyyy\\-mm\\-dd", '0.0 "days"', "[h]:mm", "[Red]0.00", "h:mm AM/PM"]
    styles = "<s><numFmts>" + "".join(f"<numFmt numFmtId='{164 + i}' formatCode='{escape(f)}'/>" for i, f in enumerate(formats)) + "</numFmts><cellStyleXfs><xf numFmtId='14'/></cellStyleXfs><cellXfs>" + "".join(f"<xf numFmtId='{n}'/>" for n in (0, 14, 22, *range(164, 170))) + "</cellXfs></s>"
    cells = [("1", 0), ("45306", 1), ("45306.5", 2), ("2.50", 3), ("45306.25", 4), ("3", 5), ("1.5", 6), ("2.0", 7), ("0.25", 8), ("1E3", 0), ("59", 1)]
    row = "".join(f"<c s='{s}'><v>{v}</v></c>" for v, s in cells) + "<c t='e'><v>#N/A</v></c><c t='d'><v>2024-01-15</v></c><c t='b'><v>1</v></c>"
    data = _zip({"xl/workbook.xml": f'<w xmlns:r="http://r"><workbookPr date1904="{int(late)}"/><sheets><sheet name="S" r:id="i1"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R xmlns="x"><Relationship Id="i1" Target="s1.xml"/></R>', "xl/styles.xml": styles, "xl/s1.xml": f"<s><row>{row}</row></s>"})
    shift = 1462 if late else 0
    day = lambda n: str((datetime(1899, 12, 30) + timedelta(days=n + shift)).date())
    want = ["1", f"{day(45306)} 00:00:00", f"{day(45306)} 12:00:00", "2.5", f"{day(45306)} 06:00:00", "3", "1 day, 12:00:00", "2.0", "06:00:00", "1000.0", f"{day(59 + (not late))} 00:00:00", "#N/A", "2024-01-15 00:00:00", "True"]
    assert files.read_xlsx(bytes(data))[0].split("\n")[-1].split(" | ") == want


def old_pdf(objects, trailer=""):
    """A file with a cross-reference table."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, x in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj ".encode() + x + b" endobj\n"
    start = len(out)
    out += f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + f"trailer <</Root 1 0 R/Size {len(places) + 1}{trailer}>>\nstartxref\n{start}\n%%EOF".encode()


def stream(body, more=b""):
    return b"<</Length %d%s>> stream\n%s\nendstream" % (len(body), more, body)


def test_pdf_pages(spark):
    content = b"BT /F1 12 Tf 72 700 Td [(Hel) 20 (lo) -300 (wor\\154d)] TJ 0 -14 TD (caf\\351 \\(ok\\)) Tj T* <0102> Tj ET q 1 0 0 1 0 -50 cm /X Do Q BI /W 1 ID \xff\x00( EI BT /F1 9 Tf 1 0 0 1 72 500 Tm (end) Tj ET"
    fonts = b"/Resources<</Font<</F1 6 0 R>>/XObject<</X 7 0 R>>>>"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Kids[3 0 R 8 0 R]/Count 2" + fonts + b">>",
        b"<</Type/Page/Contents[4 0 R 5 0 R]>>",
        stream(zlib.compress(content[:60]), b"/Filter/FlateDecode"),
        stream(base64.a85encode(content[60:]) + b"~>", b"/Filter[/ASCII85Decode]"),
        b"<</Type/Font/Subtype/Type1/FirstChar 32/Widths[250]/Encoding<</Differences[1/eacute/f_i.x/uni00DF 2/fi]>>>>",
        stream(b"BT /F1 12 Tf 72 700 Td (in a form) Tj ET", b"/Subtype/Form"),
        b"<</Type/Page>>",
    ]
    whole = old_pdf(objects, "/Info<</Title(A \\050b\\051)/Author<feff00e9>>>")
    want = (["Hello world\ncafé (ok)\néfi\nin a form\nend", ""], {"/Title": "A (b)", "/Author": "é"})
    assert pdf.extract(whole) == want
    assert pdf.extract(whole.replace(b"startxref\n", b"startxref\n9")) == want  # found again by scanning
    made = pdf.page_of("Größe 😀\n\n two  words ", "T")
    assert pdf.extract(made) == (["Größe 😀\n two  words "], {"/Title": "T"}) == pdf.extract(made.replace(b"startxref", b""))
    with pytest.raises(ValueError, match="encrypted"):
        pdf.extract(old_pdf(objects, "/Encrypt<</V 1>>"))
    raw = spark.createDataFrame([("a.pdf", 0, bytearray(whole)), ("b.pdf", 1, bytearray(old_pdf(objects, "/Encrypt 9 0 R"))), ("c.PDF", 2, bytearray(b"%PDF-1.4 cut"))], "filename string, ordinal long, content binary")
    got = {r["filename"]: r for r in files.extract_documents(raw, ocr=lambda data, page: [(0, f"scan {page}", 0.9)]).collect()}
    assert got["a.pdf"]["content"] == "\n".join([want[0][0], "scan 0", "", "scan 1"]) and got["a.pdf"]["metadata"]["pages"] == 4 and got["a.pdf"]["metadata"]["ocr_applied"]
    assert "encrypted" in got["b.pdf"]["error"] and got["c.PDF"]["error"]


def test_png_predictors():
    rows = [bytes([1, 5, 9, 200]), bytes([3, 3, 250, 7]), bytes([0, 1, 2, 3]), bytes([9, 9, 9, 9]), bytes([4, 8, 15, 16])]
    packed, last = b"", bytes(4)
    for kind, row in enumerate(rows):
        packed += bytes([kind])
        for k, x in enumerate(row):
            a, b, c = (row[k - 1], last[k], last[k - 1]) if k else (0, last[k], 0)
            nearest = min((a, b, c), key=lambda y: abs(a + b - c - y))
            packed += bytes([(x - [0, a, b, (a + b) // 2, nearest][kind]) % 256])
        last = row
    assert pdf.predicted(packed, 4, 1, 8) == b"".join(rows)


def test_graph(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])], "id long, v array<double>")
    edges = structure.similarity_edges(v, "id", "v")
    assert sorted((r[0], r[1], round(r[2], 6)) for r in edges.collect()) == [(0, 1, 0.6), (1, 2, 0.8)]
    c = structure.degree_centrality(v, edges, "id")
    assert [(r[0], r[1]) for r in structure.central_documents(c, "id").collect()] == [(1, 1.0), (0, 0.5), (2, 0.5)]
    assert structure.average_linkage(np.array([[1, 0], [0.6, 0.8], [0, 1.0]])).tolist() == [0, 1, 1]
    assert [structure.topic_count(n) for n in (1, 3, 4, 9)] == [2, 2, 3, 5]
    shares = spark.createDataFrame([("c", [0.4, 0.4, 0.2])], "c string, s array<double>")
    assert structure.main_topic(shares, "c", "s").first()["topic_id"] == 0


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "v1"), ("b", 2, "w"), ("a", 3, "v2")], "name string, ord long, text string")
    assert sorted(map(tuple, export.last_wins(docs, "name", "ord").select("position", "name", "text").collect())) == [(1, "a", "v2"), (2, "b", "w")]
    chunks = spark.createDataFrame([("f", i // 150, i, f't"{i}') for i in range(300)], "filename string, file long, ix long, text string")
    ids = export.vector_records(chunks, ["file", "ix"]).select("ix", "id", "batch").orderBy("ix").collect()
    assert [r["id"] for r in ids] == [f"chunk_{i}" for i in range(300)] and ids[250]["batch"] == 2
    records = spark.createDataFrame([("chunk_0", "x", None), ("chunk_1", "y", "en")], "id string, text string, language string")
    path = str(tmp_path / "store")
    assert export.export_vectors(records, "chroma", path).first()["chunks_uploaded"] == 2
    export.export_vectors(records.limit(1).withColumn("text", F.lit("z")), "chroma", path)
    assert {r["id"]: (r["text"], r["language"]) for r in export.stored(spark, path).collect()} == {"chunk_0": ("z", "unknown"), "chunk_1": ("y", "en")}
    assert export.export_vectors(records, "none", path).first()["status"] == "error" and export.stored(spark, str(tmp_path / "nowhere")) is None
    made = spark.createDataFrame([("t\"q", 0, 1, "s", ("f", "text"))], "text string, start int, end int, strategy string, metadata struct<filename:string,type:string>")
    assert export.write_chunks(made, str(tmp_path / "csv"), "CSV") and not export.write_chunks(made.limit(0), str(tmp_path / "none"), "CSV")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["text"] == 't"q'


def test_one_file_in_order(spark, tmp_path):
    import csv

    texts = {i: rng_text for i, rng_text in enumerate(["plain", 'quo"ted', "line\nfeed, comma", " spaces ", "é😀", "", "\\back", "x" * 3000] * 40)}
    rows = [(i, t, i, i + len(t), "length_based", (f"f{i % 3}.txt", "text")) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "ix int, text string, start int, end int, strategy string, metadata struct<filename:string,type:string>").repartition(7)
    made = {fmt: export.write_file(df, ["ix"], str(tmp_path / "chunks"), fmt) for fmt in export.FORMATS}
    assert all(m["rows"] == 320 and m["bytes"] == os.path.getsize(m["name"]) for m in made.values()) and made["JSON"]["mime"] == "application/json"
    read = {fmt: open(m["name"], encoding="utf-8", newline="").read() for fmt, m in made.items()}
    want = [{"ix": i, "text": t, "start": s, "end": e, "strategy": k, "metadata": {"filename": f, "type": y}} for i, t, s, e, k, (f, y) in rows]
    assert json.loads(read["JSON"]) == want == [json.loads(x) for x in read["JSONL"].split("\n")[:-1]]
    assert list(csv.reader(io.StringIO(read["CSV"], newline=""))) == [export.CSV_COLUMNS, *([t, str(s), str(e), k, f, y] for _, t, s, e, k, (f, y) in rows)]
    assert read["Markdown"] == "".join(f"## Chunk from {f}\n\n{t}\n\n---\n\n" for _, t, _, _, _, (f, _) in rows)
    assert export.write_file(df.limit(0), ["ix"], str(tmp_path / "none"), "CSV") is None and sorted(os.listdir(tmp_path)) == ["chunks.csv", "chunks.json", "chunks.jsonl", "chunks.md"]
    assert export.write_file(df, ["ix"], f"{tmp_path}/", "Markdown")["name"] == str(tmp_path / "rag_chunks.md")
    for fmt, path in (("XML", "x"), ("CSV", "hdfs://a/b")):
        with pytest.raises(ValueError):
            export.write_file(df, ["ix"], path, fmt)


def test_entry_without_session_and_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and e.FLAGSHIP in e.queries() and e.llm is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert not done.returncode, done.stderr


def test_cluster_hierarchy_covers_the_whole_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(1, "a", [1.0, 0.0, 0.1]), (2, "b", [1.0, 0.0, 0.1]), (25_000, "a", [1.0, 0.0, 0.12]), (25_001, "b", [0.0, -1.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["cluster_id"] for r in catalog.queries()["cluster_hierarchy"](spark, str(tmp_path)).collect()}
    assert got == {1: "cluster_0", 2: "cluster_0", 25_000: "cluster_0", 25_001: "cluster_1"}
    for n in (1, 2, 40):
        v = rng.normal(size=(n, 3))
        d = 1 - (u := v / np.linalg.norm(v, axis=1, keepdims=True)) @ u.T
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            far, x, y = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if far > 0.5:
                break
            groups[x] += groups.pop(y)
        want = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
        assert structure.average_linkage(v).tolist() == [want[i] for i in range(n)]


def clustered(rng, n, d=8, centres=40, noise=0.35):
    """Vectors around some centres, with copies and a zero vector."""
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(centres, size=n)] * rng.uniform(0.5, 2, (n, 1)) + noise * rng.normal(size=(n, d))
    v[: n // 10] = v[n // 10]
    v[-1] = 0
    return v


def test_whole_hierarchy_in_rounds_equals_one_block(spark):
    v = clustered(np.random.default_rng(5), 3000)
    rows = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 8), (7, None)], "node long, e array<double>").repartition(5)
    got = {r["node"]: r["cluster_id"] for r in structure.cluster_hierarchy(rows, "node", "e", block=200).collect()}
    want = structure.average_linkage(v)
    assert got == {i * 3: f"cluster_{c}" for i, c in enumerate(want)}
    assert 1 < len(set(want)) < 1500
    assert structure.cluster_hierarchy(rows.limit(0), "node", "e").collect() == []


def test_blocks_that_cannot_match_are_skipped(spark):
    rng = np.random.default_rng(6)
    c = np.eye(16)[rng.integers(16, size=2000)] + 0.02 * rng.normal(size=(2000, 16))
    c = c * rng.choice([0.9, 1.0, 1.1], (2000, 1))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "id long, v array<double>")
    dots = c @ c.T
    for above in (0.7, 1.15, -1.0):
        dealt, parts, pivots = blocks.placed(rows, 100)
        met, n = blocks.pairs_of_blocks(parts, pivots, above).count(), parts.count()
        assert parts.agg(F.sum("rows")).first()[0] == 2000 == dealt.count()
        assert met < n * (n + 1) / 2 / 4 if above > 0 else met == n * (n + 1) / 2
        if above > 0:
            got = {(r[0], r[1]) for r in structure.similarity_edges(rows, "id", "v", above, 100).collect()}
            assert got == {(i, j) for i, j in zip(*np.nonzero(dots > above), strict=True) if i < j}


def test_edges_of_shapeless_vectors(spark):
    v = np.random.default_rng(8).normal(size=(400, 5)) / 2
    v[0] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [0.0] * 5)], "id long, v array<double>")
    got = {(r[0], r[1]): r[2] for r in structure.similarity_edges(rows, "id", "v", 0.3, 64).collect()}
    dots = v @ v.T
    assert got.keys() == {(i, j) for i, j in zip(*np.nonzero(dots > 0.3), strict=True) if i < j}
    assert all(abs(dots[k] - x) < 1e-9 for k, x in got.items())


def test_topics_query_takes_all_terms(spark, tmp_path):
    spark.createDataFrame([(1, "red apple tree"), (2, "blue river water"), (3, "red river"), (4, None), (5, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.queries()["topics_lda"](spark, str(tmp_path)).collect()
    assert [r["topic_id"] for r in sorted(rows)] == [0, 1, 2, 3] and all(set(r["words"]) == {"red", "apple", "tree", "blue", "river", "water"} for r in rows)
    with pytest.raises(ValueError, match="no terms"):
        structure.topics(spark.createDataFrame([(1, "")], "id int, text string"), "text")


def topic_corpus(rng, n, words=60, topics=4):
    """Texts of two topics each, whose words overlap in part."""
    by_topic = rng.dirichlet(np.full(words, 0.08), topics)
    out = []
    for _ in range(n):
        share = rng.dirichlet(np.full(topics, 0.3))
        out.append(" ".join(f"word{w}" for w in rng.choice(words, size=80, p=share @ by_topic)))
    return out


def held_out(texts, by_topic, index):
    """Log-likelihood a word of the second halves of texts, by shares that fit the first halves."""
    total = n = 0
    for t in texts:
        ids = [index[w] for w in t.split() if w in index]
        seen, rest = ids[::2], ids[1::2]
        share = np.full(len(by_topic), 1 / len(by_topic))
        for _ in range(100):
            p = share[:, None] * by_topic[:, seen]
            share = (p / p.sum(0)).sum(1) + 0.25
            share /= share.sum()
        total, n = total + np.log(share @ by_topic[:, rest]).sum(), n + len(rest)
    return total / n


@pytest.mark.parametrize("batch", [5000, 60])
def test_topics_fit_as_well_as_another_implementation(spark, monkeypatch, batch):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    monkeypatch.setattr(terms, "BATCH_DOCUMENTS", batch)
    texts = topic_corpus(np.random.default_rng(4), 360)
    docs = spark.createDataFrame(list(enumerate(texts[:300])), "id int, text string")
    counts, vocabulary = terms.counted(docs, "id", "text")
    model = terms.fit_topics(counts, vocabulary, 4, 20)
    rows = model.weights.join(model.words, "term").select("word", "vec").collect()
    index = {r["word"]: i for i, r in enumerate(rows)}
    mine = np.array([r["vec"] for r in rows]).T
    vectors = CountVectorizer(inputCol="w", outputCol="f").fit(split := docs.select(F.split("text", " ").alias("w")))
    theirs = LDA(k=4, seed=1, maxIter=20, optimizer="em", featuresCol="f").fit(vectors.transform(split)).topicsMatrix().toArray().T
    there = {w: i for i, w in enumerate(vectors.vocabulary)}
    a, b = (held_out(texts[300:], x / x.sum(1, keepdims=True), i) for x, i in ((mine, index), (theirs, there)))
    assert a > b - 0.05, (a, b)
    shares = {r["doc"]: r["topic_share"] for r in model.shares(counts).collect()}
    assert len(shares) == 300 and all(abs(sum(x) - 1) < 1e-9 for x in shares.values())
    assert [len(r["words"]) for r in model.described(9).collect()] == [9] * 4


def test_digamma():
    assert np.allclose(terms.digamma(np.array([0.1, 1.0, 2.5, 10.0])), [-10.4237549404, -0.5772156649, 0.7031566406, 2.2517525890], atol=1e-9)


def test_embedding_equals_a_whole_decomposition(spark):
    texts = topic_corpus(np.random.default_rng(7), 120, words=40)
    docs = spark.createDataFrame([*enumerate(texts), (500, ""), (501, None)], "id int, text string").repartition(4)
    model = terms.fit_embedding(docs, "id", "text", size=5, sweeps=10)
    got = {r["id"]: np.array(r["embedding"]) for r in model.transform(docs, "id", "text").collect()}
    words = sorted({w for t in texts for w in t.split()})
    n = np.array([[t.split().count(w) for w in words] for t in texts], float)
    a = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * (np.log((1 + len(texts)) / (1 + (n > 0).sum(0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = np.linalg.svd(a)[2][:5].T
    want = a @ v
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.stack([got[i] for i in range(len(texts))])
    assert np.abs(mine @ mine.T - want @ want.T).max() < 1e-3
    assert not got[500].any() and not got[501].any() and len(got[501]) == 5
    new = spark.createDataFrame([(7, texts[3]), (8, "nothing known")], "id int, text string")
    later = {r["id"]: np.array(r["embedding"]) for r in model.transform(new, "id", "text").collect()}
    assert np.allclose(later[7], got[3]) and not later[8].any()


def test_embedding_relates_texts_without_common_words(spark):
    rng = random.Random(3)
    topics = [["engine", "wheel", "brake", "road", "driver", "fuel", "gear", "tyre"], ["flour", "oven", "sugar", "dough", "butter", "bread", "cake", "yeast"]]
    texts = [" ".join(rng.sample(topics[i % 2], 3)) for i in range(200)] + ["engine wheel brake", "fuel gear tyre", "flour oven sugar"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    e = {r["id"]: np.array(r["embedding"]) for r in terms.fit_embedding(docs, "id", "text", size=2).transform(docs, "id", "text").collect()}
    assert e[200] @ e[201] > 0.9 > 0.3 > e[200] @ e[202]
    assert terms.fit_embedding(docs.limit(0), "id", "text").size == 0


def test_languages_are_learned(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs.unionByName(spark.createDataFrame([(9000, None, "en"), (9001, "12 !?", "de"), (9002, "", None)], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in catalog.queries()["language_learned"](spark, str(tmp_path)).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in true if got[i]["held_out"]]
    assert len(held) > 30 and sum(got[i]["language"] == true[i] for i in held) >= 0.95 * len(held)
    assert {got[i]["language"] for i in (9000, 9001, 9002)} == {"unknown"}
    packed, sizes = languages.triples(["Ab c", "", "é1é"])
    text = lambda x: "".join(chr(x >> s & (1 << 21) - 1) for s in (42, 21, 0))
    assert [text(x) for x in packed.tolist()] == [" ab", "ab ", "b c", " c ", " é ", "é é", " é "] and sizes.tolist() == [4, 0, 3]
    assert languages.learn(docs.limit(0)).score(["some text"])[0] == ["unknown"]


def test_types_follow_the_mime_table(spark):
    want = {"X.MD": "markdown", "a.DOCX": "docx", "noend": "text", "a.csv": None, "a.exe": None, "a.tsv": None, "a.bmp": None, "a.webp": None, "a.c": "text", "a.HTM": "html", "b.txt.gz": "text", "b.tgz": None, ".csv": "text", "dir.csv/x": "text", "a.unknown": "text", ".md": "markdown", "a.": "text"}
    got = spark.createDataFrame([(k,) for k in want], "f string").select("f", files.type_of(F.col("f")).alias("t")).collect()
    assert {r["f"]: r["t"] for r in got} == want


@pytest.mark.parametrize(("text", "want"), [("e\u0301te\u0301", "été"), ("l\u00e2\u20ac\u2122\u00c3\u00a9t\u00c3\u00a9", "l'été"), ("déjà vu », Ã", "déjà vu », Ã"), ("a\r\nb \ufb01", "a\nb fi"), ("日本語", "日本語"), (None, None)])
def test_unicode_repair(spark, text, want):
    assert one(spark, text, repair_unicode) == want


def read_wrongly(text, encoding):
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("encoding", mojibake.ENCODINGS)
def test_damaged_stretches_among_good_words(encoding):
    for word in ("été", "Mädchen aß Käse", "l’école — “où”", "Привет мир", "naïve œuvre", "señor ¿qué?", "ÉCOLE", "10 € für 日本語"):
        bad = read_wrongly(word, encoding)
        assert mojibake.repaired(f"Größe déjà vu « là » {bad} und Käse") == f"Größe déjà vu « là » {word} und Käse"
        if encoding == "cp1252":  # twice
            assert mojibake.repaired(read_wrongly(bad, encoding)) == word
    assert mojibake.repaired(f"{read_wrongly('été', 'cp1252')} et {read_wrongly('Привет', 'cp1251')}") == "été et Привет"


def test_good_texts_stay_as_they_are(spark):
    good = ["Рёв льва и ёж", "déjà vu », Ã", "Ãcole", "Â» ok", "¿Qué? ¡Sí!", "«Él» l’été", "naïve – “œuvre”", "π≈3, √2 ≤ 3", "SÃO PAULO", "ΑΒΓ αβγ", "“É” ‘à’", "100 €, 5 £ ±2", "Èéç Íñí", "日本語", "", "plain"]
    assert [mojibake.repaired(t) for t in good] == good
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    assert docs.filter(~F.col("text").eqNullSafe(repair_unicode(F.col("text")))).count() == 0
    bad = spark.createDataFrame([(read_wrongly("é", e),) for e in mojibake.ENCODINGS], "t string")
    assert bad.filter(F.col("t").rlike(mojibake.suspicious())).count() == 4


def test_json_array(spark, tmp_path):
    import json

    chunks = spark.range(7).repartitionByRange(3, "id").sortWithinPartitions("id").select(F.concat(F.lit('a"\n'), "id").alias("text"), F.struct(F.lit("é.txt").alias("filename")).alias("metadata"))
    path = tmp_path / "json"
    assert export.write_chunks(chunks, str(path), "JSON") and not export.write_chunks(chunks.limit(0), str(tmp_path / "none"), "JSON")
    whole = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert json.loads(whole) == [{"text": f'a"\n{i}', "metadata": {"filename": "é.txt"}} for i in range(7)] and "\n    " in whole


def test_process_raw(spark):
    rows = [("a.txt", 1, b"Old text."), ("b.txt", 2, b""), ("c.csv", 3, b"x"), ("a.txt", 4, b"New text. More."), ("a.txt", 5, b""), ("d.html", 6, b"<p>Hi</p>"), ("e.txt", 7, None)]
    raw = spark.createDataFrame([(n, i, bytearray(d) if d is not None else None) for n, i, d in rows], "filename string, ordinal long, content binary")
    out = ingest.process_raw(raw)
    assert sorted((r["position"], r["filename"], r["content"], r["stats"]["original_length"]) for r in out.documents.collect()) == [(1, "a.txt", "New text. More.", 15), (6, "d.html", "Hi", 2)]
    assert sorted((r["filename"], r["chunk_ix"], r["text"], r["metadata"]["type"]) for r in out.chunks.collect()) == [("a.txt", 0, "New text. More.", "text"), ("d.html", 0, "Hi", "html")]
    assert sorted((r["ordinal"], r["filename"]) for r in out.errors.collect()) == [(2, "b.txt"), (3, "c.csv"), (5, "a.txt"), (7, "e.txt")]
    assert ingest.process_raw(raw.limit(0)).documents.count() == 0


def test_store_sees_all_or_nothing(spark, tmp_path):
    from stores import FolderStore

    chunks = spark.range(250).coalesce(1).select(F.concat(F.lit("chunk_"), "id").alias("id"), F.array(F.lit(0.5)).alias("vector"), F.col("id").alias("start"), F.lit(None).cast("string").alias("language"), F.array(F.lit("a")).alias("tags"), F.lit(1.5).alias("score"), F.lit(True).alias("ok"))
    store = FolderStore(tmp_path)
    done = export.export_vectors(chunks, "pinecone", writer=store, dimension=8).first()
    assert (done["status"], done["chunks_uploaded"]) == ("success", 250)
    assert sorted(map(len, store.batches())) == [50, 100, 100] and {r["id"] for b in store.batches() for r in b} == {f"chunk_{i}" for i in range(250)}
    assert json.loads((tmp_path / "schema.json").read_text()) == [8, {"start": "int", "language": "text", "tags": "text[]", "score": "number", "ok": "boolean"}]
    done = export.export_vectors(chunks.repartition(3), "chroma", writer=FolderStore(tmp_path, fails=99)).first()
    assert done["status"] == "error" and "connection broke" in done["message"]
    assert len(store.batches()) == 3  # tasks that still ran may have left something staged, unseen
    assert export.export_vectors(chunks.limit(0), "weaviate", writer=store).first()["chunks_uploaded"] == 0


def test_repeated_tasks_store_nothing_twice(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent
    code = f"""
import sys
sys.path[:0] = [{str(here)!r}, {str(here.parent)!r}]
from pyspark.sql import SparkSession, functions as F
from stores import FolderStore
from textloom.operators import export
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(600).repartition(3).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"))
print("DONE", export.export_vectors(rows, "weaviate", writer=FolderStore({str(tmp_path)!r}, fails=2)).first()["chunks_uploaded"])
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(here), str(here.parent)])}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert "DONE 600" in done.stdout, done.stderr[-2000:]
    from stores import FolderStore

    ids = [r["id"] for b in FolderStore(tmp_path).batches() for r in b]
    assert len(ids) == 600 == len(set(ids)) and FolderStore(tmp_path).batches("staged") == []


def test_edges_as_brute_force(spark):
    v = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = sorted((r[0], r[1], round(r[2], 9)) for r in structure.similarity_edges(df, "id", "v", 0.5, block=16).collect())
    assert got == [(i, j, round(float(v[i] @ v[j]), 9)) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] > 0.5]
    assert structure.similarity_edges(df.limit(0), "id", "v").count() == 0


def test_structure_documents(spark):
    texts = [("apples", "red apple tree and green apple"), ("apples2", "green apple tree and red apple"), ("sea", "blue water in a deep river and sea")]
    docs = spark.createDataFrame([(i, f"{n}.txt", t) for i, (n, t) in enumerate(texts)], "ix long, filename string, content string")
    out = structure.structure_documents(docs)
    assert out.status == "success" and out.topics.count() == 2
    assert sorted([d["ix"] for d in r["documents"]] for r in out.clusters.collect()) == [[0, 1], [2]]
    assert ("apples.txt", "apples2.txt") in {(r["source"], r["target"]) for r in out.relationships.collect()} and out.central.count() == 3
    assert structure.structure_documents(docs.drop("content").withColumn("content", F.lit(1))).status == "error"
    one_ = structure.structure_documents(docs.limit(1).withColumn("content", F.lit("")))
    assert one_.status == "success" and one_.topics.first()["words"] == ["apples.txt"]
