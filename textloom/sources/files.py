"""Files of many formats as document rows: (filename, ordinal, content, html_content, metadata, error)."""

from __future__ import annotations

import io
import mimetypes
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import pdf

METADATA = "struct<filename:string,type:string,size:bigint,size_bytes:bigint,language:string,sheets:array<string>,slides:int,pages:int,pdf_metadata:map<string,string>,ocr_applied:boolean,meta_tags:map<string,string>>"
DOCUMENT = f"filename string, ordinal bigint, content string, html_content string, metadata {METADATA}, error string"
#: The MIME types that have a handler, and endings that stand for one whatever the MIME table says.
HANDLERS = {
    "text/plain": "text",
    "text/markdown": "markdown",
    "application/pdf": "pdf",
    "text/html": "html",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
ENDINGS = {"md": "markdown", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
#: Built-in number formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
OCR_BELOW, OCR_CONFIDENCE = 100, 0.5
#: Function words that vote for a language, most frequent first.
STOP_WORDS = {"en": ["the", "of", "and", "to", "in", "that", "is", "was"], "fr": ["de", "la", "le", "et", "les", "des", "une", "est"], "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "zu"], "es": ["el", "los", "que", "y", "en", "por", "una", "del"]}


def type_of(filename: Column) -> Column:
    """The handler for a file name by Python's own MIME table: names that it cannot guess are text, types without a handler null.

    An ending of a compression (as in `a.txt.gz`) is left off, as the table does; a leading dot makes no ending."""
    known = mimetypes.MimeTypes(filenames=())
    table = {ext[1:]: HANDLERS.get(mime, "") for ext, mime in known.types_map[1].items()}
    for short, long in known.suffix_map.items():  # .tgz is .tar.gz
        table[short[1:]] = table.get(long.split(".")[1], "text")
    table |= ENDINGS
    packed = "|".join(re.escape(x[1:]) for x in known.encodings_map)
    name = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), rf"(?<=[^.])\.({packed})$", "")
    ext = F.regexp_extract(F.lower(name), r"^\.*[^.].*\.([^.]*)$", 1)
    kinds = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    kind = F.nullif(F.coalesce(F.element_at(kinds, ext), F.lit("text")), F.lit(""))
    for ending, handler in ENDINGS.items():
        kind = F.when(F.lower(filename).endswith(f".{ending}"), handler).otherwise(kind)
    return kind


def kind_of(filename: str) -> str | None:
    """type_of() of one name."""
    known = mimetypes.MimeTypes(filenames=())
    for ending, handler in ENDINGS.items():
        if filename.lower().endswith(f".{ending}"):
            return handler
    mime = known.guess_type(re.split(r"[/\\]", filename)[-1])[0]
    return "text" if mime is None else HANDLERS.get(mime)


def detect_language(text: Column) -> Column:
    """The language whose stop words occur most as distinct words; ties go to the first in STOP_WORDS, none is `unknown`."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    votes = {k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) for k, v in STOP_WORDS.items()}
    best = F.greatest(*votes.values())
    found = F.lit("unknown")
    for k in reversed(votes):
        found = F.when(votes[k] == best, k).otherwise(found)
    return F.when(F.coalesce(best, F.lit(0)) == 0, "unknown").otherwise(found)


class _Text(HTMLParser):
    """Text nodes outside script, style and template, and meta tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.meta, self.hidden, self.last_meta, self.buffer = [], {}, 0, None, []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in ("script", "style", "template"):
            self.hidden += 1
        if tag == "meta":
            a = {k: v or "" for k, v in attrs}
            name, self.last_meta = a.get("name", a.get("property", "")), a.get("content", "")
            if name and self.last_meta:
                self.meta[name] = self.last_meta

    def handle_endtag(self, tag):
        self._flush()
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)

    def _flush(self):
        if piece := "".join(self.buffer).strip():
            self.parts.append(piece)
        self.buffer = []


def parse_html(text: str) -> tuple[str, dict[str, str], str | None]:
    """(text nodes joined by line feeds, meta tags, content of the last meta tag)."""
    p = _Text()
    p.feed(text)
    p.close()
    p._flush()
    return "\n".join(p.parts), p.meta, p.last_meta


def render_markdown(text: str) -> str:
    """Headings, lists, code fences, emphasis, links and paragraphs of Markdown."""
    span = lambda s: re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', re.sub(r"\*(.+?)\*", r"<em>\1</em>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", re.sub(r"`([^`]+)`", r"<code>\1</code>", escape(s, quote=False)))))
    out = []
    for block in re.split(r"\n\s*\n", text.strip()):
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", block):
            out.append(f"<h{len(m[1])}>{span(m[2])}</h{len(m[1])}>")
        elif block.startswith("```"):
            out.append(f"<pre><code>{escape(block.strip('`').lstrip())}</code></pre>")
        elif re.match(r"[-*+] ", block):
            out.append("<ul>\n" + "\n".join(f"<li>{span(x[2:])}</li>" for x in block.split("\n")) + "\n</ul>")
        elif block:
            out.append(f"<p>{span(block)}</p>")
    return "\n".join(out)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _part(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name))


def read_docx(data: bytes) -> tuple[str, dict]:
    """Paragraphs in order, then the rows of all tables."""
    text = lambda e: "".join("\t" if _tag(x) == "tab" else "\n" if _tag(x) in ("br", "cr") else x.text or "" for x in e.iter() if _tag(x) in ("t", "tab", "br", "cr"))
    cell = lambda e: "\n".join(text(p) for p in e if _tag(p) == "p")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _part(z, "word/document.xml") if _tag(e) == "body")
    lines = [text(e) for e in body if _tag(e) == "p"]
    for t in (e for e in body if _tag(e) == "tbl"):
        lines += [" | ".join(cell(c) for c in r if _tag(c) == "tc") for r in t if _tag(r) == "tr"]
    return "\n".join(lines), {}


def _related(z: zipfile.ZipFile, folder: str, part: str) -> dict[str, str]:
    return {r.get("Id"): (t[1:] if (t := r.get("Target")).startswith("/") else f"{folder}/{t}") for r in _part(z, f"{folder}/_rels/{part}.rels")}


def read_xlsx(data: bytes) -> tuple[str, dict]:
    """A marker per sheet, then its rows without empty cells; formulas rather than their cached values."""
    out, names = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in _part(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        related, book = _related(z, "xl", "workbook.xml"), _part(z, "xl/workbook.xml")
        dates = _date_styles(_part(z, "xl/styles.xml")) if "xl/styles.xml" in z.namelist() else {}
        late = any(_tag(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
        for sheet in (s for s in book.iter() if _tag(s) == "sheet"):
            names.append(sheet.get("name"))
            out.append(f"\n### Worksheet: {names[-1]} ###\n")
            target = related[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            for row in (r for r in _part(z, target).iter() if _tag(r) == "row"):
                cells = [v for c in row if _tag(c) == "c" and (v := _cell(c, shared, dates, epoch)) is not None]
                if cells:
                    out.append(" | ".join(cells))
    return "\n".join(out), {"sheets": names}


def _date_styles(styles) -> dict[int, bool]:
    """Cell styles whose numbers are dates or times, and whether they are durations."""
    codes = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _tag(e) == "numFmt"}
    out = {}
    for i, xf in enumerate(x for e in styles.iter() if _tag(e) == "cellXfs" for x in e if _tag(x) == "xf"):
        n = int(xf.get("numFmtId", 0))
        code = re.sub(r'"[^"]*"|\\.|_.|\*.', "", codes.get(n, "")).split(";")[0].lower()
        length = re.search(r"\[(h+|m+|s+)\]", code) is not None or n == 46
        if n in DATE_FORMATS or length or re.search("[dmyhs]", re.sub(r"\[[^\]]*\]|general", "", code)):
            out[i] = length
    return out


def _moment(value: float, epoch: datetime, length: bool) -> str:
    """A serial number of days as a date with its time, a time of day below 1, or a duration."""
    day, part = divmod(value, 1)
    part = timedelta(milliseconds=round(part * 86_400_000))
    if length:
        return str(timedelta(days=day) + part)
    if 0 <= value < 1 and not part.days:
        return str((datetime.min + part).time())
    day += 0 < value < 60 and epoch.year == 1899  # the day that 1900 did not have
    return str(epoch + timedelta(days=day) + part)


def _cell(c, shared: list[str], dates: dict[int, bool], epoch: datetime) -> str | None:
    kids = {_tag(k): k for k in c}
    if "f" in kids and kids["f"].text:
        return f"={kids['f'].text}"
    if "is" in kids:
        return "".join(t.text or "" for t in kids["is"].iter() if _tag(t) == "t")
    raw, kind = kids["v"].text if "v" in kids else None, c.get("t", "n")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return {"1": "True", "0": "False"}[raw]
    if kind == "d":
        return str(datetime.fromisoformat(raw))
    if kind == "n" and int(c.get("s", 0)) in dates:
        return _moment(float(raw), epoch, dates[int(c.get("s", 0))])
    return str(float(raw)) if kind == "n" and re.search("[.eE]", raw) else raw


def read_pptx(data: bytes) -> tuple[str, dict]:
    """A marker per slide, then the texts of its top-level shapes."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        related = _related(z, "ppt", "presentation.xml")
        slides = [related[next(v for k, v in s.attrib.items() if k.endswith("}id"))] for s in _part(z, "ppt/presentation.xml").iter() if _tag(s) == "sldId"]
        for i, name in enumerate(slides, 1):
            out.append(f"\n### Slide {i} ###\n")
            tree = next(e for e in _part(z, name).iter() if _tag(e) == "spTree")
            for shape in (e for e in tree if _tag(e) == "sp"):
                paragraphs = ["".join("\v" if _tag(t) == "br" else t.text or "" for t in p.iter() if _tag(t) in ("t", "br")) for b in shape if _tag(b) == "txBody" for p in b if _tag(p) == "p"]
                if any(paragraphs):
                    out.append("\n".join(paragraphs))
    return "\n".join(out), {"slides": len(slides)}


def confident(results: list[tuple]) -> str:
    """OCR results (box, text, confidence) above the confidence, line by line."""
    return "\n".join(t for _, t, c in results if c > OCR_CONFIDENCE)


def read_pdf(data: bytes, extract: Callable | None, ocr: Callable | None) -> tuple[str, dict]:
    """extract(bytes) gives (list of page texts, info); ocr(bytes, page) OCR results for pages with little text. Appended OCR texts count as pages."""
    if extract is None:
        raise ValueError("no PDF extractor is set")
    pages, info = extract(data)
    out, applied = [], False
    for i, page in enumerate(pages):
        out.append(page or "")
        if len((page or "").strip()) < OCR_BELOW and ocr is not None and (seen := confident(ocr(data, i))).strip():
            out.append(seen)
            applied = True
    return "\n".join(out), {"pages": len(out), "pdf_metadata": {str(k): str(v) for k, v in (info or {}).items()}, "ocr_applied": applied}


def process_document(data: bytes, filename: str, kind: str | None, extract: Callable | None = None, ocr: Callable | None = None) -> dict:
    """One document row without its language; failures become `error`."""
    row = {"content": None, "html_content": None, "error": None, "meta": {"filename": filename, "type": kind, "size": len(data), "size_bytes": len(data)}}
    try:
        if kind is None:
            raise ValueError(f"unsupported file type: {filename}")
        if kind in ("text", "markdown", "html"):
            text = data.decode("utf-8", errors="ignore")
            row["content"] = text
            if kind == "markdown":
                row["html_content"] = render_markdown(text)
            if kind == "html":
                row["content"], tags, last = parse_html(text)
                row["meta"] |= {"meta_tags": tags, "size": len(data) if last is None else len(last)}
        else:
            row["content"], more = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx}[kind](data) if kind != "pdf" else read_pdf(data, extract, ocr)
            row["meta"] |= more
    except Exception as e:  # a broken file is a row with an error, not the end of the job
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(filename, ordinal, content) of all files below path; ordinals are modification times in microseconds."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.unix_micros("modificationTime").alias("ordinal"), F.col("content"))


def read_files(spark: SparkSession, path: str, extract: Callable | None = pdf.extract, ocr: Callable | None = None) -> DataFrame:
    """Documents of all files below path."""
    return extract_documents(read_raw(spark, path), extract, ocr)


def extract_documents(raw: DataFrame, extract: Callable | None = pdf.extract, ocr: Callable | None = None) -> DataFrame:
    """raw(filename, ordinal, content BINARY) as DOCUMENT rows. Languages are detected for office and PDF files only."""
    typed = raw.select("filename", F.col("ordinal").cast("long").alias("ordinal"), "content", type_of(F.col("filename")).alias("kind"))
    fields = [f.split(":")[0] for f in "filename type size size_bytes language sheets slides pages pdf_metadata ocr_applied meta_tags".split()]

    def run(batches):
        for b in batches:
            rows = []
            for name, at, data, kind in zip(b["filename"], b["ordinal"], b["content"], b["kind"], strict=True):
                r = process_document(bytes(data or b""), name or "", kind, extract, ocr)
                rows.append((name, at, r["content"], r["html_content"], {k: r["meta"].get(k) for k in fields}, r["error"]))
            yield pd.DataFrame(rows, columns=["filename", "ordinal", "content", "html_content", "metadata", "error"])

    out = typed.mapInPandas(run, DOCUMENT)
    wants = F.col("metadata.type").isin("docx", "xlsx", "pptx", "pdf") & F.col("error").isNull()
    return out.withColumn("metadata", F.col("metadata").withField("language", F.when(wants, detect_language(F.col("content")))))
