"""Table functions that SQL can call by name, once `register(spark)` has run.

    SELECT * FROM chunk_text(TABLE(docs), 'Semantic', 500, 10)
    SELECT * FROM chunk_text(docs => TABLE(SELECT id, body FROM docs), strategy => 'Length-based', text_column => 'body')
    SELECT * FROM document_text(TABLE(files))

Their schemas follow from the table they are given. Every partition of the table is read by an instance of its own, so the work is
spread as the table is; rows are held until they make a batch.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import chunking
from textloom.sources import files as sources
from textloom.sources import pdf

#: Characters of text and rows that an instance holds before it works on them.
HELD_CHARACTERS, HELD_ROWS = 1 << 20, 1024


def _constant(argument: AnalyzeArgument | None, name: str, default):
    """The value of an argument that the schema or the plan depends on."""
    if argument is None:
        return default
    if argument.value is None:
        raise ValueError(f"{name} has to be a constant")
    return argument.value


def _table(argument: AnalyzeArgument, column: str) -> StructType:
    if not argument.isTable:
        raise ValueError("the first argument has to be a table: chunk_text(TABLE(docs), ...)")
    if column not in argument.dataType.fieldNames():
        raise ValueError(f"the table has no column {column!r}, only {argument.dataType.fieldNames()}")
    return argument.dataType


class ChunkText:
    """chunk_text(docs TABLE, strategy, chunk_size, overlap, text_column): rows of chunking.chunk() with errors."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, strategy: AnalyzeArgument | None = None, chunk_size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, text_column: AnalyzeArgument | None = None) -> AnalyzeResult:
        text = _constant(text_column, "text_column", "text")
        schema = _table(docs, text)
        if not isinstance(schema[text].dataType, StringType):
            raise ValueError(f"{text!r} is no string")
        chunking.checked(_constant(strategy, "strategy", "Length-based"), _constant(chunk_size, "chunk_size", 500), _constant(overlap, "overlap", 10))
        return AnalyzeResult(chunking.chunk_schema([StructField(f.name, f.dataType) for f in schema if f.name != text and f.name not in chunking.MADE_NAMES]))

    def __init__(self):
        self.texts, self.others, self.size, self.how = [], [], 0, ("Length-based", 500, 10)

    def eval(self, docs, strategy="Length-based", chunk_size=500, overlap=10, text_column="text"):
        self.how = (strategy, chunk_size, overlap)
        self.texts.append(docs[text_column])
        self.others.append(tuple(docs[c] for c in docs.__fields__ if c != text_column and c not in chunking.MADE_NAMES))
        self.size += len(docs[text_column] or "")
        if self.size >= HELD_CHARACTERS or len(self.texts) >= HELD_ROWS:
            yield from self._flushed()

    def terminate(self):
        yield from self._flushed()

    def _flushed(self):
        texts, others, self.texts, self.others, self.size = self.texts, self.others, [], [], 0
        for row, made in zip(*chunking.chunked(texts, *self.how), strict=True):
            yield (*others[row], *made)


class DocumentText:
    """document_text(files TABLE(filename, content BINARY, ..)): the table's columns without content, then type, text and error of every file."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        schema = _table(files, "content")
        _table(files, "filename")
        made = [StructField(n, StringType()) for n in ("type", "text", "error")]
        return AnalyzeResult(StructType([*(StructField(f.name, f.dataType) for f in schema if f.name not in ("content", "type", "text", "error")), *made]))

    def eval(self, files):
        name = files["filename"] or ""
        kind = sources.kind_of(name)
        read = sources.process_document(bytes(files["content"] or b""), name, kind, pdf.extract)
        yield (*(files[c] for c in files.__fields__ if c not in ("content", "type", "text", "error")), kind, read["content"], read["error"])


def register(spark: SparkSession) -> None:
    """Makes chunk_text and document_text known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("document_text", udtf(DocumentText))
