"""From files to chunks in one call: extract, clean, count, chunk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import chunking, cleaning
from textloom.functions.cleaning import CleanOptions
from textloom.operators.export import last_wins
from textloom.sources import files, pdf
from textloom.tables import materialise


@dataclass
class Processed:
    """documents(filename, content, metadata, stats, position), chunks(filename, position, chunk_ix, text, start, end, strategy, level, metadata), errors(filename, ordinal, error)."""

    documents: DataFrame
    chunks: DataFrame
    errors: DataFrame


def process_files(spark: SparkSession, path: str, options: CleanOptions = CleanOptions(), strategy: str = "Length-based", size: int = 500, overlap: int = 10, extract: Callable | None = pdf.extract, ocr: Callable | None = None) -> Processed:
    """All files below path, in the order of their modification times."""
    return process_raw(files.read_raw(spark, path), options, strategy, size, overlap, extract, ocr)


def process_raw(raw: DataFrame, options: CleanOptions = CleanOptions(), strategy: str = "Length-based", size: int = 500, overlap: int = 10, extract: Callable | None = pdf.extract, ocr: Callable | None = None) -> Processed:
    """raw(filename, ordinal, content BINARY) through all steps.

    A file that cannot be read, has no text (its reduction cannot be told) or cannot be chunked is a row of `errors` and
    nothing else. Of files with one name the last that succeeded stays, at the position of the first that did.
    """
    docs = files.extract_documents(raw, extract, ocr)
    original = F.col("content")
    docs = docs.withColumn("cleaned", cleaning.clean_text(original))
    stats = F.struct(*(v.alias(k) for k, v in cleaning.clean_stats(original, F.col("cleaned")).items()))
    why = F.coalesce("error", F.when(F.coalesce(F.length(original), F.lit(0)) == 0, "no text: its reduction cannot be told"))
    read = materialise(docs.select("filename", "ordinal", "metadata", why.alias("error"), F.col("cleaned").alias("content"), stats.alias("stats")), "processed")
    good, key = read.filter("error IS NULL").drop("error"), ["filename", "ordinal"]
    rows = materialise(chunking.chunk(good.select(*key, "content", "metadata"), strategy, size, overlap, "content", errors=True), "chunks")
    stuck = rows.filter("error IS NOT NULL").select(*key, "error")
    documents = materialise(last_wins(good.join(stuck, key, "left_anti"), "filename", "ordinal"), "documents")
    chunks = rows.filter("error IS NULL").drop("error").join(documents.select(*key, "position"), key).drop("ordinal")
    return Processed(documents.drop("ordinal"), chunks, read.filter("error IS NOT NULL").select(*key, "error").unionByName(stuck))
