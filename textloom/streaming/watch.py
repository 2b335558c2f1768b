"""Extension: the per-document steps over a watched folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.chunking import chunk
from textloom.functions.cleaning import CleanOptions, clean_text

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, path: str, strategy: str = "Length-based", options: CleanOptions = CleanOptions()) -> DataFrame:
    """A streaming DataFrame of cleaned chunks of the UTF-8 files that appear in a folder; stateless."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(path)
    docs = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), clean_text(F.col("content").cast("string"), options).alias("text"))
    return chunk(docs, strategy)
