"""Chunk records and sinks: JSON, JSON Lines, CSV, Markdown and vector stores."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from textloom.tables import materialise, release

#: Rows of a batch, dimension of a new index, name of an exported file, what each store is called, file extension and MIME type per format.
BATCH, DIMENSION = 100, 768
EXPORT_NAME = "rag_chunks"
STORES = ("pinecone", "weaviate", "chroma")
FORMATS = {"JSON": ("json", "application/json"), "JSONL": ("jsonl", "application/x-jsonlines"), "CSV": ("csv", "text/csv"), "Markdown": ("md", "text/markdown")}
CSV_COLUMNS = ["text", "start", "end", "strategy", "filename", "type"]


def last_wins(docs: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per key, that of the greatest ordinal, with `position`: the smallest ordinal of the key."""
    others = [c for c in docs.columns if c != key]
    row = F.struct(*others)
    latest = F.struct(F.col(ordinal).alias("o"), F.xxhash64(F.to_json(row)).alias("h"))  # of equal ordinals always the same row
    best = docs.groupBy(key).agg(F.max_by(row, latest).alias("r"), F.min(ordinal).alias("position"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in others), "position")


def csv_projection(chunks: DataFrame) -> DataFrame:
    return chunks.select("text", "start", "end", "strategy", F.col("metadata.filename").alias("filename"), F.col("metadata.type").alias("type"))


def json_lines(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "true"}).alias("value"))


def json_array(chunks: DataFrame) -> DataFrame:
    """(value): the lines of one indented JSON array, in the order of chunks. Written as text, the files make the array when put together by name.

    chunks is read twice and has to come in the same order both times.
    """
    rows = chunks.select(F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "true", "pretty": "true"}).alias("v"), F.monotonically_increasing_id().alias("__at"))
    first, last = rows.agg(F.min("__at"), F.max("__at")).first()
    body = F.concat(F.lit("  "), F.replace("v", F.lit("\n"), F.lit("\n  ")))  # line feeds inside strings are escaped
    return rows.select(F.concat(F.when(F.col("__at") == first, "[\n").otherwise(""), body, F.when(F.col("__at") == last, "\n]").otherwise(",")).alias("value"))


def markdown_block(filename: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("## Chunk from "), filename, F.lit("\n")), text, F.lit("\n---\n"))


def write_chunks(chunks: DataFrame, path: str, fmt: str) -> bool:
    """Write below path; False and nothing written if there are no chunks. JSON is one array over all files, in the order of their names."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if chunks.isEmpty():
        return False
    if fmt == "JSON":
        json_array(chunks).write.text(path)
    elif fmt == "JSONL":
        json_lines(chunks).write.text(path)
    elif fmt == "CSV":
        csv_projection(chunks).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        chunks.select(markdown_block(F.col("metadata.filename"), F.col("text")).alias("value")).write.text(path)
    return True


#: What begins a file of each format, what ends a row, and what takes the place of the last row's end.
_FRAMES = {"JSON": ("[\n", ",\n", "\n]"), "JSONL": ("", "\n", "\n"), "CSV": (",".join(CSV_COLUMNS) + "\n", "\n", "\n"), "Markdown": ("", "\n", "\n")}


def _rows_of(chunks: DataFrame, fmt: str) -> Column:
    whole = F.struct(*chunks.columns)
    if fmt == "JSON":
        return F.concat(F.lit("  "), F.replace(F.to_json(whole, {"ignoreNullFields": "true", "pretty": "true"}), F.lit("\n"), F.lit("\n  ")))
    if fmt == "JSONL":
        return F.to_json(whole, {"ignoreNullFields": "true"})
    if fmt == "Markdown":
        return markdown_block(F.col("metadata.filename"), F.col("text"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    value = lambda c: F.when(c.cast("string").rlike(r'[",\r\n]|^\s|\s$'), quoted(c)).otherwise(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat_ws(",", *(value(F.col(c)) for c in ("text", "start", "end", "strategy", "metadata.filename", "metadata.type")))


def write_file(chunks: DataFrame, order: list[str], path: str, fmt: str) -> dict | None:
    """One file of a format, in the order of the columns `order`; its name with the format's ending, MIME type, bytes and rows, or None if there are no chunks.

    Rows are sorted range by range and stored with their place among the bytes of their range; the ranges' sizes, one number each, tell where
    each row stands in the file, and the tasks write there side by side. A repeated task writes the same bytes to the same place, and the file gets its name when it is
    whole. `path` is in a folder that the driver and all executors mount; a folder (with `/` at its end) gets a file called EXPORT_NAME.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if "://" in path:
        raise ValueError("one file is written in a mounted folder: give a path without a scheme")
    head, end, last = (x.encode() for x in _FRAMES[fmt])
    rows = chunks.repartitionByRange(*order).sortWithinPartitions(*order).select(_rows_of(chunks, fmt).cast("binary").alias("value"))

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + len(end)
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part)), pa.array(ends - sizes), pa.array(ends), batch.column(0)], names=["part", "at", "until", "value"])
            at = int(ends[-1]) if len(ends) else at

    placed = materialise(rows.mapInArrow(place, "part long, at long, until long, value binary"), "file")
    parts = sorted(placed.groupBy("part").agg(F.max("until"), F.count(F.lit(1))).collect())  # a row for each range
    if not parts:
        return None
    starts, total = {}, len(head)
    for part, size, _ in parts:
        starts[part] = total
        total += size
    name = f"{path}{EXPORT_NAME if path.endswith('/') else ''}.{FORMATS[fmt][0]}"
    partial = f"{name}.{uuid.uuid4().hex}.partial"
    with open(partial, "wb") as f:
        f.write(head)
        f.truncate(total)

    def put(batches):
        with open(partial, "r+b", buffering=0) as f:
            for batch in batches:
                for part, at, value in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                    os.pwrite(f.fileno(), value + end, starts[part] + at)
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])
            os.fsync(f.fileno())

    n = placed.mapInArrow(put, "n long").agg(F.sum("n")).first()[0]
    with open(partial, "r+b") as f:
        os.pwrite(f.fileno(), last, total - len(end))
    os.replace(partial, name)
    release(placed)
    return {"name": name, "mime": FORMATS[fmt][1], "bytes": total, "rows": n}


def preview(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("metadata.filename").alias("filename"), F.col("metadata.type").alias("type"), F.format_string("%.1f KB", F.bround(F.col("metadata.size") / 1024, 1)).alias("size"), F.coalesce("metadata.language", F.lit("unknown")).alias("language"))


def chunk_label(ix: Column, text: Column, start: Column, end: Column) -> Column:
    return F.format_string("Chunk %d (%d characters, %d-%d)", ix + 1, F.length(text), start, end)


def numbered(rows: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """rows with their place, from 0, in the order of the columns `order`, which should tell all rows apart.

    Rows are evaluated and sorted once, range by range, into a stage table; a range's first place is the sum of the sizes of
    those before it, which is one row per range. So no task sees all rows, and none of `order`'s values has to be whole in one.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered").withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("__part").agg(F.max("__row").alias("n"))
    starts = sizes.select("__part", F.coalesce(F.sum(F.col("n") + 1).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__at", "__part", "__row", "__start")


def vector_records(chunks: DataFrame, order: list[str], stable: list[str] | None = None) -> DataFrame:
    """chunks with row_id, id `chunk_<row_id>` and batch, counted over all files in `order`.

    With `stable` an id is made of the hash of these columns instead, so it stays if other files come or go, and a store replaces the record.
    """
    name = F.col("row_id").cast("string")
    if stable:
        name = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(str(i)) for i, c in enumerate(stable)))).cast("binary"), 256)
    return numbered(chunks, order).withColumns({"id": F.concat(F.lit("chunk_"), name), "batch": F.floor(F.col("row_id") / BATCH).cast("long")})


class VectorStore:
    """What a vector store's client has to do; clients are sent to the executors, so connections belong into open().

    Records are staged under a key by the tasks and show only once they are published. A task that is repeated stages under another key, and
    only the keys of the tasks that counted are published, so nothing is stored twice or by half. Tasks that still run while a job is given
    up may leave something staged, which nobody sees.
    """

    def create(self, dimension: int, properties: dict[str, str]) -> None:
        """Makes the index, class or collection with its typed properties if it is missing; called once, on the driver."""

    def open(self) -> None:
        """Called in each task before its first batch, and on the driver before publish() or discard()."""

    def stage(self, key: str, batch: list[dict]) -> None:
        """Takes at most BATCH records under a key, unseen by readers."""
        raise NotImplementedError

    def publish(self, keys: list[str]) -> None:
        """Makes all that is staged under the keys visible, at once; a record replaces one of the same id. May be called again with the same keys."""
        raise NotImplementedError

    def discard(self, prefix: str) -> None:
        """Forgets all that is staged under keys that start so."""
        raise NotImplementedError


#: Names of property types in a store that has a typed schema.
PROPERTY_TYPES = {"string": "text", "boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "number", "double": "number", "timestamp": "date", "date": "date"}


def properties(schema: StructType) -> dict[str, str]:
    """Property types of a record's columns, without its id and vector; arrays end in `[]`, decimals are numbers, other types are stored as text."""
    out = {}
    for f in schema:
        kind = f.dataType.simpleString()
        base = kind.removeprefix("array<").removesuffix(">")
        named = "number" if base.startswith("decimal") else PROPERTY_TYPES.get(base, "text")
        out[f.name] = named + "[]" * kind.startswith("array<")
    return {k: v for k, v in out.items() if k not in ("id", "vector")}


@dataclass
class Staged(WriterCommitMessage):
    key: str
    records: int


def _sink(store: VectorStore, name: str, batch: int) -> type[DataSource]:
    """A data source of Spark that writes to the store, staged by task and published by the driver's commit."""

    class Writer(DataSourceWriter):
        def write(self, rows) -> Staged:
            key = f"{name}-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
            store.open()
            n, rows = 0, iter(rows)
            while some := [r.asDict(recursive=True) for r in islice(rows, batch)]:
                store.stage(key, some)
                n += len(some)
            return Staged(key, n)

        def commit(self, messages) -> None:
            store.open()
            store.publish([m.key for m in messages if m is not None and m.records])
            store.discard(f"{name}-")  # what repeated tasks have left

        def abort(self, messages) -> None:
            store.open()
            store.discard(f"{name}-")

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite) -> DataSourceWriter:
            return Writer()

    return Sink


def write_batches(records: DataFrame, store: VectorStore, dimension: int = DIMENSION, batch: int = BATCH) -> int:
    """Sends records to a store by batches of `batch` from the executors, all or none; returns their number.

    Records are evaluated once, into a stage table, so that ids that are made up on the way are the same if a task is repeated.
    """
    spark = records.sparkSession
    records = materialise(records, "records")
    store.create(dimension, properties(records.schema))
    name = f"store_{uuid.uuid4().hex}"
    spark.dataSource.register(_sink(store, name, batch))
    records.write.format(name).mode("append").save()
    n = records.count()
    release(records)
    return n


def _prepared(records: DataFrame, store: str) -> DataFrame:
    if store == "chroma":
        return records.withColumn("language", F.coalesce("language", F.lit("unknown")))
    return records.withColumn("id", F.expr("uuid()")) if store == "weaviate" else records


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of a Parquet stand-in of a store: its newest whole version, or None."""
    fs, folder = _folder(spark, path)
    versions = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [v for v in versions if v.startswith("v") and fs.exists(_path(spark, f"{path}/{v}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(whole)}") if whole else None


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str):
    folder = _path(spark, path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def export_vectors(records: DataFrame, store: str, path: str | None = None, writer: VectorStore | None = None, dimension: int = DIMENSION) -> DataFrame:
    """Sends records(id, vector, text, filename, type, language, start, end) to a store, by `writer` or into a Parquet stand-in below `path`; one result row.

    pinecone and chroma replace records of equal ids, weaviate appends under fresh ids; chroma stores unknown languages as
    `unknown`. The stand-in gets a new version that counts only once it is whole, so a crash leaves the one before; of
    equal ids in one call any one stays. Failures become a row with status `error`.
    """
    spark, kinds = records.sparkSession, "status string, database string, index string, chunks_uploaded long, message string"
    try:
        if store not in STORES:
            raise ValueError(f"unsupported vector store: {store}")
        out = _prepared(records, store)
        if writer is not None:
            return spark.createDataFrame([("success", store, path, write_batches(out, writer, dimension), None)], kinds)
        if path is None:
            raise ValueError("give a writer or a path")
        old, n = stored(spark, path), records.count()
        if store != "weaviate":
            out = out.dropDuplicates(["id"])
        if old is not None:
            old = old if store == "weaviate" else old.join(out.select("id"), "id", "left_anti")
            out = old.unionByName(out, allowMissingColumns=True)
        out.write.parquet(f"{path}/v{time.time_ns():020d}")
        return spark.createDataFrame([("success", store, path, n, None)], kinds)
    except Exception as e:
        return spark.createDataFrame([("error", store, path, None, str(e))], kinds)
