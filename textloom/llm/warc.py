"""WARC archives: writing with revisit records, reading back, and a globally ordered capture index.

Spark's text writer stores the records (each ends with the line separator CR LF CR LF that WARC asks for), so archives
can lie in any store that Spark reaches; files are bounded by bytes. Reading parses whole files by Content-Length. The
index sorts captures into a run where they are read; of each run every range of (URL key, timestamp, record id, archive,
offset) gets its part, still sorted, and a loser tree merges the parts. What precedes a range, of all captures and of its
first URL, is added up from one row per range, so histories and positions run on from range to range.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.shared import fresh_path, joinable, materialise, partitions_for, table

CRLF, LEAST_BYTES, BROADCAST_ROWS, FILE_BYTES, FILE_RECORDS = "\r\n", 100, 200_000, 1 << 27, 4096
RECORD = "record_id long, record_type string, url string, ts string, payload_bytes long, payload_digest string, refers_to long, payload binary, archive string, offset long, length long"


def decisions(pages: DataFrame, record_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(digest, first_id): the smallest id of each payload of at least LEAST_BYTES that several records share."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(record_id).alias("id"), F.length(data).alias("n"), F.sha2(data, 256).alias("digest")).filter(F.col("n") >= LEAST_BYTES)
    return rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first_id")


def write_archives(pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", epoch: str = "2020-01-01 00:00:00", records_per_file: int | None = None) -> None:
    """Write one response or revisit record per row below `path`, as uncompressed WARC/1.1.

    Of equal payloads of at least LEAST_BYTES bytes the smallest id is the response (rows that repeat it too), the others
    are revisits without a payload; smaller and null (empty) payloads are always responses. The capture time is `epoch`
    plus the id in seconds: the table holds none. URLs are percent-encoded where a header could break; a null URL is
    left out. The deduplicating digests are broadcast only if counted and few; otherwise they are joined by shuffling.
    A file holds so many records that the longest would fill FILE_BYTES, FILE_RECORDS at most and one at least. An empty
    table writes no records; rows that repeat a record id are records of their own.
    """
    if records_per_file is None:
        longest = pages.agg(F.max(F.octet_length(payload)) + 1024).first()[0] or 1
        records_per_file = max(1, min(FILE_RECORDS, FILE_BYTES // longest))
    firsts = materialise(decisions(pages, record_id, payload), "warc-firsts")
    firsts = joinable(firsts, firsts.count(), BROADCAST_ROWS)
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(record_id).alias("id"), F.col(url).alias("url"), text.alias("payload"), F.sha2(text.cast("binary"), 256).alias("digest")).join(firsts, "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("id") != F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    safe = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_timestamp(F.lit(epoch)) + F.make_dt_interval(secs=F.coalesce("id", F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
        F.concat(F.lit(CRLF), body),
    )
    rows.select(lines.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(data: bytes):
    """Yield (headers, payload, offset, length) of each record; raises ValueError on a broken archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split(CRLF)
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in head[1:])
        start, n = end + 4, int(headers["Content-Length"])
        stop = start + n + 4
        if data[start + n : stop] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, data[start : start + n], at, stop - at
        at = stop


def _urn(value: str | None) -> int | None:
    return int(value[12:-1]) if value and value[12:-1] != "-" else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records (RECORD) of all archives below `path`. Payload digests of responses are computed anew and compared."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for n, f in zip(names, RECORD.split(", "), strict=True)])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                records = parse_archive(content.as_py())
                while some := list(islice(records, 512)):
                    out = []
                    for h, payload, offset, length in some:
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{archive}, byte {offset}: the payload does not match its digest")
                        out.append((_urn(h["WARC-Record-ID"]), h["WARC-Type"], h.get("WARC-Target-URI"), re.sub(r"\D", "", h["WARC-Date"]), int(h["X-Payload-Length"]) if h["WARC-Type"] == "revisit" else len(payload), digest, _urn(h.get("WARC-Refers-To")), payload if with_payload else None, archive, offset, length))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return files.mapInArrow(run, RECORD)


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host labels, then port, path and query in lower case; no scheme, user, `www.` or fragment."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(url.lower(), safe="/:?&=%")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port not in (None, 80, 443) else ''}){tail.lower()}"


class LoserTree:
    """k-way merge of sorted iterators: each step replays one leaf-to-root path of about log2(k) comparisons."""

    def __init__(self, runs: list, key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [0] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (self.key(x), a) < (self.key(y), b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        self.losers[node] = b if self._beats(a, b) else a
        return a if self._beats(a, b) else b

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            i = self.winner
            self.heads[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


INDEX = "url_key string, ts string, record_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def _runs(keys: list[tuple], sources: list[int]):
    """Cuts rows into their sorted runs: where the source changes or a key is smaller than the one before."""
    cuts = [0, *(i for i in range(1, len(keys)) if sources[i] != sources[i - 1] or keys[i] < keys[i - 1]), len(keys)]
    return [iter(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _merged(batches):
    """The rows of one range in order, with the range's number, the place in it, and the place among the captures of the URL key in it."""
    held = [b for b in batches if len(b)]  # a range has a bounded number of rows
    if not held:
        return
    table = pa.Table.from_batches(held)
    column = lambda name: table[name].to_pylist()
    keys = [(u, t, -1 if i is None else i, a, o) for u, t, i, a, o in zip(*map(column, ("url_key", "ts", "record_id", "archive", "offset")), strict=True)]
    order, nth, last = list(LoserTree(_runs(keys, column("run")), keys.__getitem__)), [], None
    for i in order:
        nth.append(nth[-1] + 1 if keys[i][0] == last else 1)
        last = keys[i][0]
    out = table.drop_columns(["run"]).take(pa.array(order))
    part = pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())
    yield from out.append_column("part", part).append_column("row", pa.array(range(1, len(order) + 1), pa.int64())).append_column("nth", pa.array(nth, pa.int64())).to_batches(8192)


def capture_index(records: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """Captures (INDEX) in order, with `position` in the order of (URL key, timestamp, record id, archive, offset) and `capture`, the number within the URL's history; both count from 1 through all ranges.

    Runs are sorted where they are read; a range holds a bounded share of the rows, and one URL with very many captures is
    split by time. The records are counted first: give a written table. A null URL has the key `-`; null record ids come
    first; records that repeat stay; an empty table gives no rows.
    """
    names = [f.split()[0] for f in INDEX.split(", ")]

    @F.pandas_udf("string")
    def keyed(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    order = ["url_key", "ts", F.coalesce("record_id", F.lit(-1)), "archive", "offset"]
    runs = records.withColumn("url_key", keyed("url")).withColumn("run", F.spark_partition_id()).select(*names, "run").sortWithinPartitions(*order)
    n = partitions_for(records, records.count(), rows_per_range)
    merged = materialise(runs.repartitionByRange(n, *order).mapInArrow(_merged, f"{INDEX}, part int, row long, nth long"), "merged")
    ends = merged.groupBy("part").agg(F.max("row").alias("rows"), F.min("url_key").alias("low"), F.max("url_key").alias("high"))  # one row per range
    ends = materialise(ends, "range-ends")
    edges = F.broadcast(ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("url_key")))  # two per range at most
    counts = merged.join(edges, ["part", "url_key"]).groupBy("part", "url_key").agg(F.max("nth").alias("n"))
    earlier = lambda by: by.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    open_ = counts.select("part", "url_key", F.coalesce(F.sum("n").over(earlier(W.partitionBy("url_key"))), F.lit(0)).alias("before"))
    starts = ends.select("part", F.coalesce(F.sum("rows").over(earlier(W.partitionBy())), F.lit(0)).alias("start"))
    out = merged.join(F.broadcast(starts), "part").join(F.broadcast(open_), ["part", "url_key"], "left")
    return out.select(*names, (F.col("start") + F.col("row")).alias("position"), (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("capture")).orderBy("position")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = materialise(read_archives(spark, path, with_payload=False).drop("payload"), "captures")
    return capture_index(captures).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "position", "capture")


#: URL keys of http and https URLs without user, port or fragment-like host parts, as all pages have them.
OP5_SQL = r"""
WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  regexp_extract(url, '^https?://(www\.)?([^/?#]*)([^?#]*)([?][^#]*)?', ['w', 'host', 'path', 'query']) AS u,
  strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS ts FROM pages),
k AS (SELECT *, CASE WHEN u.host IS NULL OR u.host = '' THEN '-' ELSE array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || ')' || lower((CASE WHEN u.path = '' THEN '/' ELSE u.path END) || u.query) END AS url_key,
  min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, url_key, ts,
       row_number() OVER (ORDER BY url_key, ts, page_id) AS position,
       row_number() OVER (PARTITION BY url_key ORDER BY ts, page_id) AS capture
FROM k
"""
