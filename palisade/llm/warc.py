"""WARC archives and their capture index.

Writing: one record per page. Of pages with equal payloads of at least `MIN_REVISIT` bytes the one with the largest id is a response, the others
are revisits without payload that name it. Records are texts, so Spark's text sink writes the archives: its line separator is the
blank line that ends a record, and no file holds more than `PER_FILE` records. Files are gzipped; offsets count in the plain stream.

Reading: archives are read as whole files (bounded by `PER_FILE` records) and cut by Content-Length, so payloads may hold anything.

Index: every archive gives one capture run sorted by (URL key, timestamp, page). Runs are cut at the bounds of one range partitioning; for each
range the pieces of all runs are merged by a loser tree into one ordered stretch, and the ranges in turn are the global order.
A URL key with very many captures spans several ranges, as bounds are taken over the whole order (key, timestamp, page).
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import save, shared_dir

MIN_REVISIT = 1000
PER_FILE = 2000
RANGE_ROWS = 50_000  # captures per merged range, about
START = "2024-01-01 00:00:00"  # pages have no capture time: page i counts as fetched i seconds after this
END = "\r\n\r\n"


def payload_digest(column: Column) -> Column:
    return F.sha1(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, refers_to): refers_to is null for responses.

    The winner per digest is a partial aggregate (no hot task); only digests that repeat are joined back.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    pages = pages.withColumn("payload_digest", payload_digest(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    repeated = pages.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    joined = pages.join(repeated, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper"))).drop("keeper")


def record(page_id: Column, url: Column, html: Column, digest: Column, refers: Column) -> Column:
    """Text of a record up to, but without, the blank line that ends it."""
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + F.coalesce(page_id, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html), F.lit(END))
    block = F.when(refers.isNull(), F.concat(http, html)).otherwise("HTTP/1.1 200 OK" + END)
    name = F.coalesce(page_id.cast("string"), F.lit("none"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(refers.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Date: "), when,
        F.when(target != "", F.concat(F.lit("\r\nWARC-Target-URI: "), target)).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.when(refers.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END), block,
    )


def write_archives(pages: DataFrame, folder: str) -> str:
    """One WARC record per row of `pages` (page_id, url, html) under `folder`; returns the folder of the archives."""
    rows = classify(pages)
    rows.select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("payload_digest"), F.col("refers_to")).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(f"{folder}/archives")
    return f"{folder}/archives"


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of every record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        start = head + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end after its block")
        yield at, end + 4 - at, headers, data[start:end]
        at = end + 4


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower case, without scheme, `www.` and fragment."""
    rest = url.lower().partition("://")[2] or url.lower()
    host, path = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (path or "/")


_RECORDS = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, url_key string, captured string, archive string, offset long, length long"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def _read(batches):
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for offset, length, headers, block in records(gzip.decompress(data.as_py())):
                kind, number, refers = headers["warc-type"], _ID.match(headers["warc-record-id"]), _ID.match(headers.get("warc-refers-to", ""))
                payload = block.partition(b"\r\n\r\n")[2]
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {headers['warc-record-id']} does not hold")
                url = headers.get("warc-target-uri")
                rows.append((number and int(number[1]), kind, digest, len(payload) if kind == "response" else None, refers and int(refers[1]), url, url_key(url or ""), headers["warc-date"], path.as_py(), offset, length))
            if not rows:  # an archive of an empty partition
                continue
            names = [x.split()[0] for x in _RECORDS.split(", ")]
            types = [pa.int64() if x.endswith("long") else pa.string() for x in _RECORDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark: SparkSession, archives: str) -> DataFrame:
    """One row per record; payload_bytes is null for revisits, which hold no payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(archives).filter("length > 0").select("path", "content")
    return files.mapInArrow(_read, _RECORDS)


class LoserTree:
    """Merges k sorted sequences: each inner node keeps the loser of its match, so the next winner costs one path of log2(k) matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for leaf in range(len(runs)):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, leaf: int, building: bool = False) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner  # the first to come waits for its opponent
                return
            if other >= 0 and self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


_MERGED = "page_id long, merge_range int, merge_place long"


def _merge(batches):
    for batch in batches:
        for part, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            order = [c[2] for c in LoserTree([iter([(c["url_key"], c["captured"], c["page_id"]) for c in run]) for run in runs])]
            for lo in range(0, len(order), 10_000):
                ids = order[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(range(lo, lo + len(ids)), pa.int64())], names=["page_id", "merge_range", "merge_place"])


def merged_index(captures: DataFrame, folder: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(page_id, capture_no): place from 0 of each capture (page_id, archive, url_key, captured) in the order by URL key, time and page.

    The ranges are those of Spark's range partitioning, stored with their numbers: neither a sample nor bounds come to the driver.
    """
    place = ["url_key", "captured", "page_id"]
    rows = captures.filter("page_id is not null").select("archive", *place)
    pieces = max(1, -(-rows.count() // range_rows))
    ranged = rows.repartitionByRange(pieces, *place).withColumn("part", F.spark_partition_id())
    ranged = save(ranged, folder, "ranges").select("part", "archive", F.struct(*place).alias("c"))
    runs = ranged.groupBy("part", "archive").agg(F.array_sort(F.collect_list("c")).alias("run"))  # a run is sorted piece by piece
    merged = runs.groupBy("part").agg(F.collect_list("run").alias("runs")).mapInArrow(_merge, _MERGED)
    counts = ranged.groupBy(F.col("part").alias("merge_range")).agg(F.count("*").alias("n"))  # one row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("merge_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.join(counts.select("merge_range", before.alias("before")), "merge_range").select("page_id", (F.col("before") + F.col("merge_place")).alias("capture_no"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives, read them back, resolve revisits and add each capture's place in the merged index.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, capture_no. Null html is an empty payload, null url a record without target. Rows that repeat a page_id are each written and answered. A null page_id is a
    response record named `none` and has no place in the index. Other columns are ignored. Empty table: no records, no rows.
    """
    folder = shared_dir(pages.sparkSession)
    read = save(read_archives(pages.sparkSession, write_archives(pages, folder)), folder, "records")
    sizes = read.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    place = merged_index(read, folder).groupBy("page_id").agg(F.min("capture_no").alias("capture_no"))
    out = read.join(sizes, ["refers_to", "payload_digest"], "left").join(place, "page_id", "left")
    return out.select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        "url_key", "captured", "capture_no",
    )
