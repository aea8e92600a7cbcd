"""WARC archives of captured pages, and their capture index by an external merge.

Records are made of SQL strings and written by Spark's text writer with the record separator as line end, so every part
file is a WARC file and an executor's loss costs a task. An archive holds as many records as make about ARCHIVE_BYTES on
average; it is unzipped as a stream, record by record, every digest is checked, and its captures are a locally sorted run.
The runs are dealt by ranges of (URL key, timestamp, page), of about RANGE_ENTRIES entries each; Spark's sort hands each
range its runs one after another, and a loser tree merges them. The ranges together hold globally ordered histories.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT, hot_keys, shared_dir, stored

#: Bytes of an archive's records before compression, on average, and the most records of one.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32_000_000, 20_000
#: Entries of a range, which its merge holds.
RANGE_ENTRIES = 100_000
#: Unzipped bytes read at once.
READ_BYTES = 1 << 20
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ENTRY = "url_key string, ts string, page_id long, archive string, offset long, record_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of a binary column: five hexadecimal digits are four of base 32."""
    sha = F.sha1(payload)
    group = lambda i: F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
    digit = lambda v, bits: F.substring(F.lit(BASE32), F.shiftright(v, bits).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[digit(group(i), bits) for i in range(8) for bits in (15, 10, 5, 0)])


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then path and query, in lower case; scheme, www, port and fragment go."""
    part = lambda n: F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)", n)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(part(1), r"\.")), ","), F.lit(")"), F.when(part(2) == "", "/").otherwise(part(2))), F.lit(")/"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, html, payload_digest, refers_to of pages: refers_to is the smallest page_id of equal payloads, null for the response.

    Null html is an empty payload. Among equal payloads the response is every row with the smallest page_id (null counts
    as the largest, so rows that all lack an id are all responses).
    """
    raw = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    raw = raw.withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    thin = stored(raw.select("page_id", "payload_digest"), "warc-digests")
    shared = stored(thin.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "warc-shared")
    # a payload of many pages, as the empty one, is found where its pages lie
    total = thin.count()
    hot = hot_keys(shared, total)
    near = raw.join(F.broadcast(hot.drop("n")), "payload_digest", "left").withColumn("hot", F.col("first").isNotNull())
    cool = shared.where(F.col("n") * HOT <= total).select("payload_digest", F.col("first").alias("_first"))
    # pages of hot payloads need no partner, so they meet the other side under keys of their own
    near = near.withColumn("_digest", F.when(F.col("hot"), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("payload_digest")))
    found = near.join(cool.withColumnRenamed("payload_digest", "_digest"), "_digest", "left").withColumn("first", F.coalesce("first", "_first"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return found.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def archive_records(pages: DataFrame) -> int:
    """How many records make an archive of about ARCHIVE_BYTES."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0] or 600
    return int(min(ARCHIVE_RECORDS, max(1, ARCHIVE_BYTES // mean)))


def write_archives(found: DataFrame, path: str, each: int = ARCHIVE_RECORDS) -> None:
    """The WARC records of records(), with a header block, an HTTP block and, for responses, the payload; gzip files of `each` records."""
    line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(300_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), line), F.concat(F.lit("WARC-Date: "), stamp), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))), F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-URL-Key: "), F.regexp_replace(url_key(F.col("url")), r"[\r\n]", "")), F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string")),
    )
    record = F.concat(header, F.lit(END), http, F.when(revisit, "").otherwise(F.col("html")))
    found.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


def parsed(content: IO[bytes], archive: str) -> Iterator[tuple]:
    """The index entries of one archive, read as a stream; a record is as long as its Content-Length says."""
    held, at, done = b"", 0, False

    def filled(until: int) -> bool:
        """Whether `held` has so many bytes, after reading on."""
        nonlocal held, done
        parts, size = [held], len(held)
        while size < until and not done:
            more = content.read(max(READ_BYTES, until - size))
            done = not more
            parts.append(more)
            size += len(more)
        held = b"".join(parts)
        return size >= until

    def sought(mark: bytes, start: int) -> int:
        while (found := held.find(mark, start)) < 0 and filled(len(held) + 1):
            pass
        return found

    while (start := sought(b"WARC/1.", 0)) >= 0:
        body = sought(b"\r\n\r\n", start) + 4
        head = dict(x.split(": ", 1) for x in held[start : body - 4].decode().split("\r\n")[1:])
        end = body + int(head["Content-Length"])
        filled(end)
        block = held[body:end]
        split = block.index(b"\r\n\r\n") + 4
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda k: None if k not in head or head[k] == "<urn:page:none>" else int(head[k][10:-1])
        size = int(dict(x.split(": ", 1) for x in block[: split - 4].decode().split("\r\n")[1:])["Content-Length"])
        response = head["WARC-Type"] == "response"
        intact = not response or size == len(block) - split and base64.b32encode(hashlib.sha1(block[split:]).digest()).decode() == digest
        yield head["WARC-URL-Key"], head["WARC-Date"], number("WARC-Record-ID"), archive, at + start, end - start, size, digest, head["WARC-Type"], number("WARC-Refers-To"), intact
        at, held = at + end, held[end:]


def order_of(entry: tuple) -> tuple:
    return entry[0].encode(), entry[1], entry[2] is None, entry[2] or 0, entry[3], entry[4]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), ENTRY.split(", "), strict=True)], FIELDS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of every archive below path, each archive's in order of URL key, timestamp and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as unzipped:
                    rows = sorted(parsed(unzipped, name.rsplit("/", 1)[-1]), key=order_of)
                for i in range(0, len(rows), 10_000):
                    yield batch_of(rows[i : i + 10_000])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a next entry costs log k matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.place = [0] * self.k
        self.keys = [order_of(r[0]) if r else None for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._rise(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _rise(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # its other half has not played yet
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[best := self.losers[0]] is not None:
            yield self.runs[best][self.place[best]]
            self.place[best] += 1
            rest = self.place[best] < len(self.runs[best])
            self.keys[best] = order_of(self.runs[best][self.place[best]]) if rest else None
            self._rise(best)


def merged_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The runs' entries in global order: ranges of (url_key, ts, page_id, archive, offset), each merged by a loser tree.

    A URL with most of the captures spreads over several ranges, as the timestamp and page take part in the ranges. A
    range's runs come in Spark's order of archive and place, so a run is a stretch of the rows and is not sorted again.
    """
    spark = runs.sparkSession

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(row[3], []).append(row)
        out: list[tuple] = []
        for row in LoserTree(list(by.values())):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // RANGE_ENTRIES + 1)
    order = [F.col("url_key"), F.col("ts"), F.col("page_id").asc_nulls_last(), F.col("archive"), F.col("offset")]
    return runs.repartitionByRange(n, *order).sortWithinPartitions("archive", *order[:3], "offset").mapInArrow(merge, ENTRY)


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of pages (page_id, url, html), reads them back and merges their index.

    An empty table gives no archive and no rows; a repeated page is written, and indexed, as often as it stands; other
    columns are not archived. `intact` says that the payload read back has the length and digest of its record.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(pages), path, archive_records(pages))
    return merged_index(stored(read_runs(spark, path), "warc-runs"))
