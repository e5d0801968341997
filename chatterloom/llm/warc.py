"""WARC archives of captures and a merged index over them.

Writing: every capture becomes one record, a response or, where a response with the same payload exists, a
revisit that refers to it. Spark's text sink writes the files, with CRLF CRLF after each record, so a lost executor costs a
task and no half-written file is ever seen. Of equal payloads of at least ``LEAST_BYTES`` the one with the smallest id
is the response.

Reading: each file is parsed by its length fields (payloads may hold blank lines) and gives a run of index
entries sorted by URL key and time. Runs are dealt out by key ranges and each range merges its runs with a
loser tree, so the result is in global order: (range, position).

Null payloads are empty ones. Null URLs have the empty key. Repeated captures stay repeated: all copies but one of a long payload revisit
it, those with the same id as the response too. A null id can't be written and is refused by name. Empty
tables give archives without records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterloom.llm.shared import shared_folder

LEAST_BYTES = 100
FILE_RECORDS = 2_000  # most records of a file; it is read as one value
EPOCH = "2020-01-01 00:00:00"
CRLF = "\r\n"

INDEX = "url_key string, captured string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long"
MERGED = INDEX + ", slice int, position long"


def url_key(url: Column) -> Column:
    """Sort key: host labels in reverse, then the rest in lower case; scheme, user, port, ``www.`` and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^[^@]*@|:\d+$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), "^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def records(pages: DataFrame) -> DataFrame:
    """Per capture: page_id, url, captured, html, payload_digest, payload_bytes, record_type, refers_to."""
    page = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.select(
        F.when(F.col("page_id").isNull(), F.raise_error("a capture needs an id")).otherwise(F.col("page_id")).alias("page_id"),
        "url", "html", F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"),
    )
    # Only digests with several captures meet the pages again; copies are combined before the shuffle.
    long_ones = page.where(F.col("payload_bytes") >= LEAST_BYTES)
    first = long_ones.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = page.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    time = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod("page_id", F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return joined.select(
        "page_id", "url", time.alias("captured"), "html", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record_text(kind: Column) -> Column:
    """A record without the CRLF CRLF that ends it; a revisit has no block but the digest and length of its payload."""
    length = F.when(kind == "response", F.col("payload_bytes")).otherwise(0).cast("string")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:capture:"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("X-Url-Key: "), F.regexp_replace(url_key(F.col("url")), r"[\x00-\x20]", "%20")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:capture:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), length),
    ]
    block = F.when(kind == "response", F.col("html")).otherwise("")
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), block)


def write(pages: DataFrame, path: str) -> None:
    """Archives below ``path``: gzip files of at most ``FILE_RECORDS`` records."""
    lines = records(pages).select(_record_text(F.col("record_type")).alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(content: bytes, name: str) -> Iterator[dict]:
    """Index entries of one archive with their payloads, in file order."""
    import gzip

    data = io.BytesIO(gzip.decompress(content))
    while True:
        offset = data.tell()
        first = data.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {offset}")
        head = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[key] = value
        payload = data.read(int(head["Content-Length"]))
        if data.read(4) != b"\r\n\r\n":
            raise ValueError(f"{name}: record at {offset} is cut")
        number = lambda key: int(head[key].rpartition(":")[2].rstrip(">")) if key in head else None
        response = head["WARC-Type"] == "response"
        digest = hashlib.sha256(payload).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"{name}: payload at {offset} is damaged")
        yield {
            "url_key": head["X-Url-Key"], "captured": head["WARC-Date"], "page_id": number("WARC-Record-ID"), "record_type": head["WARC-Type"],
            "payload_digest": digest, "payload_bytes": len(payload) if response else int(head["X-Payload-Length"]),
            "refers_to": number("WARC-Refers-To"), "file": name, "offset": offset, "payload": payload,
        }


def _order(x: dict) -> tuple:
    return x["url_key"].encode(), x["captured"], x["page_id"], x["file"], x["offset"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives, those of one file in order of URL key, time and id."""
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in INDEX.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                entries = [{k: v for k, v in x.items() if k != "payload"} for x in parse(content.as_py(), name.as_py().rpartition("/")[2])]
                yield pa.RecordBatch.from_pylist(sorted(entries, key=_order), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(read, INDEX)


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so a new entry plays one match a level."""

    def __init__(self, runs: list[list]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a][0], a) < (self.heads[b][0], b)

    def _play(self, winner: int) -> None:
        node = (winner + len(self.heads)) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # while the tree is built: wait here for the opponent
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner][1]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merged_index(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """The runs merged into one order: by ``slice``, then ``position``; a slice holds a range of (key, time, id).

    Ranges include time and id, so one URL with a large part of all captures spans many slices.
    """
    spark = entries.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["url_key", "captured", "page_id", "file", "offset"]
    dealt = entries.repartitionByRange(n, *keys).sortWithinPartitions("file", "url_key", "captured", "page_id", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by_file: dict[str, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                by_file.setdefault(x["file"], []).append((_order(x), x))
        part, out = TaskContext.get().partitionId(), []
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}.get(c.split()[1], pa.string())) for c in MERGED.split(", ")])
        for position, x in enumerate(LoserTree(list(by_file.values()))):
            out.append(x | {"slice": part, "position": position})
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(merge, MERGED)


def archived(pages: DataFrame) -> DataFrame:
    """Writes the captures to archives in the shared folder, reads them back and merges their indexes."""
    path = shared_folder(pages.sparkSession, "warc")
    write(pages, path)
    return merged_index(runs(pages.sparkSession, path))


def histories(merged: DataFrame) -> DataFrame:
    """Captures with ``capture_no``, their number in the history of their URL key (from 1).

    Slices in order hold the keys in order: a key's first slice counts from its first position there and later slices add what came before.
    """
    inside = merged.groupBy("url_key", "slice").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = inside.select("url_key", "slice", "start", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return merged.join(before, ["url_key", "slice"]).withColumn("capture_no", F.col("position") - F.col("start") + F.col("before") + 1).drop("start", "before")
