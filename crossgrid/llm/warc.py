"""WARC archives, and their index by an external merge.

Writing: each page is a record whose last bytes are the payload and two line ends; as Spark's text sink
ends each row with a separator of ours, partitions become plain WARC files on any file system that Spark
reaches; they are gzipped, and offsets are those of the plain file. Of equal payloads the page of smallest id is a response, the others revisit it.

Indexing: archives are read back and parsed by their content lengths. Each file gives a run of captures,
sorted by URL key, time and page. Runs are dealt by ranges of that whole order, so the captures of one URL, however many, spread over
partitions; in each partition a loser tree merges the runs, and the partitions one after another are the
global order.

Defined results: null and empty html are empty payloads; a null url has the empty key; a row without a page_id has none in its record either, comes after all others of its
payload, key and time, and is a response only where no row with an id has its payload; repeated rows are
records of their own, and those that share the id of a response are responses too; ties in key and time go by
page_id; an empty table gives no files and an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_dir, stash, tidy
from .words import slices

#: Aimed size of an archive before compression, by the mean of all payloads and of a record's own lines.
FILE_BYTES, HEAD_BYTES = 8 << 20, 500
SEPARATOR = "\r\n\r\n"
#: What stands for a page without an id: after all ids.
NO_PAGE = (1 << 63) - 1
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
INDEX = "url_key string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, run long"


def url_key(url: str | None) -> str:
    """A URL in sort-friendly form: host labels reversed, no scheme, no leading www, lower case, no fragment."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, query, more = host.partition("?")
    path = slash + path if slash else "/" + query + more
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    labels = name.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + (":" + port if colon and port not in ("80", "443") else "") + ")" + path.lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_head(page: int, url: str, ts: str, size: int, digest: str, first: int, revisit: bool) -> str:
    """The header lines of a record; a revisit has no block."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        f"WARC-Date: {ts}",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-ID: {page}"] if page != NO_PAGE else []),
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>", f"X-Refers-To-Page: {first}"]
    return "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else size}"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in slices(b.column(2)):
            out = []
            for page, url, html, ts, first, revisit in zip(*(b.column(k).slice(i, j - i).to_pylist() for k in range(6))):
                payload = html or ""
                raw = payload.encode()
                out.append(record_head(page, url or "", ts, len(raw), digest32(raw), first, revisit) + "\r\n\r\n" + ("" if revisit else payload))
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])


def capture_time(page_id: Column) -> Column:
    """Where pages carry no time: a second per page id from EPOCH on."""
    return F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(page_id, F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: Column | None = None) -> str | None:
    """Writes a WARC record per row and returns the folder; null for an empty table. Payloads of fewer than ``least_bytes`` are never revisits."""
    spark = prepare(pages.sparkSession)
    page = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_PAGE).cast("long"))
    rows = pages.select(page.alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), (capture_time(page) if ts is None else ts).alias("ts"))
    names = stash(rows.select("page", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size")))
    total, n = names.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return None
    firsts = names.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page").alias("first"))
    links = names.join(firsts, ["digest", "size"]).where("page <> first").groupBy("page", "digest").agg(F.min("first").alias("first"))
    linked = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(links, ["page", "digest"], "left")
    path = path or f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    out = linked.select("page", "url", "html", "ts", F.coalesce("first", "page").alias("first"), F.col("first").isNotNull().alias("revisit"))
    each = max(1, int(FILE_BYTES / (total / n + HEAD_BYTES)))
    out.mapInArrow(tidy(_records), "value string").write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)
    return path


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield at, stop + 4 - at, head, data[start:stop]
        at = stop + 4


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, run, content) to one sorted run of captures per file."""
    for b in batches:
        for path, run, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            rows = []
            for offset, length, head, block in parse(unpacked(content.as_py())):
                revisit = head["WARC-Type"] == "revisit"
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                if not revisit and (digest32(block) != digest or len(block) != size):
                    raise ValueError(f"{path}: the payload at byte {offset} does not have its digest")
                rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], int(head["X-Page-ID"]) if "X-Page-ID" in head else None, head["WARC-Type"], size, digest, int(head["X-Refers-To-Page"]) if revisit else None, path.rsplit("/", 1)[-1], offset, length, run))
            rows.sort(key=lambda r: (r[0], r[1], NO_PAGE if r[2] is None else r[2]))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 11, kinds)], [f.split()[0] for f in INDEX.split(", ")])


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so a replaced winner plays one match per level."""

    def __init__(self, runs: Iterable[Iterable], key: Callable):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.head = [self._next(k) for k in range(len(self.runs))]
        n = len(self.runs)
        self.loser = [-1] * n
        winner = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        self.best = winner[1] if n > 1 else 0

    def _next(self, k: int) -> tuple | None:
        row = next(self.runs[k], None)
        return None if row is None else (self.key(row), k, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def __iter__(self) -> Iterator:
        n = len(self.runs)
        while n and (top := self.head[self.best]) is not None:
            yield top[2]
            k = self.best
            self.head[k] = self._next(k)
            node = (k + n) // 2
            while node:
                if self._before(self.loser[node], k):
                    self.loser[node], k = k, self.loser[node]
                node //= 2
            self.best = k


#: Captures that a task merges, about 100 MB as Python values.
MERGE_ROWS = 100_000


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, by run and each run in order, to the merged order of all runs."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    table = table.combine_chunks()
    key, ts, page = (table[c].to_pylist() for c in ("url_key", "ts", "page_id"))
    page = [NO_PAGE if p is None else p for p in page]
    run = table["run"].to_numpy()
    at = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
    order = list(LoserTree([range(i, j) for i, j in zip(at[:-1], at[1:])], lambda i: (key[i], ts[i], page[i])))
    merged = table.take(pa.array(order, pa.int64()))
    yield from merged.to_batches(max_chunksize=10_000)


def index_archives(spark: SparkSession, path: str | None) -> DataFrame:
    """The captures of all archives in a folder, in global order of URL key, time and page, partition after partition."""
    prepare(spark)
    if path is None:
        return spark.createDataFrame([], INDEX)
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("run"), "content")
    captures = stash(files.mapInArrow(tidy(_captures), INDEX))
    n = max(spark.sparkContext.defaultParallelism, -(-captures.count() // MERGE_ROWS))  # so that a merge holds so many rows, whatever the input
    last = F.asc_nulls_last("page_id")
    dealt = captures.repartitionByRange(n, "url_key", "ts", last).sortWithinPartitions("run", "url_key", "ts", last)
    return dealt.mapInArrow(tidy(_merge), INDEX)
