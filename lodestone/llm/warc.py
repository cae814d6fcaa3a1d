"""WARC archives written, read back and indexed: capture histories in global order.

Method.  Every page becomes one WARC record; of equal payloads the one with the
largest page_id is the response and the others are revisits that name it.
Spark's text writer stores the records (a record is text, and the two line ends
that close it are the writer's separator), so archives go wherever Spark
writes.  Reading parses records by their declared lengths and digests the
payloads found.  Each archive's captures form a run sorted by URL key and
timestamp; runs meet by key range, and within a range a loser tree merges them,
so the concatenated ranges are the whole index in order.  Ranges are cut by key,
timestamp and id, so a URL or host with very many captures spans several.
An archive ends after a stated number of bytes and is compressed as a whole.

Defined results.  A null html is an empty payload; pages of any length are
stored whole.  Columns beyond page_id, url and html are never read, whatever
their names.  Captures of equal key and time are in the order of their ids.  Rows that repeat the largest
page_id of their payload are responses, all of them.  A null page_id never is
the largest; alone it is a response.  A null or broken URL keeps its text as its
key.  Payloads under ``least_bytes`` are always responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_values
from lodestone.storage import materialize, new_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str) -> str:
    """Sort-friendly form: the host's labels reversed, then path and query; without fragment."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = parts.port
    except ValueError:
        return url
    if not host:
        return url
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path.lower()


def _record(page: str, url: str, date: str, digest: str, payload: str, size: int, keeper: str | None) -> str:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if keeper is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{keeper}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if keeper is None else 0)}",
    ]
    return "\r\n".join(head) + "\r\n\r\n" + http + (payload if keeper is None else "")


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, file_bytes: int = 64 << 20, time_column: str | None = None) -> str:
    """Write one WARC record a row; returns the folder.

    Columns: page_id, url, html.  time_column: a timestamp column that tells the
    capture times; else they follow from page_id.  file_bytes: of records in one
    archive; a longer record has one of its own.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    time = F.date_format(F.col(time_column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_column else F.lit(None).cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), time.alias("date"))
    keyed = base.select("*", F.xxhash64("page_id", "url", "html").alias("row"), F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha1"))
    lean = materialize(keyed.select("page_id", "row", "sha1", F.octet_length("html").alias("size")), "payloads")
    keepers = lean.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("sha1", "keeper")
    revisits = lean.join(keepers, "sha1").where("keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper)").select("row", "keeper").distinct()
    marked = keyed.join(revisits, "row", "left").select("page_id", "url", "html", "date", "sha1", "keeper", "row")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = held = 0
        for b in batches:
            out, into = [], []
            for page, url, html, date, sha1, keeper, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = str(page) if page is not None else f"null:{row}"
                when = date or (_START + timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                record = _record(name, url, when, base64.b32encode(sha1).decode(), html, len(html.encode()), None if keeper is None else str(keeper))
                if held and held + len(record) > file_bytes:
                    archive, held = archive + 1, 0
                held += len(record)
                out.append(record)
                into.append(archive)
            yield pa.RecordBatch.from_arrays([pa.array(into, pa.int32()), pa.array(out, pa.string())], names=["archive", "value"])

    records = marked.mapInArrow(build, "archive int, value string")
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("archive").text(path)
    return path


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        at = end + 4
        size = int(head["content-length"])
        yield head, data[at : at + size]
        at += size


def read_captures(spark, path: str) -> DataFrame:
    """One row per record found in the archives, in runs sorted by key and time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), byte_values(b.column(1)), strict=True):
                rows = []
                for head, block in parse_archive(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    revisit = head["warc-type"] == "revisit"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if not revisit else head["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (digest != head["warc-payload-digest"].removeprefix("sha1:") or declared != len(payload)):
                        raise ValueError(f"a record in {name} does not hold the payload that it declares")
                    page = head["warc-record-id"].removeprefix("<urn:x-page:").removesuffix(">")
                    refers = head.get("warc-refers-to", "").removeprefix("<urn:x-page:").removesuffix(">")
                    rows.append((None if page.startswith("null:") else int(page), declared, digest, head["warc-type"], int(refers) if refers else None, url_key(unquote(head["warc-target-uri"])), head["warc-date"], name.rpartition("/")[2]))
                rows.sort(key=lambda r: (r[5], r[6], -1 if r[0] is None else r[0]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names=list(names))

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, captured string, run string")


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = len(runs)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, building=True)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0 and building:
                self.tree[node] = i
                return
            if other >= 0 and self._before(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[best := self.tree[0]] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self._replay(best)


def capture_index(captures: DataFrame) -> DataFrame:
    """The captures in global order of URL key, time and id, range by range."""
    columns = captures.columns
    key, time, page = (columns.index(c) for c in ("urlkey", "captured", "page_id"))
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = captures.repartitionByRange(parts, "urlkey", "captured", "page_id").sortWithinPartitions("run", "urlkey", "captured", "page_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one range, whose size the range cuts bound
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys, times, pages, runs = (table.column(i).to_pylist() for i in (key, time, page, columns.index("run")))
        starts = [i for i in range(len(runs)) if i == 0 or runs[i] != runs[i - 1]] + [len(runs)]
        item = lambda i: (keys[i], times[i], -1 if pages[i] is None else pages[i], i)
        order = [x[3] for x in LoserTree([map(item, range(a, b)) for a, b in zip(starts, starts[1:], strict=False)])]
        yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    return ranges.mapInArrow(merge, captures.schema)


def archive_and_index(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and return the merged index."""
    where = write_archives(pages, path, least_bytes)
    return capture_index(materialize(read_captures(pages.sparkSession, where), "captures"))
