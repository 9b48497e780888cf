"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: a request, a response (or a revisit of an equal payload) and metadata.
Request and metadata name the response in ``WARC-Concurrent-To``. The writer lays the records out with
built-in functions and Spark's text writer, whose line separator is the blank line that ends a record,
so archives go to any file system that Spark can write and a lost task is written again. The reader
takes archives line by line in file order and cuts records by ``Content-Length``, one record in memory
at a time, so payloads may hold anything, record marks included.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.llm.common import take
from fleetspectra.sources.tables import materialize

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Payloads of fewer bytes are always written in full.
MIN_REVISIT_BYTES = 0
# All captures carry the same date, as the pages have none.
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n"

RECORD = (
    "record_id string, type string, target_uri string, concurrent_to array<string>, "
    "refers_to string, payload_digest string, content_type string, http string, payload binary, "
    "payload_bytes long, fields map<string, string>"
)


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data, with built-in functions."""
    hexed = F.sha1(payload)
    quarters = [
        F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*quarters)), BASE32_DIGITS, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">")
    )


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines whose value is not null, a blank line, and the block; as binary."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)) for name, value in headers]
    length = F.octet_length(block).cast("string")
    return F.concat(
        F.concat_ws("", F.lit(VERSION + BREAK), *lines).cast("binary"),
        F.concat(F.lit("Content-Length: "), length, F.lit(BREAK + BREAK)).cast("binary"),
        block,
    )


def _one_line(text: Column) -> Column:
    """Header values hold no line ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def roles(
    pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """``row_id, page_id, url, payload, digest, first_row``: which capture keeps an equal payload.

    Of equal payloads the smallest page id does, null ids last, then the row met first. The smallest is
    found by aggregation and joined back, so a payload of a third of all pages is summed up per task and
    split by the planner where it is joined.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"),
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", sha1_base32(F.col("payload")))
    rank = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "row_id")
    firsts = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min(rank).alias("first"))
    )
    is_long = F.octet_length("payload") >= min_revisit_bytes
    return rows.join(firsts, (F.col("digest") == F.col("d")) & is_long, "left").select(
        "row_id",
        "page_id",
        "url",
        "payload",
        "digest",
        F.coalesce("first.row_id", "row_id").alias("first_row"),
        F.when(F.col("first").isNull(), F.col("page_id"))
        .otherwise(F.col("first.page_id"))
        .alias("first_page"),
    )


def captures(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``value``: the three records of each page as one text, without the last blank line."""
    rows = roles(pages, min_revisit_bytes)
    revisit = F.col("row_id") != F.col("first_row")
    uri = _one_line(F.col("url"))
    main = _urn(F.lit("response"), F.col("row_id"), F.col("page_id"), F.col("digest"))
    first = _urn(F.lit("response"), F.col("first_row"), F.col("first_page"), F.col("digest"))
    side = {k: _urn(F.lit(k), F.col("row_id"), F.col("page_id")) for k in ("request", "metadata")}
    date = F.lit(DATE)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(BREAK + BREAK),
    ).cast("binary")
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", F.when(revisit, first)),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", side["request"]),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{BREAK}{BREAK}")).cast("binary"),
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", side["metadata"]),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page_id: "), page, F.lit(BREAK)).cast("binary"),
    )
    gap = F.lit(BREAK + BREAK).cast("binary")
    return rows.select(
        F.concat(request, gap, response, gap, metadata).cast("string").alias("value")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write gzipped WARC files, one per task, into a new folder.

    A null html is an empty payload; a null url is an empty target; a null id is written as an empty
    field. Repeated rows are captures of their own. Further columns are ignored. ``pages`` must read the
    same rows in the same order again, as a table or files do.
    """
    rows = captures(take(pages, page_id=page_id, url=url, html=html), min_revisit_bytes)
    rows.write.option("lineSep", BREAK + BREAK).option("compression", "gzip").text(folder)


class _Cutter:
    """Cuts a stream of lines into records."""

    def __init__(self) -> None:
        self.headers: list[tuple[str, str]] = []
        self.wanted = -1  # bytes of the block still to come, or -1 while in the headers
        self.block: list[bytes] = []

    def feed(self, line: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        """One line without its line end."""
        if self.wanted < 0:
            text = line.rstrip(b"\r").decode("utf-8", "replace")
            if text:
                if text.startswith("WARC/") and not self.headers:
                    self.headers = [("version", text)]
                elif self.headers:
                    name, _, value = text.partition(":")
                    self.headers.append((name.strip().lower(), value.strip()))
                return
            if not self.headers:
                return  # blank lines between records
            self.wanted = int(dict(self.headers).get("content-length", 0))
            if self.wanted:
                return
            yield self._done()
            return
        piece = line + b"\n"
        self.block.append(piece[: self.wanted])
        self.wanted -= len(self.block[-1])
        if self.wanted == 0:
            # What is left of this line is part of the break after the record.
            yield self._done()

    def _done(self) -> tuple[list[tuple[str, str]], bytes]:
        out = self.headers, b"".join(self.block)
        self.headers, self.block, self.wanted = [], [], -1
        return out


def _parsed(headers: list[tuple[str, str]], block: bytes) -> tuple:
    one = dict(reversed(headers))
    kind = one.get("warc-type", "")
    content_type = one.get("content-type", "")
    http, payload, size, fields = None, block, len(block), None
    if content_type.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        size = len(payload)
        if kind == "revisit":
            lines = (x.partition(":") for x in http.split("\r\n")[1:])
            stated = {k.strip().lower(): v.strip() for k, _, v in lines}
            size = int(stated.get("content-length", 0))
    elif content_type == "application/warc-fields":
        lines = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
        fields = [(k.strip(), v.strip()) for k, _, v in lines]
    if kind == "response":
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        digest = one.get("warc-payload-digest")
    return (
        one.get("warc-record-id"),
        kind,
        one.get("warc-target-uri"),
        [v for k, v in headers if k == "warc-concurrent-to"],
        one.get("warc-refers-to"),
        digest,
        content_type,
        http,
        payload,
        size,
        fields,
    )


# Endings of compressed files that Spark never cuts.
WHOLE_FILES = (".gz", ".deflate", ".snappy", ".lz4", ".zst")
# Records handed on at once, by bytes of their blocks.
BATCH_BYTES = 8_000_000


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder, plain or gzipped as whole files.

    A gzipped file is one task's. Spark cuts plain files into splits, so the lines of these are brought
    together by file and sorted back into file order first, which costs a shuffle of their bytes.

    A response's digest is computed from its payload; that of a revisit is the stated one, as is its
    size, read from the HTTP header it repeats. ``fields`` holds the lines of a metadata record.
    """
    kinds = spark.createDataFrame([], RECORD).schema
    names = kinds.names
    arrow = {
        "concurrent_to": pa.list_(pa.string()),
        "payload": pa.binary(),
        "payload_bytes": pa.int64(),
        "fields": pa.map_(pa.string(), pa.string()),
    }

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found)
        return pa.record_batch(
            {n: pa.array(c, arrow.get(n, pa.string())) for n, c in zip(names, columns)}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, file, found, size = _Cutter(), None, [], 0
        for batch in batches:
            for name, line in zip(batch.column("file").to_pylist(), batch.column("line")):
                if name != file:
                    cutter, file = _Cutter(), name
                for headers, block in cutter.feed(line.as_py()):
                    found.append(_parsed(headers, block))
                    size += len(block)
                if size > BATCH_BYTES:
                    yield rows_of(found)
                    found, size = [], 0
        if found:
            yield rows_of(found)

    lines = spark.read.option("lineSep", "\n").text(folder)
    name = F.lower(F.col("_metadata.file_name"))
    is_whole = F.lit(False)
    for suffix in WHOLE_FILES:
        is_whole = is_whole | F.endswith(name, F.lit(suffix))

    def lines_of(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.select(
            F.xxhash64(F.col("_metadata.file_path")).alias("file"),
            F.col("value").cast("binary").alias("line"),
            *more,
        )

    if all(f.lower().endswith(WHOLE_FILES) for f in lines.inputFiles()):
        return lines_of(lines).mapInArrow(run, RECORD)
    # Lines of a split are numbered as they are read, splits by where they begin.
    split = F.col("_metadata.file_block_start").alias("split")
    number = F.monotonically_increasing_id().alias("number")
    in_order = (
        lines_of(lines.filter(~is_whole), split, number)
        .repartition("file")
        .sortWithinPartitions("file", "split", "number")
        .select("file", "line")
    )
    whole = lines_of(lines.filter(is_whole)).mapInArrow(run, RECORD)
    return whole.unionByName(in_order.mapInArrow(run, RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata, others``.

    A response or revisit anchors a capture. Other records belong to the anchor they are concurrent to,
    directly or through another record, whichever side states the link. ``request`` and ``metadata``
    are arrays, as a capture may have several; records that lead to no anchor form captures of their
    own under their own id, with a null ``response``. The work is joins on record ids; each round
    resolves records one link farther and is written to the shared folder.
    """
    schema = records.schema
    # Linking needs three columns of many; they are read from the archives once.
    heads = materialize(records.select("record_id", "type", "concurrent_to"), "heads")
    links = heads.select("record_id", F.explode("concurrent_to").alias("other"))
    links = links.unionByName(
        links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))
    ).distinct()
    is_anchor = F.col("type").isin("response", "revisit")
    anchors = heads.filter(is_anchor).select("record_id", F.col("record_id").alias("capture_id"))
    known = anchors.distinct()
    waiting = heads.filter(~is_anchor).select("record_id").distinct()
    step = anchors.distinct()
    while True:
        near = step.select(F.col("record_id").alias("other"), "capture_id")
        found = (
            links.join(near, "other")
            .join(waiting, "record_id", "left_semi")
            .groupBy("record_id")
            .agg(F.min("capture_id").alias("capture_id"))
        )
        step = materialize(found, "resolved")
        if step.isEmpty():
            break
        known = known.unionByName(step)
        waiting = waiting.join(step, "record_id", "left_anti")
        # Stop at once when no link leads on, as in most archives.
        if waiting.isEmpty():
            break
    body = F.struct(*schema.names).alias("record")
    placed = records.select("record_id", "type", body).join(known, "record_id", "left")
    kind = F.col("type")

    def of(condition: Column) -> Column:
        return F.collect_list(F.when(condition, F.col("record")))

    return placed.groupBy(F.coalesce("capture_id", "record_id").alias("capture_id")).agg(
        F.first(F.when(is_anchor, F.col("record")), ignorenulls=True).alias("response"),
        of(kind == "request").alias("request"),
        of(kind == "metadata").alias("metadata"),
        of(~is_anchor & ~kind.isin("request", "metadata")).alias("others"),
    )


