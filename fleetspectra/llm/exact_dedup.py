"""Exact duplicates by Grace hashing.

1. *Partition phase.* Each task folds the copies it meets in an open-addressing table that compares
   complete content, and writes one record per distinct text with its content, plus one slim line per
   row. A group of copies that makes up a third of the corpus leaves one record per task.
2. *Recursion.* Records are dealt to buckets by a hash of their content. Buckets whose content does not
   fit a table are dealt again by the next, independent hash, and so on, until each fits or holds one
   hash value only. Sizes decide this, so the recursion runs on (record, hash, bytes); contents are
   spilled to their final bucket once, in the shuffle files of one exchange.
3. *Table phase.* Every bucket goes through an open-addressing table which compares complete content;
   two texts of equal hash stay apart.

Nothing is decided by a hash alone, and every intermediate table lies in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import small_batches, take
from fleetspectra.sources.tables import materialize

# Deleted before texts are compared (fixed values: space and U+0009 to U+000D).
WHITE = b" \t\n\x0b\x0c\r"
# Content bytes that one table may hold.
TABLE_BYTES = 32_000_000
# Buckets that an oversized bucket is dealt to.
FAN_OUT = 16
# A task's number is kept above so many bits of a row's number.
ROW_BITS = 40

RECORDS = (
    "row_id long, doc_id long, record_id long, n_chars long, hash long, bytes long, rows long, "
    "content binary"
)


class OpenTable:
    """Open addressing with linear probing; equal hashes are told apart by complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, hash_: int, content: bytes) -> int:
        """The entry of this content, or -1."""
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return -1

    def add(self, hash_: int, content: bytes) -> int:
        if 2 * (len(self.hashes) + 1) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for entry, h in enumerate(self.hashes):
                self._place(h, entry)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.bytes += len(content)
        self._place(hash_, len(self.hashes) - 1)
        return len(self.hashes) - 1

    def _place(self, hash_: int, entry: int) -> None:
        mask = len(self.slots) - 1
        at = hash_ & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = entry


def normalized(text: str | None) -> bytes:
    """The compared content: UTF-8 without white space; null counts as empty."""
    return (text or "").encode("utf-8").translate(None, WHITE)


def _rank(n_chars: int, doc_id: int | None, row_id: int) -> tuple:
    """Smallest first: most code points, then smallest id, nulls last, then the row met first."""
    return (-n_chars, doc_id is None, doc_id or 0, row_id)


def _partition(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << ROW_BITS
        row = base
        table, best, rows, first = OpenTable(), [], [], base

        def records() -> pa.RecordBatch:
            return pa.record_batch(
                {
                    "row_id": pa.array([b[3] for b in best], pa.int64()),
                    "doc_id": pa.array([None if b[1] else b[2] for b in best], pa.int64()),
                    "record_id": pa.array(range(first, first + len(best)), pa.int64()),
                    "n_chars": pa.array([-b[0] for b in best], pa.int64()),
                    "hash": pa.array(table.hashes, pa.int64()),
                    "bytes": pa.array([len(c) for c in table.contents], pa.int64()),
                    "rows": pa.array(rows, pa.int64()),
                    "content": pa.array(table.contents, pa.binary()),
                }
            )

        for batch in batches:
            lines: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                content = normalized(text)
                hash_ = xxhash.xxh64_intdigest(content) >> 1
                rank = _rank(len(text or ""), doc_id, row)
                entry = table.find(hash_, content)
                if entry < 0:
                    if table.bytes + len(content) > table_bytes and table.hashes:
                        yield records()
                        first += len(best)
                        table, best, rows = OpenTable(), [], []
                    entry = table.add(hash_, content)
                    best.append(rank)
                    rows.append(1)
                else:
                    best[entry] = min(best[entry], rank)
                    rows[entry] += 1
                lines.append((row, doc_id, first + entry))
                row += 1
            none = pa.nulls(len(lines), pa.int64())
            yield pa.record_batch(
                {
                    "row_id": pa.array([x[0] for x in lines], pa.int64()),
                    "doc_id": pa.array([x[1] for x in lines], pa.int64()),
                    "record_id": pa.array([x[2] for x in lines], pa.int64()),
                    **{n: none for n in ("n_chars", "hash", "bytes", "rows")},
                    "content": pa.nulls(len(lines), pa.binary()),
                }
            )
        if best:
            yield records()

    return run


def buckets(records: DataFrame, table_bytes: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """``hash, bucket string``: the recursion, on sizes only.

    A bucket is named by its path of partition numbers, one per level. It is split again while its
    content exceeds ``table_bytes`` and it holds more than one hash value. Copies of one text in
    several records count once, as the table keeps them once.
    """
    sizes = records.groupBy("hash").agg(F.max("bytes").alias("bytes"))
    hashes = materialize(sizes.withColumn("bucket", F.lit("")), "buckets")
    level = 0
    while True:
        full = (
            hashes.groupBy("bucket")
            .agg(F.sum("bytes").alias("total"), F.count("*").alias("n"))
            .filter((F.col("total") > table_bytes) & (F.col("n") > 1))
            .select("bucket", F.lit(True).alias("split"))
        )
        if full.isEmpty():
            return hashes.select("hash", "bucket")
        part = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(fan_out)).cast("string")
        hashes = materialize(
            hashes.join(full, "bucket", "left").select(
                "hash",
                "bytes",
                F.when(F.col("split"), F.concat_ws("/", "bucket", part))
                .otherwise(F.col("bucket"))
                .alias("bucket"),
            ),
            "buckets",
        )
        level += 1


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket after another through its table; rows arrive sorted by bucket."""
    bucket, table = None, OpenTable()
    best: list[tuple] = []
    rows: list[int] = []
    members: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
        return pa.record_batch(
            {
                "record_id": pa.array([m[0] for m in members], pa.int64()),
                "keep_row": pa.array([best[m[1]][3] for m in members], pa.int64()),
                "keep_id": pa.array(
                    [None if best[m[1]][1] else best[m[1]][2] for m in members], pa.int64()
                ),
                "group_size": pa.array([rows[m[1]] for m in members], pa.int64()),
                "text_sha256": pa.array([digests[m[1]] for m in members], pa.string()),
            }
        )

    for batch in batches:
        for at in range(batch.num_rows):
            r = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
            if r["bucket"] != bucket:
                if members:
                    yield flush()
                bucket, table, best, rows, members = r["bucket"], OpenTable(), [], [], []
            rank = _rank(r["n_chars"], r["doc_id"], r["row_id"])
            entry = table.find(r["hash"], r["content"])
            if entry < 0:
                entry = table.add(r["hash"], r["content"])
                best.append(rank)
                rows.append(r["rows"])
            else:
                best[entry] = min(best[entry], rank)
                rows[entry] += r["rows"]
            members.append((r["record_id"], entry))
    if members:
        yield flush()


def grace_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    table_bytes: int = TABLE_BYTES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after all white space is deleted. Of equal texts the one with the
    most code points stays, then the smallest id. A null text is the empty text, a null id comes after
    all others. Repeated rows stay apart: exactly one row of a group is ``kept``. An empty table gives
    an empty result; further columns are ignored.
    """
    rows = take(small_batches(docs), doc_id=doc_id, text=text)
    parts = materialize(rows.mapInArrow(_partition(table_bytes), RECORDS), "copies", "zstd")
    records = parts.filter(F.col("content").isNotNull())
    # One exchange moves the contents, and as it is asked for by name no task splits a bucket's hash.
    placed = records.repartition("hash").join(buckets(records, table_bytes, fan_out), "hash")
    solved = (
        placed.drop("bytes")
        .sortWithinPartitions("bucket")
        .mapInArrow(
            _resolve,
            "record_id long, keep_row long, keep_id long, group_size long, text_sha256 string",
        )
    )
    lines = parts.filter(F.col("content").isNull()).select("row_id", "doc_id", "record_id")
    return lines.join(solved, "record_id").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )
