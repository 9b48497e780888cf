"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, a number that never changes. Bytes and rows are summed per
slot, and a small table maps slots to shards. Only that table is edited: every edit makes a new version
and leaves the old one readable, so a reader can pin a version and only the slots of the difference move.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import take
from fleetspectra.sources.tables import exists, materialize, shared_folder

SHARDS = 40
SLOTS = 8192
# Bytes that a record takes besides its text.
OVERHEAD = 16
# A rebalanced map may leave a shard this far above the mean.
TOLERANCE = 0.02


@dataclass(frozen=True)
class SlotMap:
    """One version: the shard of each slot. Its length is fixed, so it is small by construction."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``version, shards, slot, shard``, the form in which versions are stored."""
        rows = [(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, slot int, shard int")


def balanced(loads: Sequence[int], shards: int, version: int = 1) -> SlotMap:
    """The first version: slots from heavy to light, each to the lightest shard so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads[slot], n + 1, shard))
    return SlotMap(version, shards, tuple(out))


def grown(old: SlotMap, loads: Sequence[int], shards: int) -> SlotMap:
    """A version with more shards: slots move only into the new ones, from the fullest shard each."""
    out = list(old.shard_of)
    total = [0] * shards
    members: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(out):
        total[shard] += loads[slot]
        members[shard].append(slot)
    for slots in members.values():
        slots.sort(key=lambda i: (loads[i], -i))
    mean = sum(loads) / shards
    for new in range(old.shards, shards):
        while True:
            donor = max(range(old.shards), key=lambda s: (total[s], -s))
            fitting = [i for i in members[donor] if 0 < loads[i] <= mean - total[new]]
            if not fitting or total[donor] <= mean:
                break
            slot = fitting[-1]
            members[donor].remove(slot)
            out[slot] = new
            total[donor] -= loads[slot]
            total[new] += loads[slot]
    return SlotMap(old.version + 1, shards, tuple(out))


def rebalanced(old: SlotMap, loads: Sequence[int], tolerance: float = TOLERANCE) -> SlotMap:
    """A version for new loads: single slots move from the fullest to the emptiest shard until no shard
    is more than ``tolerance`` above the mean or no move helps; all others stay."""
    out = list(old.shard_of)
    total = [0] * old.shards
    members: dict[int, set[int]] = {s: set() for s in range(old.shards)}
    for slot, shard in enumerate(out):
        total[shard] += loads[slot]
        members[shard].add(slot)
    mean = sum(loads) / old.shards
    for _ in range(len(out)):
        full = max(range(old.shards), key=lambda s: (total[s], -s))
        light = min(range(old.shards), key=lambda s: (total[s], s))
        gap = total[full] - total[light]
        # The slot that halves the gap best; one as large as the gap would only swap the two.
        best = min(
            (i for i in members[full] if 0 < loads[i] < gap),
            key=lambda i: (abs(2 * loads[i] - gap), i),
            default=None,
        )
        if total[full] <= mean * (1 + tolerance) or best is None:
            break
        members[full].remove(best)
        members[light].add(best)
        out[best] = light
        total[full] -= loads[best]
        total[light] += loads[best]
    return SlotMap(old.version + 1, old.shards, tuple(out))


def slotted(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    slots: int = SLOTS,
    overhead: int = OVERHEAD,
) -> DataFrame:
    """``row_id, doc_id, size, text_crc32, content, virtual_slot``, written to the shared folder.

    The slot depends on the record's id and content alone. A null text has no bytes, a null id counts as
    a value like any other.
    """
    rows = take(docs, doc_id=doc_id, text=text)
    body = F.coalesce("text", F.lit("")).cast("binary")
    plain = rows.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64("doc_id", body).alias("content"),
    ).withColumn("virtual_slot", F.pmod("content", F.lit(slots)).cast("int"))
    return materialize(plain, "slotted")


def spread_copies(records: DataFrame, loads: Sequence[int], slots: int = SLOTS) -> DataFrame:
    """Rows equal in id and content that outweigh a mean slot together go to all slots, by their row number.

    Such rows are interchangeable, so it does not matter which of them lies where. They make their slot heavy, so
    only slots above twice the mean are searched, at most half of all, and at most ``slots`` contents are found.
    """
    mean = sum(loads) / slots
    heavy = [i for i, b in enumerate(loads) if b > 2 * mean]
    if not heavy:
        return records
    found = (
        records.filter(F.col("virtual_slot").isin(heavy))
        .groupBy(F.col("content").alias("c"))
        .agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & (F.col("b") > mean))
        .select("c")
    )
    # Their bytes bound their number by that of the slots.
    joined = records.join(F.broadcast(found), F.col("content") == F.col("c"), "left")
    salted = F.pmod(F.xxhash64("content", "row_id"), F.lit(slots)).cast("int")
    slot = F.when(F.col("c").isNull(), F.col("virtual_slot")).otherwise(salted)
    return materialize(joined.withColumn("virtual_slot", slot).drop("c"), "spread")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: ``slots`` numbers each, whatever the corpus."""
    loads, rows = [0] * slots, [0] * slots
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    for r in sums.collect():
        loads[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return loads, rows


def assign(records: DataFrame, slot_map: SlotMap, rows_per_slot: Sequence[int]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    A virtual slot's places begin where those of the slots before it in the same shard end, so the rows
    are numbered inside virtual slots only, thousands of small groups.
    """
    taken = [0] * slot_map.shards
    entries = []
    for v, shard in enumerate(slot_map.shard_of):
        entries.append((v, shard, taken[shard]))
        taken[shard] += rows_per_slot[v]
    spark = records.sparkSession
    # One row per slot: a bound that holds for any corpus.
    side = F.broadcast(spark.createDataFrame(entries, "v int, shard int, offset long"))
    inside = W.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "row_id")
    return (
        records.join(side, F.col("virtual_slot") == F.col("v"))
        .withColumn("slot", F.col("offset") + F.row_number().over(inside) - 1)
        .drop("v", "offset")
    )


def shard_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    overhead: int = OVERHEAD,
    map_path: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """``row_id, doc_id, size, text_crc32, virtual_slot, shard, slot`` for every row, and the map.

    Sizes per shard are near equal: the law is ``bytes``. Rows equal in id and text share a virtual slot,
    in the order met, but for those that outweigh a mean slot (``spread_copies``). The map is stored in
    ``map_path``, by default a folder of its own in the shared one, and read back from there: the first run makes
    version 1, a later one edits the newest version, moving only the slots that more shards or new loads
    ask for, and stores it as the next if it differs. An empty table gives an empty result and a map of no loads; further columns are
    ignored.
    """
    records = slotted(docs, doc_id, text, slots, overhead)
    loads, rows = slot_loads(records, slots)
    spread = spread_copies(records, loads, slots)
    if spread is not records:
        records, (loads, rows) = spread, slot_loads(spread, slots)
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    if not exists(spark, path):
        save_version(balanced(loads, shards), spark, path)
    else:
        stored = load_version(spark, path)
        if len(stored.shard_of) != slots or stored.shards > shards:
            raise ValueError(f"the map in {path} has {len(stored.shard_of)} slots and {stored.shards} shards")
        fitting = grown(stored, loads, shards) if shards > stored.shards else rebalanced(stored, loads)
        if fitting.shard_of != stored.shard_of:
            save_version(fitting, spark, path)
    slot_map = load_version(spark, path)
    return assign(records, slot_map, rows).drop("content"), slot_map


def save_version(slot_map: SlotMap, spark: SparkSession, path: str) -> None:
    """Store a version beside the earlier ones; one that is there already is refused."""
    rows = slot_map.frame(spark).drop("version").coalesce(1)
    rows.write.mode("error").parquet(f"{path}/version={slot_map.version}")


def load_version(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, by default the newest."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))
