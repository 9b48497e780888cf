"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns. Conversations are numbered by id and dealt into shards of
``SHARD`` neighbours; inside a shard, every (position, turn) has a bitset of the conversations that hold
the turn there. A depth-first walk intersects the bitset of a node with these postings: each intersection
that is not empty is a child, its popcount counts the members, and the members that end there are its end
list. Nodes of different shards are one when their paths have one digest; their counts are then added.

Positions are cut into slabs of ``SLAB`` turns, which a shard walks apart, so that neither many
conversations with one beginning nor one conversation of any length is one task. A path's digest is the
exclusive or of its slabs' digests, so a slab can go on from the digests of the slabs before it.

Sums over subtrees need no walk over the whole tree. Every node belongs to its smallest member, so a
conversation owns the end of its own path, from some depth on. What a conversation owns lies below every
node it is a member of, save what it owns above that node. A second walk adds the conversations' shares
up by node.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import prefix_sums, take
from fleetspectra.llm.ordering import chunked, numbered, spans, with_positions
from fleetspectra.sources.tables import materialize

# Conversations of a shard, the length of its bitsets; turns of a slab.
SHARD = 512
SLAB = 64
# A conversation takes up to eight turns of the conversation at the multiple of five below it.
HOST = 5
SHARE = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, turn, key, bytes``: a turn's digest (SHA-256 of role and text) and its text's length.

    Null role or text counts as empty. Rows without a ``conv_id`` belong to no conversation.
    """
    rows = take(conversations, "turn", "role", "text", conv="conv_id").filter("conv is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.select(
        F.col("conv").cast("long").alias("conv"),
        "turn",
        F.unhex(F.sha2(said, 256)).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def _shared(conv: str):
    """How many turns a conversation takes from its host."""
    return F.crc32(F.col(conv).cast("string")) % SHARE


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the one at the multiple of five below: ``(sequences, convs)``.

    Each ``c`` has the first h turns of ``c - c % 5`` (fewer if it has fewer, none if it is not there), then
    its own turns but its first h; h is ``crc32(c) % 9``. Turns are ordered by ``turn``, null first, then by
    digest; equal turns may stand in any order. ``sequences`` has ``conv, d`` (from 0), ``key, bytes``;
    ``convs`` has ``conv, total`` and holds turnless conversations too.
    """
    narrow = materialize(turns(conversations), "turns")
    chunks = chunked(narrow, "conv", ["turn", "key"], "turns-sorted")
    reach = materialize(spans(chunks, "conv"), "turns-spans")
    lengths = reach.filter("offset = 0").select("conv", "n")
    convs = (
        lengths.withColumn("h", _shared("conv"))
        .withColumn("host", F.col("conv") - F.col("conv") % HOST)
        .join(lengths.select(F.col("conv").alias("host"), F.col("n").alias("host_n")), "host", "left")
        .withColumn("taken", F.least("h", F.coalesce("host_n", F.lit(0))))
        .withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    convs = materialize(convs.select("conv", "host", "h", "taken", "total"), "convs")
    known = reach.join(convs.drop("host", "total"), "conv")
    placed = materialize(
        with_positions(chunks, "conv", known, known.count()).drop("turn"), "turns-placed"
    )
    own = placed.filter("pos >= h").select(
        "conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "key", "bytes"
    )
    # At most SHARE - 1 rows of a host, each for the nine conversations around it at most.
    hosts = placed.filter((F.col("conv") % HOST == 0) & (F.col("pos") < SHARE - 1))
    lent = hosts.select(F.col("conv").alias("host"), F.col("pos").alias("d"), "key", "bytes")
    borrowed = lent.join(convs.select("host", "conv", "taken"), "host").filter("d < taken")
    sequences = own.unionByName(borrowed.select("conv", "d", "key", "bytes"))
    return sequences, convs.select("conv", "total")


def slabs(sequences: DataFrame, convs: DataFrame, slab: int, shard: int) -> DataFrame:
    """A row per conversation and slab: ``conv, total, shard, slab, keys, sizes, hi, lo``.

    ``hi`` and ``lo`` are the digest of the path before the slab.
    """
    one = convs.select(F.lit(0).alias("one"), "conv", "total")
    shards = numbered(one, "one", ["conv"], "convs-sorted").select(
        "conv", "total", F.floor(F.col("pos") / shard).alias("shard")
    )
    cells = sequences.groupBy("conv", F.floor(F.col("d") / slab).alias("slab")).agg(
        F.sort_array(F.collect_list(F.struct("d", "key", "bytes"))).alias("cells")
    )
    rows = shards.join(cells, "conv", "left").select(
        "conv",
        "total",
        "shard",
        F.coalesce("slab", F.lit(0)).alias("slab"),
        F.coalesce(F.col("cells.key"), F.array().cast("array<binary>")).alias("keys"),
        F.coalesce(F.col("cells.bytes"), F.array().cast("array<bigint>")).alias("sizes"),
    )
    rows = materialize(rows, "slabs")
    # Only conversations longer than a slab have anything before one.
    start = F.unhex(F.lpad(F.hex("slab"), 16, "0"))
    digest = F.sha2(F.aggregate("keys", start, lambda a, k: F.concat(a, k)), 256)

    def part(first: int):
        return F.conv(F.substring(digest, first, 16), 16, -10).cast("long")

    before = W.partitionBy("conv").orderBy("slab").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    long_ = (
        rows.filter(F.col("total") > slab)
        .withColumns({"a": part(1), "b": part(17)})
        .select(
            "*",
            F.coalesce(F.bit_xor("a").over(before), zero).alias("hi"),
            F.coalesce(F.bit_xor("b").over(before), zero).alias("lo"),
        )
        .drop("a", "b")
    )
    short = rows.filter(F.col("total") <= slab).withColumns({"hi": zero, "lo": zero})
    return short.unionByName(long_)


class Slab:
    """The bitmaps of one slab of one shard; bit i stands for the i-th smallest conversation."""

    def __init__(self, rows: pa.Table, slab: int):
        rows = rows.sort_by("conv")
        self.ids = rows.column("conv").to_pylist()
        self.keys = rows.column("keys").to_pylist()
        self.sizes = rows.column("sizes").to_pylist()
        self.number = rows.column("slab")[0].as_py()
        self.start = self.number * slab
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)
        self.holding: dict[int, int] = defaultdict(int)
        self.ending: dict[int, int] = defaultdict(int)
        self.tops: dict[bytes, int] = defaultdict(int)
        totals, hi, lo = (rows.column(c).to_pylist() for c in ("total", "hi", "lo"))
        for i, keys in enumerate(self.keys):
            bit = 1 << i
            for p, key in enumerate(keys):
                self.postings[p, key] |= bit
                self.holding[p] |= bit
            self.ending[totals[i] - self.start] |= bit
            self.tops[struct.pack(">qq", hi[i], lo[i])] |= bit

    def walk(self, visit) -> None:
        """Depth first: ``visit(id, parent, p, members, stopping)`` after all below a node was visited.

        ``p`` is the depth inside the slab, ``stopping`` the members without another turn in the slab.
        """
        for prefix, members in self.tops.items():
            head = hashlib.sha256(struct.pack(">q", self.number))
            self._walk(visit, int.from_bytes(prefix, "big"), prefix, None, head, 0, members)

    def _walk(self, visit, prefix, node, parent, path, p, members) -> None:
        left = members & self.holding[p]
        stopping = members & ~left
        while left:
            first = (left & -left).bit_length() - 1
            key = self.keys[first][p]
            child = members & self.postings[p, key]
            left &= ~child
            below = path.copy()
            below.update(key)
            name = prefix ^ int.from_bytes(below.digest()[:16], "big")
            self._walk(visit, prefix, name.to_bytes(16, "big"), node, below, p + 1, child)
        visit(node, parent, p, members, stopping)

    def bits(self, members: int) -> Iterator[int]:
        while members:
            low = members & -members
            yield low.bit_length() - 1
            members ^= low


_NODES = "id binary, parent binary, depth long, conv long, n long, bytes long, shard long, ends string"


def _nodes(slab: int):
    def run(rows: pa.Table) -> pa.Table:
        maps = Slab(rows, slab)
        shard = rows.column("shard")[0].as_py()
        out = []

        def visit(node, parent, p, members, stopping):
            # A later slab's first nodes are the last ones of the slab before.
            if p == 0 and maps.start:
                return
            first = (members & -members).bit_length() - 1
            ends = ",".join(str(maps.ids[i]) for i in maps.bits(members & maps.ending[p]))
            size = maps.sizes[first][p - 1] if p else 0
            out.append(
                (node, parent, maps.start + p, maps.ids[first], members.bit_count(), size, shard, ends)
            )

        maps.walk(visit)
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()]
        names = [c.split()[0] for c in _NODES.split(", ")]
        columns = list(zip(*out)) or [()] * len(types)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    return run


def _shares(slab: int):
    def run(rows: pa.Table) -> pa.Table:
        maps = Slab(rows, slab)
        rows = rows.sort_by("conv")
        owned = [rows.column(c).to_pylist() for c in ("saved", "leaves")]
        below: dict[bytes, list[int]] = {}
        out = []

        def visit(node, parent, p, members, stopping):
            sums = below.pop(node, [0, 0])
            for i in maps.bits(stopping):
                sums = [s + o[i] for s, o in zip(sums, owned)]
            if parent is not None:
                up = below.setdefault(parent, [0, 0])
                up[:] = [a + b for a, b in zip(up, sums)]
            if p or not maps.start:
                out.append((node, *sums))

        maps.walk(visit)
        types = [pa.binary(), pa.int64(), pa.int64()]
        columns = list(zip(*out)) or [()] * 3
        return pa.table(
            {n: pa.array(c, t) for n, c, t in zip(("id", "saved", "leaves"), columns, types)}
        )

    return run


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, ends_sha256`` of rows ``id, ends`` that come by id and ascending: one list passes as a stream."""
    node, state = None, None
    for batch in batches:
        done = []
        for id_, ends in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist()):
            if id_ != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = id_, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield _digest_batch(done)
    if state is not None:
        yield _digest_batch([(node, state.hexdigest())])


def _digest_batch(rows) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "id": pa.array([r[0] for r in rows], pa.binary()),
            "ends_sha256": pa.array([r[1] for r in rows], pa.string()),
        }
    )


def prefix_trie(
    sequences: DataFrame, convs: DataFrame, slab: int = SLAB, shard: int = SHARD
) -> DataFrame:
    """The nodes of the trie over ``sequences`` (``conv, d, key, bytes``) and ``convs`` (``conv, total``).

    ``id, parent_id`` (digests of the paths), ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``. Without conversations there is no node; turnless ones are members
    of the root. The digest of a node's end list is one stream of SHA-256, as its definition wants: memory
    is bounded, and a shard adds one row to it.
    """
    rows = materialize(slabs(sequences, convs, slab, shard), "slabs-linked")
    local = materialize(
        rows.groupBy("shard", "slab").applyInArrow(_nodes(slab), _NODES), "trie-local"
    )
    nodes = materialize(
        local.groupBy("id").agg(
            F.first("parent", ignorenulls=True).alias("parent"),
            F.min("depth").alias("depth"),
            F.min("conv").alias("conv"),
            F.sum("n").alias("n"),
            F.max("bytes").alias("bytes"),
        ),
        "trie-nodes",
    )
    ends = (
        local.filter("ends != ''")
        .select("id", "shard", "ends")
        .repartition("id")
        .sortWithinPartitions("id", "shard")
        .mapInArrow(_end_digests, "id binary, ends_sha256 string")
    )
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count("*").alias("n_children")
    )
    valued = (
        nodes.join(children, "id", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("value", (F.col("n") - 1) * F.col("bytes"))
        .withColumn("piece", F.floor(F.col("depth") / slab))
    )
    # What a conversation owns above each of its nodes; its chain is summed in pieces.
    valued = materialize(
        prefix_sums(valued, ["conv"], "piece", [F.col("depth")], above="value"), "trie-valued"
    )
    owned = valued.groupBy("conv").agg(
        F.sum("value").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    zero = F.lit(0).cast("long")
    weighted = rows.select("conv", "total", "shard", "slab", "keys", "sizes", "hi", "lo").join(
        owned, "conv", "left"
    )
    weighted = weighted.withColumns({c: F.coalesce(c, zero) for c in ("saved", "leaves")})
    sums = (
        weighted.groupBy("shard", "slab")
        .applyInArrow(_shares(slab), "id binary, saved long, leaves long")
        .groupBy("id")
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    )
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return (
        valued.join(sums, "id")
        .join(ends, "id", "left")
        .join(parents, "parent", "left")
        .select(
            "id",
            F.col("parent").alias("parent_id"),
            F.col("conv").alias("conv_id"),
            "depth",
            "parent_conv_id",
            F.col("n").alias("n_convs"),
            "n_children",
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
