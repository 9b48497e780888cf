"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``blocks``. Fingerprints that differ in at most ``max_bits`` bits
differ in at most so many blocks, so they agree on some choice of ``blocks - max_bits`` of them. All
choices are join keys; a shared key makes a candidate and the Hamming distance decides.

Copies are folded first: the join sees each distinct fingerprint once. A key shared by more than
``pair_limit`` fingerprints is not joined with itself, as a dense group would give all pairs. Its members
meet at midpoints instead: every member visits all values within distance ``(max_bits + 1) // 2`` in the
bits outside the key. Members whose distances to a visited value add up to at most ``max_bits`` are
linked through it, one edge each. That is exact, linear in the group, and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import small_batches, take
from fleetspectra.llm.components import components
from fleetspectra.sources.tables import materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
BITS = 64
# Six blocks leave keys of about 32 bits, so that chance meetings stay few beyond 10^9 fingerprints.
BLOCKS = 6
# A key with more fingerprints goes through midpoints.
PAIR_LIMIT = 512
SEED = 42
# Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 200_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of all shingle hashes, as an unsigned number."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for low in range(0, n, SHINGLES_AT_ONCE):
        high = min(n, low + SHINGLES_AT_ONCE)
        spans = zip(begins[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", high - low)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return sum(1 << b for b in range(BITS) if 2 * int(ones[b]) > n)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``row_id, doc_id, fingerprint long`` (the unsigned number's bits) of ``row_id, doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text")]
            yield pa.record_batch(
                {
                    "row_id": batch.column("row_id"),
                    "doc_id": batch.column("doc_id"),
                    "fingerprint": pa.array(np.array(prints, np.uint64).view(np.int64)),
                }
            )

    return docs.select("row_id", "doc_id", "text").mapInArrow(
        run, "row_id long, doc_id long, fingerprint long"
    )


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """The bits of each key: every choice of ``blocks - max_bits`` blocks, as a signed mask."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(prints: DataFrame, masks: list[int]) -> DataFrame:
    """One row per fingerprint and choice of blocks: ``choice, key, fp``."""
    fp = F.col("fingerprint")
    keys = F.array(*[fp.bitwiseAND(F.lit(m).cast("long")) for m in masks])
    return prints.select(fp.alias("fp"), F.posexplode(keys).alias("choice", "key"))


def _flips(free: int, radius: int) -> list[tuple[int, int]]:
    """(difference, distance) for all values within ``radius`` in the free bits."""
    bits = [b for b in range(BITS) if free >> b & 1]
    out = [(sum(1 << b for b in c), r) for r in range(radius + 1) for c in combinations(bits, r)]
    return [(d - (1 << BITS) if d >> (BITS - 1) else d, r) for d, r in out]


def _midpoint_edges(hot: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links inside crowded keys: one edge from each visitor of a midpoint to its closest visitor.

    Two members within ``max_bits`` meet at a value that is at most ``near`` from one and ``far`` from
    the other. All visitors within ``near`` of a value are linked there (2 * near <= max_bits), and a
    visitor within ``far`` is linked to any of those, so the closest one stands for all.
    """
    near, far = max_bits // 2, max_bits - max_bits // 2

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for choice, fp in zip(batch.column("choice").to_pylist(), batch.column("fp").to_pylist()):
                if choice not in flips:
                    d = _flips(~masks[choice] & ((1 << BITS) - 1), far)
                    flips[choice] = (
                        np.array([x for x, _ in d], np.int64),
                        np.array([r for _, r in d], np.int8),
                    )
                differences, radius = flips[choice]
                n = len(radius)
                yield pa.record_batch(
                    {
                        "choice": pa.array(np.full(n, choice, np.int32)),
                        "middle": pa.array(differences ^ np.int64(fp)),
                        "radius": pa.array(radius),
                        "fp": pa.array(np.full(n, fp, np.int64)),
                    }
                )

    visits = hot.select("choice", "fp").mapInArrow(
        visit, "choice int, middle long, radius byte, fp long"
    )
    closest = visits.groupBy("choice", "middle").agg(
        F.min(F.struct("radius", "fp")).alias("hub"), F.count("*").alias("n")
    )
    hubs = closest.filter((F.col("n") > 1) & (F.col("hub.radius") <= near)).select(
        F.col("choice").alias("c"), F.col("middle").alias("m"), F.col("hub.fp").alias("b")
    )
    on = (F.col("choice") == F.col("c")) & (F.col("middle") == F.col("m")) & (F.col("fp") != F.col("b"))
    return visits.join(hubs, on).select(F.col("fp").alias("a"), "b").distinct()


def links(
    prints: DataFrame,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Edges ``a, b`` between distinct ``fingerprint`` values that connect all within ``max_bits``."""
    masks = block_masks(blocks, max_bits)
    keys = _keys(prints, masks)
    shared = (
        keys.groupBy("choice", "key")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
    # Few keys are shared by two fingerprints; they are written once for both ways.
    members = materialize(
        keys.join(shared, ["choice", "key"]).select("choice", "key", "fp", "n"), "blocks"
    )
    few = members.filter(F.col("n") <= pair_limit)
    left = few.select("choice", "key", F.col("fp").alias("a"))
    right = few.select("choice", "key", F.col("fp").alias("b"))
    close = _hamming(F.col("a"), F.col("b")) <= max_bits
    pairs = left.join(
        right,
        (left["choice"] == right["choice"])
        & (left["key"] == right["key"])
        & (F.col("a") < F.col("b"))
        & close,
    ).select("a", "b")
    many = members.filter(F.col("n") > pair_limit)
    return pairs.unionByName(_midpoint_edges(many, masks, max_bits)).distinct()


def simhash_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """One row per input row: ``row_id, doc_id, fingerprint string, component_id, keeper boolean``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits``, its own row
    included; null ids count after all others, and a component of null ids alone has a null id. One row
    of each component is its ``keeper``: the one of the smallest id, of repeated ids the first. Null and
    empty texts have fingerprint zero, which links like any other. An empty table gives an empty result;
    further columns are ignored. ``docs`` must read the same rows in the same order again, as a table or
    files do; ``row_id`` then numbers them.
    """
    rows = take(small_batches(docs), doc_id=doc_id, text=text).withColumn(
        "row_id", F.monotonically_increasing_id()
    )
    prints = materialize(fingerprints(rows, shingle_words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id"))
    distinct = materialize(prints.groupBy("fingerprint").agg(first.alias("first")), "distinct")
    labels = components(links(distinct, max_bits, blocks, pair_limit))
    rooted = distinct.join(labels, distinct["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("smallest"))
    by_print = rooted.join(smallest, "root").select("fingerprint", "smallest")
    return prints.join(by_print, "fingerprint").select(
        "row_id",
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("smallest.doc_id").alias("component_id"),
        (F.col("row_id") == F.col("smallest.row_id")).alias("keeper"),
    )
