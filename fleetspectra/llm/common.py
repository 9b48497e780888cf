"""What several corpus operators share: column choice, prefix sums, and words as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The white space that separates words, and the class of everything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def take(df: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    """Only the named columns, each under its own or a given new name.

    An exact name wins over one in other case, and the first of several equal names over the rest, so
    further columns of any name never clash with the ones an operator adds.
    """
    names = df.columns
    lower = [n.lower() for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def at(name: str) -> Column:
        if name in names:
            return F.col(f"c{names.index(name)}")
        if name.lower() in lower:
            return F.col(f"c{lower.index(name.lower())}")
        raise ValueError(f"no column {name!r} among {names}")

    wanted = {**{c: c for c in columns}, **renamed}
    return plain.select(*[at(source).alias(name) for name, source in wanted.items()])


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], rows: int, bound: int) -> DataFrame:
    """Left join of ``small`` (``rows`` rows, one per key) by null-safe keys.

    It is broadcast only while its counted rows stay within ``bound``; otherwise both sides are
    shuffled and the planner splits skewed keys.
    """
    renamed = small.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    side = F.broadcast(renamed) if rows <= bound else renamed
    return df.join(side, on, "left").drop(*[f"_{k}" for k in keys])


def prefix_sums(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[Column], **values: str
) -> DataFrame:
    """Adds, per key, the sum of each value over the rows that come before (``name=value column``).

    ``chunk`` must rise with the order and cuts a key into pieces that are summed apart; only the
    pieces' totals are added up per key, so a key with a third of all rows is not one task.
    """
    columns = df.columns
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = df.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(v).over(before), zero) for n, v in values.items()}
    )
    totals = df.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    chunks = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, chunk]],
        *[F.coalesce(F.sum(f"_sum_{n}").over(chunks), zero).alias(f"_off_{n}") for n in values],
    )
    on = F.lit(True)
    for k in [*keys, chunk]:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(offsets, on).select(
        *columns, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in values]
    )


class Words:
    """The words of a batch of texts: ``codes`` into ``vocabulary``, cut by ``starts`` per text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        if texts.offset:
            # String kernels misread slices, so a slice is copied first.
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        full = np.asarray(pc.binary_length(flat)) > 0
        ends = np.asarray(parts.offsets)
        kept = np.concatenate([[0], np.cumsum(full)])
        self.starts = kept[ends - ends[0]].astype(np.int64)
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = np.asarray(coded.indices).astype(np.int64)
        self.dictionary: pa.Array = coded.dictionary

    @cached_property
    def vocabulary(self) -> list[bytes]:
        return self.dictionary.cast(pa.large_binary()).to_pylist()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word of the vocabulary, as signed integers."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter(
            (digest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary)
        ).view(np.int64)


# Texts handed to a Python worker at once; Spark's own default of 10,000 is meant for narrow rows.
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, after lowering its session's batch size to ``BATCH_ROWS`` where it is larger.

    Every running task holds a batch of whole texts in the JVM and again in its worker.
    """
    spark = df.sparkSession
    now = int(spark.conf.get(_BATCH_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


# A batch of texts is handled in pieces of about so many bytes.
PIECE_BYTES = 6_000_000


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece holds about ``PIECE_BYTES`` of text, or one longer text.

    What Arrow keeps of a piece's memory is handed back, as an executor runs several workers.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        part = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.take(pa.array(np.arange(a, b)))
            pa.default_memory_pool().release_unused()
