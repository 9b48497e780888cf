"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target in words: its share of the whole by weight, at most ``max_repeats`` times
   its own size, the excess going to the others by weight (water level over sorted caps).
2. A source's documents fall into blocks of about ``block_words`` words, or of fewer where the shards would
   else be drawn from fewer than ``SHARD_BLOCKS`` blocks each, by a hash, that is, in permuted
   order. Whole passes over all blocks come first; of the last pass the first blocks are taken until the
   target is reached. The block on the border is taken in part: its documents in permuted order, each that
   still fits, and one more if that ends nearer to the target.
3. The blocks taken are exact quotas per source. A binary tree splits them among the output shards: at
   each node the left half gets as many blocks as its shards hold, and how many of them come from each
   source is drawn from the multivariate hypergeometric distribution, source by source. So every shard
   is a fair draw without replacement, found without listing the blocks.
4. A source's blocks in permuted order are cut by these numbers: each shard draws its own, disjoint
   blocks. Inside a shard rows are shuffled by a sort key.

Everything runs on built-in functions. Randomness is a hash of the seed and stable ids, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import WORD_CLASS, attach, prefix_sums, take
from fleetspectra.llm.ordering import numbered
from fleetspectra.sources.tables import materialize

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 65_536
# Documents of a border block that are judged in one go.
STRETCH = 256
# Small corpora have smaller blocks, so that a shard is drawn from about so many.
SHARD_BLOCKS = 512
SHARDS = 16
SEED = 20_240_101
# A shard's rows are written in 2 ** PIECE_BITS pieces.
PIECE_BITS = 8
# Tables of sources and of blocks are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 20_000
# Blocks of a source summed up in one piece.
BLOCK_CHUNK = 4096


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)) + 0.5) / float(2**52)


def targets(
    sizes: DataFrame, weights: Sequence[float], total_share: float, max_repeats: int
) -> DataFrame:
    """``source, source_size, target, source_no`` of ``source, source_size``.

    Weights repeat over the sources in order of code points, null last. The water level: sources sorted
    by cap / weight are capped from the front as long as the level of the rest is above theirs.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(everything) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = numbered.withColumns(
        {
            "weight": F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")),
            "cap": F.col("source_size") * float(max_repeats),
            "goal": F.sum("source_size").over(W.partitionBy()) * float(total_share),
        }
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    levels = weighted.withColumn("level", level)
    # Levels fall until the first source below its cap; from there the level holds for all.
    first_open = F.first(
        F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True
    ).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.select(
        "source",
        "source_size",
        "source_no",
        F.when(first_open.isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), first_open * F.col("weight")))
        .alias("target"),
    )


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed and written into the plan once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: exact products up to 20, Stirling's series beyond."""
    small = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))

    def series(x: Column) -> Column:
        tail = 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
        return x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + tail

    return F.when(n <= 20, small).otherwise(let(n.cast("double"), series))


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """The quantile of ``u``: how many of ``draws`` without replacement are good.

    Probabilities are summed over twelve standard deviations around the mean, which leaves out less
    than the rounding of a double.
    """

    def bounds(a: Column) -> Column:
        good, bad, draws = a["good"], a["bad"], a["draws"]
        total = F.greatest(good + bad, F.lit(1))
        mean = draws * good / total
        variance = mean * (bad / total) * ((total - draws) / F.greatest(total - 1, F.lit(1)))
        reach = 12 * F.sqrt(F.greatest(variance, F.lit(0.0))) + 12
        low = F.greatest(F.lit(0), draws - bad, F.floor(mean - reach)).cast("long")
        high = F.least(good, draws, F.ceil(mean + reach)).cast("long")
        return F.struct(
            good.alias("good"),
            bad.alias("bad"),
            draws.alias("draws"),
            a["u"].alias("u"),
            low.alias("low"),
            high.alias("high"),
        )

    def quantile(b: Column) -> Column:
        good, bad, draws, low = b["good"], b["bad"], b["draws"], b["low"]
        plus = [good, bad, draws, good + bad - draws]
        minus = [low, good - low, draws - low, bad - draws + low, good + bad]

        def total(terms: list[Column]) -> Column:
            logs = F.transform(F.array(*terms), log_factorial)
            return F.aggregate(logs, F.lit(0.0), lambda s, x: s + x)

        start = let(
            F.exp(total(plus) - total(minus)),
            lambda p: F.struct(low.alias("at"), p.alias("p"), p.alias("sum")),
        )

        def step(state: Column, k: Column) -> Column:
            up = (
                state["p"]
                * ((good - k + 1) / k)
                * ((draws - k + 1) / F.greatest(bad - draws + k, F.lit(1)))
            )
            more = F.struct(k.alias("at"), up.alias("p"), (state["sum"] + up).alias("sum"))
            return F.when((state["sum"] < b["u"]) & (state["at"] == k - 1), more).otherwise(state)

        steps = F.when(b["high"] > low, F.sequence(low + 1, b["high"])).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.aggregate(steps, start, step, lambda s: s["at"])

    given = F.struct(good.alias("good"), bad.alias("bad"), draws.alias("draws"), u.alias("u"))
    return let(let(given, bounds), quantile)


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``shard, source_no, blocks`` of ``source_no, quota``: exact quotas split among shards.

    Level by level each node (a range of shards with one quota per source) is halved; the blocks of its
    left half are drawn source by source, conditional on what is left. Shards differ by one block at
    most and every source's blocks add up to its quota.
    """
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = (
        quotas.agg(
            F.sort_array(
                F.collect_list(F.struct("source_no", F.col("quota").cast("long").alias("n")))
            ).alias("s")
        )
        .select(
            F.lit(0).alias("low"),
            F.lit(shards).alias("high"),
            F.col("s.source_no").alias("sources"),
            F.col("s.n").alias("q"),
        )
        .withColumns({"begin": F.lit(0).cast("long"), "end": total, "all_blocks": total})
    )
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    cut = F.floor(F.col("all_blocks") * middle / F.lit(shards)).cast("long")
    names = ["low", "high", "begin", "end", "q"]

    def draw(state: Column, x: Column) -> Column:
        u = uniform(F.lit(seed), F.col("low"), F.col("high"), x["no"])
        k = hypergeometric(x["n"], state["rest"] - x["n"], state["draws"], u)
        return let(
            k,
            lambda d: F.struct(
                (state["draws"] - d).alias("draws"),
                (state["rest"] - x["n"]).alias("rest"),
                F.concat(state["out"], F.array(d)).alias("out"),
            ),
        )

    start = F.struct(
        (cut - F.col("begin")).alias("draws"),
        (F.col("end") - F.col("begin")).alias("rest"),
        F.array().cast("array<bigint>").alias("out"),
    )
    pairs = F.zip_with("sources", "q", lambda no, n: F.struct(no.alias("no"), n.alias("n")))

    def halves(left: Column) -> Column:
        right = F.zip_with("q", left, lambda a, b: a - b)
        return F.array(
            F.struct(
                F.col("low"), middle.alias("high"), F.col("begin"), cut.alias("end"), left.alias("q")
            ),
            F.struct(
                middle.alias("low"), F.col("high"), cut.alias("begin"), F.col("end"), right.alias("q")
            ),
        )

    for _ in range(max(0, math.ceil(math.log2(shards)))):
        drawn = let(F.aggregate(pairs, start, draw, lambda s: s["out"]), halves)
        children = F.when(F.col("high") - F.col("low") > 1, drawn).otherwise(
            F.array(F.struct(*names))
        )
        nodes = nodes.select("sources", "all_blocks", F.explode(children).alias("c")).select(
            "sources", "all_blocks", "c.*"
        )
    return nodes.select(
        F.col("low").alias("shard"), F.explode(F.arrays_zip("sources", "q")).alias("x")
    ).select("shard", F.col("x.sources").alias("source_no"), F.col("x.q").alias("blocks"))


def _copy_numbers(sized: DataFrame) -> DataFrame:
    """``row_id, copy`` of the second and further rows of each ``doc_id``, in order of source and size.

    Rows without an id count as copies of one another. A hot id is numbered over slices of a range sort.
    """
    repeated = sized.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("d"))
    twins = sized.join(repeated, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    placed = numbered(
        twins.select("row_id", "doc_id", "source", "size"), "doc_id", ["source", "size", "row_id"], "copies"
    )
    return placed.filter("pos > 0").select("row_id", F.col("pos").alias("copy"))


def _filled(docs: Column, room: Column) -> Column:
    """The ``row_id`` of the documents that fill ``room``: in their order each that still fits, and one more
    if that ends nearer to it. Read in stretches of ``STRETCH``, so that no list grows one by one."""
    none = F.array().cast("array<boolean>")

    def one(state: Column, doc: Column) -> Column:
        fits = doc["size"] <= state["room"]
        return F.struct(
            F.when(fits, state["room"] - doc["size"]).otherwise(state["room"]).alias("room"),
            F.concat(state["taken"], F.array(fits)).alias("taken"),
        )

    def stretch(state: Column, part: Column) -> Column:
        begin = F.struct(state["room"].alias("room"), none.alias("taken"))
        return let(
            F.aggregate(part, begin, one),
            lambda end: F.struct(
                end["room"].alias("room"), F.concat(state["taken"], end["taken"]).alias("taken")
            ),
        )

    stretches = F.transform(
        F.sequence(F.lit(1), F.size(docs), F.lit(STRETCH)), lambda i: F.slice(docs, i, F.lit(STRETCH))
    )

    def finish(state: Column) -> Column:
        judged = F.zip_with(
            docs,
            state["taken"],
            lambda d, t: F.struct(
                d["size"].alias("size"), d["order_key"].alias("order_key"), d["row_id"].alias("row_id"), t.alias("taken")
            ),
        )
        return let(
            judged,
            lambda all_docs: let(
                F.array_min(F.filter(all_docs, lambda d: ~d["taken"])),
                lambda least: F.transform(
                    F.filter(
                        all_docs,
                        lambda d: d["taken"]
                        | (
                            (d["row_id"] == least["row_id"])
                            & (least["size"] - state["room"] < state["room"])
                        ),
                    ),
                    lambda d: d["row_id"],
                ),
            ),
        )

    return F.aggregate(stretches, F.struct(room.alias("room"), none.alias("taken")), stretch, finish)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``row_id, doc_id, size, source_size, target, draws``.

    ``draws`` lists the copies that the mix takes, each with its ``shard`` and ``position_key``; sorted by the
    key, a shard's rows are in shuffled order. A null text has no words, a null source is one of its own and
    comes last, a document of no words goes with the whole passes and blocks only, and repeated rows are
    drawn each on their own. An empty table gives empty results; further columns are ignored. ``docs`` must read the same rows
    in the same order again, as a table or files do; ``row_id`` then numbers them.
    """
    rows = take(docs, doc_id=doc_id, text=text, source=source).select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "source",
        words_of(F.col("text")).alias("size"),
    )
    sized = materialize(rows, "sizes")
    copies = _copy_numbers(sized)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, weights, total_share, max_repeats)
    whole = F.col("source_size").cast("double")
    mixed_words = F.sum("target").over(W.partitionBy())
    block = F.least(F.lit(block_words), F.greatest(F.lit(1), F.ceil(mixed_words / (shards * SHARD_BLOCKS))))
    plan = plan.withColumns(
        {
            "n_blocks": F.greatest(F.lit(1), F.ceil(whole / block)).cast("long"),
            "passes": F.when(whole > 0, F.floor(F.col("target") / whole))
            .otherwise(F.lit(0))
            .cast("long"),
        }
    ).withColumn("left_over", F.col("target") - F.col("passes") * whole)
    plan = materialize(plan, "targets")
    n_sources = plan.count()

    placed = attach(sized, plan, ["source"], n_sources, BROADCAST_ROWS)
    placed = placed.join(copies.withColumnRenamed("row_id", "r"), F.col("row_id") == F.col("r"), "left").drop("r")
    # Rows are told apart by id and copy, not by their place in the files; hashes skip nulls.
    placed = placed.withColumns(
        {
            "block": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy"), F.col("n_blocks")),
            "order_key": F.xxhash64(F.lit(seed + 1), "doc_id", "copy"),
        }
    )
    blocks = placed.groupBy("source_no", "block").agg(
        F.sum("size").alias("words"),
        F.first("left_over").alias("left_over"),
        F.first("passes").alias("passes"),
    ).withColumn("piece", F.floor(F.col("block") / BLOCK_CHUNK))
    # Blocks are permuted already, as documents fall into them by hash.
    blocks = prefix_sums(blocks, ["source_no"], "piece", [F.col("block")], before="words")
    behind = F.col("before") + F.col("words")
    blocks = materialize(
        blocks.select(
            "source_no",
            "block",
            "passes",
            "piece",
            (behind <= F.col("left_over")).cast("long").alias("whole"),
            F.when(
                (F.col("before") < F.col("left_over")) & (behind > F.col("left_over")),
                F.col("left_over") - F.col("before"),
            ).alias("room"),
        ),
        "blocks",
    )
    n_blocks = blocks.count()

    # The border block of each source: its documents in permuted order, each that still fits.
    border = blocks.filter(F.col("room").isNotNull()).select("source_no", "block", "room")
    on_border = attach(placed, border, ["source_no", "block"], n_sources, BROADCAST_ROWS).filter(
        F.col("room").isNotNull() & (F.col("size") > 0)
    )
    lists = on_border.groupBy("source_no").agg(
        F.sort_array(F.collect_list(F.struct("order_key", "row_id", "size"))).alias("docs"),
        F.first("room").alias("room"),
    )
    part = lists.select(F.explode(_filled(F.col("docs"), F.col("room"))).alias("r")).withColumn(
        "fits", F.lit(1).cast("long")
    )
    slim = placed.select(
        "row_id", "doc_id", "source_no", "block", "size", "source_size", "target", "order_key"
    )
    counted = attach(slim, blocks.drop("piece"), ["source_no", "block"], n_blocks, BROADCAST_ROWS)
    counted = counted.join(part, F.col("row_id") == F.col("r"), "left").withColumn(
        "copies", F.col("passes") + F.greatest(F.col("whole"), F.coalesce("fits", F.lit(0)))
    )

    # Quotas: each pass takes every block, the last pass the whole ones and the border block.
    extra = F.col("whole") + F.col("room").isNotNull().cast("long")
    quotas = blocks.groupBy("source_no").agg(
        F.sum(F.col("passes") + extra).alias("quota")
    )
    shares = materialize(split_tree(quotas, shards, seed), "shares")
    upto = W.partitionBy("source_no").orderBy("shard")
    ends = shares.withColumn("end", F.sum("blocks").over(upto)).groupBy("source_no").agg(
        F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends")
    )
    # Block copies in an order of their own, so that the copies of one block part ways.
    units = (
        blocks.withColumn("copies", F.col("passes") + extra)
        .filter("copies > 0")
        .select(
            "source_no",
            "block",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        .withColumn("unit_key", F.xxhash64(F.lit(seed + 2), "source_no", "block", "copy"))
        .withColumns({"one": F.lit(1).cast("long"), "range": F.shiftright("unit_key", 52)})
    )
    units = prefix_sums(units, ["source_no"], "range", [F.col("unit_key"), F.col("block")], rank="one")
    dealt = attach(units, ends, ["source_no"], n_sources, BROADCAST_ROWS).select(
        "source_no",
        "block",
        "copy",
        F.element_at(
            F.filter("ends", lambda e: e["end"] > F.col("rank")), 1
        )["shard"].alias("shard"),
    )
    per_block = materialize(
        dealt.groupBy("source_no", "block").agg(F.collect_list(F.struct("copy", "shard")).alias("u")),
        "dealt",
    )
    drawn = attach(counted, per_block, ["source_no", "block"], n_blocks, BROADCAST_ROWS)
    mine = F.filter(
        F.coalesce("u", F.array().cast("array<struct<copy:bigint,shard:int>>")),
        lambda x: x["copy"] <= F.col("copies"),
    )
    place = F.transform(
        mine,
        lambda x: F.struct(
            x["shard"].alias("shard"),
            F.xxhash64(F.lit(seed + 3), "order_key", "row_id", x["copy"]).alias("position_key"),
        ),
    )
    return drawn.select(
        "row_id", "doc_id", "size", "source_size", "target", place.alias("draws")
    )


def mixed_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as drawn, dealt by shard and shuffled inside it.

    A shard is written in pieces, ranges of its position key, so that few shards are many tasks too.
    """
    names = docs.columns
    tagged = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(
        "row", F.monotonically_increasing_id()
    )
    side = mixed.select(F.col("row_id").alias("drawn"), F.explode("draws").alias("draw"))
    piece = F.shiftright("draw.position_key", 64 - PIECE_BITS)
    return (
        tagged.join(side, F.col("row") == F.col("drawn"))
        .repartition("draw.shard", piece)
        .sortWithinPartitions("draw.shard", "draw.position_key")
        .select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    )
