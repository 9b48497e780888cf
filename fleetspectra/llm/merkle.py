"""Merkle dataset manifest: a hash tree per source under one root, stored every few levels only.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as their hex text. Each row is a
leaf. Per source the leaves ascend by id, and every ``FAN_OUT`` consecutive nodes become their H until one is
left: the source's root. The roots of the sources, in order of their names, make the top tree in like manner.

Of every ``STEP`` levels one is stored, as rows of up to ``FAN_OUT ** STEP`` aligned nodes. A proof is found
from the top down: a stored row regenerates the levels between itself and its parent, gives every node the
siblings on its way up, and forgets what it regenerated. Nothing depends on the number of leaves of a source
but the number of such rows, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.functions.intervals import let
from fleetspectra.llm.common import take
from fleetspectra.llm.ordering import numbered
from fleetspectra.sources.tables import materialize

# Sixteen nodes make one; digests are 64 hex digits.
FAN_OUT = 16
DIGEST = 64
# One level in so many is stored. The code below regenerates one level between two stored ones.
STEP = 2
BLOCK = FAN_OUT**STEP


def H(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value as UTF-8 with its byte count before it."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_hash(*values: Column) -> Column:
    return H(F.concat(*[field(v) for v in values]))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


@dataclass(frozen=True)
class Tree:
    """Trees of many keys. ``levels[i]`` holds level ``i * STEP`` as rows ``key, block, n, nodes``.

    ``n`` counts the key's nodes on the level, ``nodes`` are up to ``BLOCK`` structs that start with ``pos,
    hash``. ``roots`` has ``key, root``.
    """

    levels: tuple[DataFrame, ...]
    roots: DataFrame


def _runs(nodes: Column) -> Column:
    """The hashes of a row's nodes, joined in runs of ``FAN_OUT``."""
    hashes = F.transform(nodes, lambda x: x["hash"])
    last = F.floor((F.size(nodes) - 1) / FAN_OUT).cast("int")
    return let(
        hashes,
        lambda all_: F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(all_, i * FAN_OUT + 1, F.lit(FAN_OUT)), ""),
        ),
    )


def _blocks(nodes: DataFrame, *payload: str) -> DataFrame:
    """Rows ``key, pos, n, hash, ...`` as aligned rows of ``BLOCK`` nodes at most."""
    cell = F.struct("pos", "hash", *payload)
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    return nodes.groupBy("key", block.alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(cell)).alias("nodes")
    )


def _above(n: Column | str) -> Column:
    return F.ceil(F.col(n) / BLOCK) if isinstance(n, str) else F.ceil(n / BLOCK)


def _tops(level: DataFrame) -> DataFrame:
    """The next stored level, ``key, pos, n, hash``; a key that is down to one node has ``n`` 1."""
    middle = F.transform("runs", H)
    top = F.when(F.col("n") == 1, F.get("nodes", F.lit(0))["hash"]).otherwise(
        F.when(F.col("n") <= FAN_OUT, F.get(middle, F.lit(0))).otherwise(H(F.array_join(middle, "")))
    )
    return level.select("key", "block", "n", "nodes", _runs(F.col("nodes")).alias("runs")).select(
        "key", F.col("block").alias("pos"), _above("n").alias("n"), top.alias("hash")
    )


def build_tree(leaves: DataFrame, name: str, *payload: str) -> Tree:
    """Trees over rows ``key, pos, n, hash`` and further columns that stay with the leaves."""
    levels, roots = [], []
    blocks = _blocks(leaves, *payload)
    while True:
        blocks = materialize(blocks, f"{name}-level{len(levels) * STEP}")
        levels.append(blocks)
        tops = materialize(_tops(blocks), f"{name}-tops{len(levels) * STEP}")
        roots.append(tops.filter("n = 1").select("key", F.col("hash").alias("root")))
        open_ = tops.filter("n > 1")
        # One round per STEP levels: the logarithm of the largest key.
        if open_.isEmpty():
            break
        blocks = _blocks(open_)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Tree(tuple(levels), found)


_SIDES = "array<struct<l: string, r: string>>"


def _sides(run: Column, place: Column) -> Column:
    """What stands left and right of a run's node, as concatenated digests."""
    cut = (place * DIGEST).cast("int")
    return F.struct(
        F.substring(run, F.lit(1), cut).alias("l"),
        F.substring(run, cut + DIGEST + 1, F.lit(FAN_OUT * DIGEST)).alias("r"),
    )


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks joined to the path of their top node, with the levels between regenerated as ``runs, middle``."""
    joined = blocks.join(above, ["key", "block"])
    return joined.withColumn("runs", _runs(F.col("nodes"))).withColumn(
        "middle", F.array_join(F.transform("runs", H), "")
    )


def _way_up(place: Column) -> Column:
    """The sides of a block's node (numbered in the block) on all levels up to the root."""
    run, inside = F.floor(place / FAN_OUT).cast("int"), place % FAN_OUT
    none = F.array().cast(_SIDES)
    low = F.when(F.col("n") > 1, F.array(_sides(F.get("runs", run), inside))).otherwise(none)
    high = F.when(F.col("n") > FAN_OUT, F.array(_sides(F.col("middle"), run))).otherwise(none)
    return F.concat(low, high, F.col("path"))


def descend(tree: Tree, heads: DataFrame) -> DataFrame:
    """Level 0 blocks with ``path`` of the block's top node and what else ``heads`` says of their key.

    ``heads`` has ``key, path`` (the siblings above the key's root) and further columns; keys without a row
    there are left out, and nothing of them is regenerated.
    """
    carried = [c for c in heads.columns if c not in ("key", "path")]
    below = None
    for i in reversed(range(len(tree.levels))):
        level = tree.levels[i]
        # A key whose nodes fill one block ends on this level; the others have parents on the level above.
        ending = _with_paths(
            level.filter(F.col("n") <= BLOCK), heads.withColumn("block", F.lit(0).cast("long"))
        )
        blocks = ending
        if below is not None:
            blocks = ending.unionByName(_with_paths(level.filter(F.col("n") > BLOCK), below))
        if i == 0:
            return blocks
        node = F.transform(
            "nodes", lambda x, j: F.struct(x["pos"].alias("block"), _way_up(j).alias("path"))
        )
        below = materialize(
            blocks.select("key", *carried, F.inline(node)), f"paths-level{i * STEP}"
        )


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, side: H(F.concat(side["l"], node, side["r"])))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return H(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


@dataclass(frozen=True)
class Manifest:
    """Leaves with their ``doc_id`` and ``altered`` hash, one tree per source and the tree above them."""

    sources: Tree
    top: Tree
    root: str | None


def _key(source: Column) -> Column:
    """Sorts null first, then by UTF-8 bytes, and is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source))


def build_manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (``doc_id, source, lang, n_chars, text``).

    A null in any column is hashed as ``-``; rows without a source form a tree of their own, before all
    others; null ids come first, and rows of equal id are ordered by their leaf. Repeated rows are leaves
    each. Texts of any length are hashed where they are read, and only hashes move. An empty table has no
    root. Further columns are ignored. ``altered`` may give, from these five columns, another text whose leaf
    is kept beside the true one, for tests of the proof.
    """
    rows = take(docs, "doc_id", "source", "lang", "n_chars", "text")
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    true = leaf_hash(*parts, F.col("text"))
    other = F.lit(None).cast("string") if altered is None else altered
    hashes = materialize(
        rows.select(
            _key(F.col("source").cast("string")).alias("key"),
            "doc_id",
            true.alias("hash"),
            # Null where the row's text is left alone.
            F.when(other.isNotNull(), leaf_hash(*parts, other)).alias("altered"),
        ),
        "leaves",
    )
    # Rows of equal id and leaf are the same row; which comes first changes nothing.
    leaves = numbered(hashes, "key", ["doc_id", "hash"], "leaves-sorted")
    sources = build_tree(leaves, "source-tree", "doc_id", "altered")
    roots = sources.roots.select(
        F.lit("").alias("key"), F.col("key").alias("source"), F.col("root").alias("hash")
    )
    top = build_tree(numbered(roots, "key", ["source"], "sources-sorted"), "top-tree", "source")
    root = top.roots.first()
    return Manifest(sources, top, root["root"] if root else None)


def proofs(manifest: Manifest, sources: DataFrame | None = None) -> DataFrame:
    """Blocks of leaves with all that their proofs need; with ``sources`` (``source``) only for these."""
    none = F.array().cast(_SIDES)
    heads = manifest.top.roots.select("key", none.alias("path"), "root")
    way = F.transform(
        "nodes",
        lambda x, j: F.struct(
            x["source"].alias("key"), x["hash"].alias("subroot"), _way_up(j).alias("path")
        ),
    )
    tops = descend(manifest.top, heads).select("root", F.inline(way))
    if sources is not None:
        wanted = sources.select(_key(F.col("source").cast("string")).alias("key"))
        tops = tops.join(wanted, "key", "left_semi")
    return descend(manifest.sources, tops)


def verify(blocks: DataFrame) -> DataFrame:
    """Per leaf the digest of its proof, and whether the leaf, or its altered form, still gives the root.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    row = F.transform(
        "nodes",
        lambda x, j: let(
            _way_up(j),
            lambda path: F.struct(
                x["doc_id"].alias("doc_id"),
                x["hash"].alias("leaf"),
                proof_digest(path).alias("proof_sha256"),
                fold(F.coalesce(x["altered"], x["hash"]), path).alias("folded_root"),
            ),
        ),
    )
    return blocks.select("subroot", "root", F.inline(row)).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
