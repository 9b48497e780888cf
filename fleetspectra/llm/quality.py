"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words, the shapes of its words (runs of capitals, small letters, digits and marks),
pairs of neighbouring shapes, and words said twice in a row, each hashed into a fixed number of features.
One pass over all documents counts in how many a feature occurs and sums the products of features; weighted
by inverse document frequency, the leading eigenvectors of these products are the latent axes. Vectors of
a bounded sample of labelled rows go to every task, which multiplies them with its documents in blocks,
exactly, and lets the nearest vote by their cosine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import Words, pieces, small_batches, take

# Features of words, of shapes, of pairs of shapes, and one for a repeated word.
WORDS, SHAPES, PAIRS = 320, 96, 95
FEATURES = WORDS + SHAPES + PAIRS + 1
# Length of the latent vectors.
AXES = 48
# Labelled rows that vote, at most, and how many neighbours a text asks.
SAMPLE_ROWS = 4096
NEIGHBOURS = 15
ACCEPT_AT = 0.7
# Documents of one block of cosine products.
BLOCK_ROWS = 256
_TIE = 1e-9

# How a byte shows in a shape. Bytes beyond ASCII count as small letters.
_CLASS = bytes.maketrans(
    bytes([*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]),
    b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128,
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` values per text: square roots of each feature's share of the words.

    Whole texts are read; a text without words has zeros only.
    """
    words = Words(texts, lower=False)
    n = words.counts
    rows, codes = np.repeat(np.arange(len(n)), n), words.codes
    digest = xxhash.xxh64_intdigest
    lower = np.fromiter((digest(w.lower()) for w in words.vocabulary), np.uint64, len(words.vocabulary))
    shape = np.fromiter(
        (digest(_RUN.sub(rb"\1", w.translate(_CLASS))) for w in words.vocabulary),
        np.uint64,
        len(words.vocabulary),
    )
    own = (lower % np.uint64(WORDS)).astype(np.int64)[codes]
    mark = (shape % np.uint64(SHAPES)).astype(np.int64)[codes] + WORDS
    following = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    before = shape[codes[following - 1]] * np.uint64(0x9E3779B97F4A7C15)
    pair = ((before ^ shape[codes[following]]) % np.uint64(PAIRS)).astype(np.int64) + WORDS + SHAPES
    twice = following[lower[codes[following]] == lower[codes[following - 1]]]
    at = np.concatenate(
        [
            rows * FEATURES + own,
            rows * FEATURES + mark,
            rows[following] * FEATURES + pair,
            rows[twice] * FEATURES + FEATURES - 1,
        ]
    )
    counts = np.bincount(at, minlength=len(n) * FEATURES).reshape(len(n), FEATURES)
    return np.sqrt(counts / np.maximum(n, 1)[:, None])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums, a row per feature: documents, documents with it, products with it and later ones."""
    total, found, products = 0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
    for piece in pieces(batches):
        x = features(piece.column("text"))
        total += len(x)
        found += (x > 0).sum(axis=0)
        products += x.T @ x
    if total:
        yield _sums(total, found, {i: products[i, i:] for i in range(FEATURES)})


def _sums(total: int, found, products: dict[int, np.ndarray]) -> pa.RecordBatch:
    at = list(products)
    return pa.record_batch(
        {
            "feature": pa.array(at, pa.int32()),
            "total": pa.array([total] * len(at), pa.int64()),
            "found": pa.array([float(found[i]) for i in at]),
            "products": pa.array([products[i] for i in at], pa.list_(pa.float64())),
        }
    )


_SUMS = "feature int, total long, found double, products array<double>"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by feature; a task holds one row per feature that is dealt to it."""
    total: dict[int, int] = {}
    found: dict[int, float] = {}
    products: dict[int, np.ndarray] = {}
    for batch in batches:
        values = batch.column("products")
        for k, i in enumerate(batch.column("feature").to_pylist()):
            row = np.asarray(values[k].values)
            total[i] = total.get(i, 0) + batch.column("total")[k].as_py()
            found[i] = found.get(i, 0.0) + batch.column("found")[k].as_py()
            products[i] = products[i] + row if i in products else row.copy()
    for i in products:
        yield _sums(total[i], found, {i: products[i]})


def latent_axes(docs: DataFrame, text: str = "text", axes: int = AXES) -> np.ndarray:
    """The projection of features to latent vectors, ``FEATURES`` x ``axes``, from all of ``docs``.

    What reaches the driver is ``FEATURES`` rows, whatever the size of the input. Null and empty texts add
    nothing but their number.
    """
    rows = take(small_batches(docs), text=text).withColumn("text", F.col("text").cast("string"))
    sums = rows.mapInArrow(_products, _SUMS).repartition("feature").mapInArrow(_added, _SUMS)
    found, products, total = np.zeros(FEATURES), np.zeros((FEATURES, FEATURES)), 0
    for row in sums.collect():
        i = row["feature"]
        total, found[i] = row["total"], row["found"]
        products[i, i:] = products[i:, i] = row["products"]
    weight = np.log((1 + total) / (1 + found)) + 1
    values, vectors = np.linalg.eigh(products * weight[:, None] * weight)
    # Largest first; the sign of an axis changes no cosine.
    return weight[:, None] * vectors[:, np.argsort(-values)[:axes]]


def latent_vectors(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors, or zeros for a text without words."""
    y = x @ axes
    length = np.linalg.norm(y, axis=1, keepdims=True)
    return y / np.where(length > 0, length, 1.0)


@dataclass(frozen=True)
class Voters:
    """Latent axes, and the unit vectors and labels (0 to 1) of the rows that vote."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Mean label of each vector's nearest voters, weighted by cosine where that is positive.

        Voters as near as the last one asked vote too, so their order never matters. A vector that no voter is
        near to, such as that of an empty text, gets the mean of all labels; without voters it is 0.5.
        """
        n = len(self.labels)
        if not n:
            return np.full(len(vectors), 0.5)
        k = min(neighbours, n)
        out = np.full(len(vectors), self.labels.mean())
        for low in range(0, len(vectors), BLOCK_ROWS):
            cosine = vectors[low : low + BLOCK_ROWS] @ self.vectors.T
            last = np.partition(cosine, n - k, axis=1)[:, n - k]
            weight = np.where(cosine >= last[:, None] - _TIE, cosine, 0.0)
            weight[weight < _TIE] = 0.0
            whole = weight.sum(axis=1)
            near = whole > 0
            out[low : low + BLOCK_ROWS][near] = (weight @ self.labels)[near] / whole[near]
        return out.clip(0.0, 1.0).round(9)


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Callable[[Column], Column] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Voters:
    """Latent axes from all documents, and at most ``sample_rows`` labelled rows as voters.

    ``learn`` tells from a doc_id whether its label may be used. Voters are taken in the order of a hash of
    their id. Null ids and null labels are left out; several labels of an id count as their mean. Labels are
    the only thing taken from ``labels``, and a vector is made of the text alone.
    """
    axes = latent_axes(docs, text)
    given = take(labels, id=doc_id, label=quality).filter("id is not null and label is not null")
    if learn is not None:
        given = given.filter(learn(F.col("id")))
    there = take(docs, id=doc_id).distinct()
    chosen = (
        given.groupBy("id")
        .agg(F.avg(F.col("label").cast("double")).alias("label"))
        .join(there, "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    rows = take(small_batches(docs), doc_id=doc_id, text=text)
    rows = rows.withColumn("text", F.col("text").cast("string"))
    # Bounded by the sample size.
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            made = latent_vectors(features(piece.column("text")), axes)
            yield pa.record_batch(
                {
                    "id": piece.column("id"),
                    "label": piece.column("label"),
                    "vector": pa.array(list(made), pa.list_(pa.float64())),
                }
            )

    # An id may stand in many rows, so the bound is set on the rows again.
    found = (
        rows.select("id", "label", "text")
        .mapInArrow(vectors, f"id {dict(chosen.dtypes)['id']}, label double, vector array<double>")
        .orderBy(F.xxhash64("id"), "id", "vector")
        .limit(sample_rows)
        .collect()
    )
    return Voters(
        axes,
        np.array([r["vector"] for r in found]).reshape(len(found), axes.shape[1]),
        np.array([r["label"] for r in found], float),
    )


def score_quality(
    docs: DataFrame, voters: Voters, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score, predicted`` of every row; the higher the score, the likelier is label 1.

    Null and empty texts have no words and get the mean of the voters' labels. Repeated rows are scored each,
    an empty table gives an empty result, and further columns are ignored.
    """
    rows = take(small_batches(docs), doc_id=doc_id, text=text)
    rows = rows.withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            model = sent.value
            made = latent_vectors(features(piece.column("text")), model.axes)
            yield pa.record_batch(
                {"doc_id": piece.column("doc_id"), "score": pa.array(model.score(made))}
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= ACCEPT_AT).cast("int")
    )
