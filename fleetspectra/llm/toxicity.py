"""Severity of toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - threshold k): one weight vector shared by all thresholds, which rise. The
features are sparse: log(1 + count) of the words that labelled rows tie to toxicity. Fitting uses a bounded
sample of labelled rows (``SAMPLE_ROWS``); scoring reads every text whole, map-side.

Labels say yes or no, so a toxic row of the sample is graded by how many tied words it has
(``GRADE_STEPS``): 1 for few, then 2, then 3. A table with grades of its own can be given instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import Words, pieces, small_batches, take
from fleetspectra.sources.tables import materialize

SAMPLE_ROWS = 20_000
FEATURES = 512
# A word is tied to toxicity if the lower bound of its log odds ratio is at least this.
LEAST_LOG_ODDS = 2.0
GRADE_STEPS = (3, 10)
REJECT_AT = 0.5
RIDGE = 1e-5
ITERATIONS = 600
# Stripped from both ends of a word.
EDGES = b".,;:!?\"'()[]{}<>*_-|/#$%&+=~`"


@dataclass(frozen=True)
class Model:
    """``FEATURES`` words at most, by hash, with their weights, and rising thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row per score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))


def word_hashes(words: Words) -> np.ndarray:
    """Hash per word of the vocabulary without its edge marks; 0 for marks alone."""
    digest = xxhash.xxh64_intdigest
    bare = (w.strip(EDGES) for w in words.vocabulary)
    return np.fromiter(
        ((digest(w) >> 1) if w else 0 for w in bare), np.int64, len(words.vocabulary)
    )


def text_features(rows: DataFrame) -> DataFrame:
    """``doc_id, grade, words array<struct<h, n>>``: how often each word stands in each text."""
    item = pa.struct([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words = Words(part.column("text"))
            hashes = word_hashes(words)
            kinds, kind = np.unique(hashes, return_inverse=True)
            row = np.repeat(np.arange(len(words.counts)), words.counts)
            pair, n = np.unique(row * max(1, len(kinds)) + kind[words.codes], return_counts=True)
            found = pa.StructArray.from_arrays(
                [pa.array(kinds[pair % max(1, len(kinds))]), pa.array(n)], fields=list(item)
            )
            cuts = np.searchsorted(pair, np.arange(len(words.counts) + 1) * max(1, len(kinds)))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "grade": part.column("grade"),
                    "words": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), found),
                }
            )

    return rows.select("doc_id", "grade", "text").mapInArrow(
        run, "doc_id long, grade int, words array<struct<h: bigint, n: bigint>>"
    )


def _fit(x_row, x_word, x_value, grades: np.ndarray, n_words: int, top: int) -> tuple:
    """Gradient steps (Adam) on the mean log loss; thresholds are a first one and positive gaps."""
    p = np.zeros(n_words + top)
    p[n_words] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(grades)
    for step in range(1, ITERATIONS + 1):
        w = p[:n_words]
        gaps = np.exp(np.clip(p[n_words + 1 :], -10, 10))
        theta = p[n_words] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(x_row, w[x_word] * x_value, minlength=n)
        above = 1.0 / (1.0 + np.exp(np.clip(theta - eta[:, None], -60, 60)))
        full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        at = np.arange(n)
        upper, lower = full[at, grades], full[at, grades + 1]
        like = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / like, lower * (1 - lower) / like
        d_eta = -(d_upper - d_lower) / n
        d_theta = np.zeros(top + 2)
        np.add.at(d_theta, grades, d_upper / n)
        np.add.at(d_theta, grades + 1, -d_lower / n)
        d_theta = d_theta[1 : top + 1]
        g = np.empty_like(p)
        g[:n_words] = np.bincount(x_word, d_eta[x_row] * x_value, minlength=n_words) + RIDGE * w
        g[n_words] = d_theta.sum()
        g[n_words + 1 :] = np.cumsum(d_theta[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(p[n_words + 1 :], -10, 10))
    return p[:n_words], p[n_words] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    grade: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from at most ``sample_rows`` labelled rows: ids in the order of a hash of the id, a row of each.

    ``docs`` must read the same rows in the same order again, as a table or files do. Repeated labels of an id count as their highest; null ids and null grades are left out. Grades are 0 for
    clean and 1, 2, ... for rising severity; if none exceeds 1, toxic rows are graded by ``GRADE_STEPS``.
    Without labels of both kinds the model has no words and finds nothing toxic.
    """
    graded = take(labels, id=doc_id, grade=grade).filter("id is not null and grade is not null")
    chosen = (
        graded.groupBy("id")
        .agg(F.max(F.col("grade").cast("int")).alias("grade"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    chosen = materialize(chosen, "chosen")
    # Bounded by the sample size. Of each id one row, so that the sample is bounded in rows too.
    numbered = take(small_batches(docs), doc_id=doc_id, text=text).withColumn(
        "row_id", F.monotonically_increasing_id()
    )
    of_chosen = numbered.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    one_each = of_chosen.groupBy("id").agg(F.min(F.struct(F.xxhash64("row_id"), "row_id"))["row_id"].alias("r"))
    one_each = materialize(one_each.select("r"), "sampled")
    rows = of_chosen.join(F.broadcast(one_each), F.col("row_id") == F.col("r"), "left_semi")
    sample = materialize(text_features(rows), "sample")
    kinds = sample.agg(
        F.count(F.when(F.col("grade") > 0, 1)).alias("toxic"),
        F.count(F.when(F.col("grade") <= 0, 1)).alias("clean"),
        F.max("grade").alias("top"),
    ).first()
    none = Model(np.zeros(0, np.int64), np.zeros(0), np.array([10.0]))
    if not kinds["toxic"] or not kinds["clean"]:
        return none
    toxic, clean = F.lit(kinds["toxic"]), F.lit(kinds["clean"])
    word = sample.select((F.col("grade") > 0).alias("t"), F.explode("words.h").alias("h"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    a_not, b_not = toxic - F.col("a") + 0.5, clean - F.col("b") + 0.5
    spread = F.sqrt(1 / a + 1 / a_not + 1 / b + 1 / b_not)
    tied = (
        word.filter("h != 0")
        .groupBy("h")
        .agg(F.count_if("t").alias("a"), F.count_if(~F.col("t")).alias("b"))
        .withColumn("low", F.log(a / a_not) - F.log(b / b_not) - 1.96 * spread)
        .filter(F.col("low") >= LEAST_LOG_ODDS)
        .orderBy(F.col("low").desc(), "h")
        .limit(FEATURES)
    )
    hashes = np.sort(np.array([r["h"] for r in tied.select("h").collect()], np.int64))
    if not len(hashes):
        return none
    # Per sampled row only the chosen words: sample size times number of words at most.
    def chosen_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten()
            h = np.asarray(flat.field("h"))
            at = np.searchsorted(hashes, h).clip(0, len(hashes) - 1)
            hit = hashes[at] == h
            upto = np.concatenate([[0], np.cumsum(hit)])
            cuts = np.asarray(lists.offsets)
            cuts = pa.array(upto[cuts - cuts[0]].astype(np.int32))
            yield pa.record_batch(
                {
                    "grade": batch.column("grade"),
                    "at": pa.ListArray.from_arrays(cuts, pa.array(at[hit])),
                    "n": pa.ListArray.from_arrays(cuts, pa.array(np.asarray(flat.field("n"))[hit])),
                }
            )

    rows = (
        sample.select("grade", "words")
        .mapInArrow(chosen_words, "grade int, at array<long>, n array<long>")
        .toArrow()
    )
    grades = np.asarray(rows.column("grade")).astype(np.int64).clip(0)
    found = rows.column("at").combine_chunks()
    x_row = np.repeat(np.arange(len(grades)), np.diff(np.asarray(found.offsets)))
    x_word = np.asarray(found.flatten())
    counts = np.asarray(rows.column("n").combine_chunks().flatten())
    if grades.max() <= 1:
        hits = np.bincount(x_row, counts, minlength=len(grades))
        grades = grades * (1 + sum((hits >= s).astype(np.int64) for s in GRADE_STEPS))
    weights, thresholds = _fit(
        x_row, x_word, np.log1p(counts), grades, len(hashes), int(grades.max())
    )
    return Model(hashes, weights, thresholds)


def severity_udf(model: Model):
    """A column of structs from a column of texts: ``expected_severity`` and ``p_toxic``."""

    @F.arrow_udf("struct<expected_severity: double, p_toxic: double>")
    def severity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = []
            for piece in pieces([pa.record_batch({"text": text})]):
                words = Words(piece.column("text"))
                at = np.searchsorted(model.hashes, hashes := word_hashes(words))
                at[at == len(model.hashes)] = 0
                if len(model.hashes):
                    feature = np.where(model.hashes[at] == hashes, at, -1)[words.codes]
                else:
                    feature = np.full(len(words.codes), -1)
                row = np.repeat(np.arange(len(words.counts)), words.counts)[feature >= 0]
                width = max(1, len(model.hashes))
                pair, n = np.unique(row * width + feature[feature >= 0], return_counts=True)
                weight = model.weights[pair % width] if len(pair) else np.zeros(0)
                eta = np.bincount(pair // width, weight * np.log1p(n), minlength=len(words.counts))
                above = model.at_least(eta)
                parts.append(
                    pa.StructArray.from_arrays(
                        [pa.array(above.sum(axis=1)), pa.array(above[:, 0])],
                        ["expected_severity", "p_toxic"],
                    )
                )
            yield pa.concat_arrays(parts) if parts else pa.array(
                [], pa.struct([("expected_severity", pa.float64()), ("p_toxic", pa.float64())])
            )

    return severity


def score_toxicity(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", at: float = REJECT_AT
) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, rejected`` of every row.

    The expected severity is the sum of P(grade >= k) over the thresholds; a row is rejected when P(grade
    >= 1) is at least ``at``. A null or empty text has no features, so its score is that of a clean text;
    repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
    """
    rows = take(small_batches(docs), doc_id=doc_id, text=text)
    scored = rows.select("doc_id", severity_udf(model)("text").alias("s"))
    return scored.select(
        "doc_id",
        "s.expected_severity",
        "s.p_toxic",
        (F.col("s.p_toxic") >= at).alias("rejected"),
    )
