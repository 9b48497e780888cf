"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

A token is drawn in three steps: the latent state follows a Markov chain, the state emits a word class,
and the class emits the word. The most frequent words are classes of their own; every other word belongs to
the class of its last bytes. So what the states learn is bounded by states x classes, while the words
inside a class keep exact corpus counts in a distributed table:

    p(word | class) = (count + 1) / (sum of count + 1 over the class, and 1 for unknown words)

* *Counts*: words of all training texts, summed per task and shuffled by word.
* *Training*: each round every task runs the scaled forward-backward recursion over its texts and hands on
  expected counts; they are summed by class and re-estimate the model. Texts are cut into passages of
  ``PASSAGE`` tokens for this, so that many advance at once.
* *Scoring*: the scaled forward recursion over each whole text gives its exact likelihood under the model.

Counts of words below the frequent ones are joined by shuffles, never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspectra.llm.common import Words, pieces, small_batches, take
from fleetspectra.sources.tables import materialize

STATES = 6
ROUNDS = 4
# Words that are classes of their own, and classes for the others by ending.
WORD_CLASSES = 4000
ENDING_CLASSES = 2048
ENDING_BYTES = 3
# Words whose counts every task holds; counts of all others are joined.
FREQUENT = 150_000
PASSAGE = 64
PASSAGES_AT_ONCE = 4096
SEED = 7
# Pseudo-counts of a round: emissions in proportion to the class's share, transitions each.
EMISSION_PRIOR = 200.0
TRANSITION_PRIOR = 1.0
# Tokens of texts that advance together when scored.
SCORE_TOKENS = 2_000_000


def training(doc_id: Column) -> Column:
    """Rows to learn from: the remainder of the id's checksum is not 2. A null id has an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 7 != 2


def _ending_class(vocabulary: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.fromiter(
        (digest(w[-ENDING_BYTES:]) % ENDING_CLASSES for w in vocabulary), np.int64, len(vocabulary)
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """``hash, ending, c``: how often each word stands in the training rows of ``text, train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words = Words(part.column("text"))
            n = np.bincount(words.codes, minlength=len(words.vocabulary))
            yield pa.record_batch(
                {
                    "hash": pa.array(words.hashes()),
                    "ending": pa.array(_ending_class(words.vocabulary).astype(np.int32)),
                    "n": pa.array(n.astype(np.int64)),
                }
            )

    partial = rows.filter("train").select("text").mapInArrow(run, "hash long, ending int, n long")
    return partial.groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("n").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """What tasks know of the words; every part has a stated largest size."""

    n_tokens: int  # training tokens, ends included
    n_types: int  # distinct training tokens, the end included
    n_texts: int
    hashes: np.ndarray  # of the frequent words, sorted
    counts: np.ndarray
    classes: np.ndarray  # of the frequent words
    log_size: np.ndarray  # log10 of the sum inside each class
    shares: np.ndarray  # share of each class in the training tokens

    @property
    def n_classes(self) -> int:
        return WORD_CLASSES + ENDING_CLASSES + 1

    @property
    def end(self) -> int:
        return self.n_classes - 1


def lexicon(counts: DataFrame, n_texts: int) -> Lexicon:
    """Totals, the frequent words, and the classes' sizes."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_words, n_types = total["n"] or 0, total["v"]
    # The lowest count at which no more than FREQUENT words remain.
    rising = W.orderBy(F.col("c").desc())
    levels = counts.groupBy("c").agg(F.count("*").alias("words"))
    low = (
        levels.withColumn("upto", F.sum("words").over(rising))
        .filter(F.col("upto") <= FREQUENT)
        .agg(F.min("c").alias("low"))
        .first()["low"]
    )
    found = counts.filter(F.col("c") >= (low if low is not None else 2**62)).toArrow().to_pandas()
    found = found.sort_values(["c", "hash"], ascending=[False, True], ignore_index=True)
    own = np.arange(len(found)) < WORD_CLASSES
    classes = np.where(own, np.arange(len(found)), WORD_CLASSES + found["ending"].to_numpy())
    # One row per ending class.
    sums = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow().to_pandas()
    size = np.zeros(WORD_CLASSES + ENDING_CLASSES + 1)
    mass = np.zeros_like(size)
    at = WORD_CLASSES + sums["ending"].to_numpy(dtype=np.int64)
    size[at] = sums["c"] + sums["v"]
    mass[at] = sums["c"]
    top = found[own]
    np.subtract.at(size, WORD_CLASSES + top["ending"].to_numpy(dtype=np.int64), top["c"] + 1)
    np.subtract.at(mass, WORD_CLASSES + top["ending"].to_numpy(dtype=np.int64), top["c"])
    size[WORD_CLASSES:-1] += 1  # unknown words
    size[: len(top)] = top["c"] + 1
    mass[: len(top)] = top["c"]
    size[-1], mass[-1] = 1, n_texts
    smooth = np.where(size > 0, mass + 0.5, 0.0)
    order = np.argsort(found["hash"].to_numpy(dtype=np.int64))
    return Lexicon(
        n_tokens=n_words + n_texts,
        n_types=n_types + (n_texts > 0),
        n_texts=n_texts,
        hashes=found["hash"].to_numpy(dtype=np.int64)[order],
        counts=found["c"].to_numpy(dtype=np.int64)[order],
        classes=classes[order].astype(np.int64),
        log_size=np.log10(np.maximum(size, 1)),
        shares=smooth / smooth.sum(),
    )


def encode(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Texts as classes: ``row_id, doc_id, train, n_tokens, n_frequent, frequent_score, size_score, classes
    binary, rare array<long>``.

    ``frequent_score`` adds log10(count + 1) over frequent words; the words in ``rare`` are looked up later.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        log_count = np.log10(lex.counts + 1.0)
        for part in pieces(batches):
            words = Words(part.column("text"))
            hashes = words.hashes()
            at = np.searchsorted(lex.hashes, hashes)
            at[at == len(lex.hashes)] = 0
            hit = lex.hashes[at] == hashes if len(lex.hashes) else np.zeros(len(hashes), bool)
            ending = WORD_CLASSES + _ending_class(words.vocabulary)
            if len(lex.hashes):
                kind = np.where(hit, lex.classes[at], ending)
                score = np.where(hit, log_count[at], 0.0)
            else:
                kind, score = ending, np.zeros(len(hashes))
            codes = words.codes
            is_rare = ~hit[codes]

            def per_text(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[words.starts[1:]] - sums[words.starts[:-1]]

            # Each text's classes are followed by the end.
            n = words.counts
            tokens = np.full(len(codes) + len(n), lex.end, np.uint16)
            places = np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)
            tokens[places] = kind[codes]
            cuts = (words.starts + np.arange(len(n) + 1)) * 2
            n_rare = np.concatenate([[0], np.cumsum(per_text(is_rare.astype(np.int64)))])
            yield pa.record_batch(
                {
                    "row_id": part.column("row_id"),
                    "doc_id": part.column("doc_id"),
                    "train": part.column("train"),
                    "n_tokens": pa.array(n + 1),
                    "n_frequent": pa.array(per_text((~is_rare).astype(np.int64))),
                    "frequent_score": pa.array(per_text(score[codes])),
                    "size_score": pa.array(per_text(lex.log_size[kind][codes])),
                    "classes": pa.Array.from_buffers(
                        pa.binary(),
                        len(n),
                        [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(tokens)],
                    ),
                    "rare": pa.ListArray.from_arrays(
                        pa.array(n_rare.astype(np.int32)), pa.array(hashes[codes][is_rare])
                    ),
                }
            )

    return rows.mapInArrow(
        run,
        "row_id long, doc_id long, train boolean, n_tokens long, n_frequent long, "
        "frequent_score double, size_score double, classes binary, rare array<long>",
    )


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # of a text
    middle: np.ndarray  # of a passage inside a text
    move: np.ndarray
    emit: np.ndarray  # classes x states


def first_model(lex: Lexicon, states: int = STATES, seed: int = SEED) -> Model:
    """Sticky states whose emissions are the classes' shares, pushed apart at random."""
    rng = np.random.default_rng(seed)
    emit = lex.shares[:, None] * np.exp(rng.normal(0.0, 1.0, (lex.n_classes, states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1.0 / states)
    return Model(even, even, move, emit / emit.sum(axis=0))


class Expected:
    """Expected counts of one task."""

    def __init__(self, classes: int, states: int):
        self.start = np.zeros(states)
        self.middle = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((classes, states))
        self.log_likelihood = 0.0

    def add(self, model: Model, tokens: np.ndarray, starts: np.ndarray) -> None:
        """Forward and backward over the texts ``tokens[starts[i]:starts[i + 1]]``, cut to passages."""
        lengths = np.diff(starts)
        n = -(-lengths // PASSAGE)
        first = np.repeat(starts[:-1], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = first + within * PASSAGE
        size = np.minimum(PASSAGE, np.repeat(starts[1:], n) - begin)
        order = np.argsort(-size, kind="stable")
        for low in range(0, len(order), PASSAGES_AT_ONCE):
            some = order[low : low + PASSAGES_AT_ONCE]
            self._passages(model, tokens, begin[some], size[some], within[some] == 0)

    def _passages(self, model, tokens, begin, size, opens) -> None:
        """Passages from long to short, so that those still running are the front of every array."""
        steps = int(size[0])
        running = np.searchsorted(-size, -np.arange(steps), side="left")
        alphas, seen, scales = [], [], []
        for t in range(steps):
            n = running[t]
            kinds = tokens[begin[:n] + t]
            emitted = model.emit[kinds]
            if t:
                alpha = (alphas[-1][:n] @ model.move) * emitted
            else:
                alpha = np.where(opens[:, None], model.start, model.middle) * emitted
            scale = alpha.sum(axis=1, keepdims=True)
            alpha /= scale
            self.log_likelihood += float(np.log(scale).sum())
            alphas.append(alpha)
            seen.append(kinds)
            scales.append(scale)
        beta = np.ones_like(alphas[-1])
        posteriors: list[np.ndarray] = [np.empty(0)] * steps
        for t in range(steps - 1, -1, -1):
            posteriors[t] = alphas[t] * beta
            if t:
                ahead = beta * model.emit[seen[t]] / scales[t]
                n = running[t]
                self.move += (alphas[t - 1][:n].T @ ahead) * model.move
                beta = np.ones((running[t - 1], beta.shape[1]))
                beta[:n] = ahead @ model.move.T
        self.start += posteriors[0][opens].sum(axis=0)
        self.middle += posteriors[0][~opens].sum(axis=0)
        kinds, weights = np.concatenate(seen), np.concatenate(posteriors)
        for k in range(weights.shape[1]):
            self.emit[:, k] += np.bincount(kinds, weights[:, k], minlength=len(self.emit))


def _tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a batch in one array, and where each text starts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint16, offsets[-1] // 2) if data else np.zeros(0, np.uint16)
    return flat.astype(np.int64), offsets // 2


def expected_counts(encoded: DataFrame, model: Model) -> DataFrame:
    """Sums over all training texts: rows of ``kind, place, s0, s1, ...``."""
    states = len(model.start)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = Expected(len(model.emit), states)
        for batch in batches:
            if batch.num_rows:
                sums.add(model, *_tokens_of(batch.column(0)))
        used = np.flatnonzero(sums.emit.any(axis=1))
        likelihood = np.zeros((1, states))
        likelihood[0, 0] = sums.log_likelihood
        tables = [
            (0, np.arange(1), sums.start[None]),
            (1, np.arange(1), sums.middle[None]),
            (2, np.arange(states), sums.move),
            (3, used, sums.emit[used]),
            (4, np.arange(1), likelihood),
        ]
        for kind, place, values in tables:
            yield pa.record_batch(
                {
                    "kind": pa.array(np.full(len(place), kind, np.int32)),
                    "place": pa.array(place.astype(np.int32)),
                    **{n: pa.array(np.ascontiguousarray(values[:, k])) for k, n in enumerate(names)},
                }
            )

    schema = "kind int, place int, " + ", ".join(f"{n} double" for n in names)
    rows = encoded.filter("train").select("classes").mapInArrow(run, schema)
    return rows.groupBy("kind", "place").agg(*[F.sum(n).alias(n) for n in names])


def baum_welch(
    encoded: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[Model, list[float]]:
    """The trained model, and the log likelihood of the training passages before each round.

    The driver gets one row per class and round, whatever the corpus.
    """
    model, history = first_model(lex, states, seed), []
    for _ in range(rounds):
        sums = expected_counts(encoded, model).toArrow().to_pandas()

        def table(kind: int, rows: int) -> np.ndarray:
            out = np.zeros((rows, states))
            part = sums[sums["kind"] == kind]
            out[part["place"].to_numpy()] = part[[f"s{k}" for k in range(states)]].to_numpy()
            return out

        start, middle = table(0, 1)[0] + 1, table(1, 1)[0] + 1
        move = table(2, states) + TRANSITION_PRIOR
        emit = table(3, lex.n_classes) + EMISSION_PRIOR * lex.shares[:, None]
        history.append(float(table(4, 1)[0, 0]))
        model = Model(
            start / start.sum(),
            middle / middle.sum(),
            move / move.sum(axis=1, keepdims=True),
            emit / emit.sum(axis=0),
        )
    return model, history


def forward(model: Model, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Exact log likelihood (natural) of each text's classes by the scaled forward recursion."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[:-1][order], lengths[order]
    total = np.zeros(len(order))
    if not len(order):
        return total
    running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    alpha = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, n in enumerate(running):
        moved = alpha[:n] @ model.move if t else alpha[:n]
        alpha = moved * model.emit[tokens[begin[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


def class_likelihood(encoded: DataFrame, model: Model) -> DataFrame:
    """``row_id, class_score``: log10 likelihood of each text's classes."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = np.cumsum(batch.column("n_tokens").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(n // SCORE_TOKENS)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    part = batch.slice(a, b - a)
                    scores = forward(model, *_tokens_of(part.column("classes"))) / np.log(10)
                    yield pa.record_batch(
                        {"row_id": part.column("row_id"), "class_score": pa.array(scores)}
                    )

    return encoded.select("row_id", "n_tokens", "classes").mapInArrow(
        run, "row_id long, class_score double"
    )


def score_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
    train: Column | None = None,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows for which ``train`` holds (a condition on ``doc_id``; by default ``training``).
    Letters A-Z are lowered, words are cut at white space, and an end follows each text. A null or empty
    text is the end alone, a null id is a text to learn from, and repeated rows count each time. Without
    any training text all counts are zero. An empty table gives an empty result; further columns are
    ignored. ``docs`` must read the same rows in the same order again, as a table or files do.
    """
    rows = take(small_batches(docs), doc_id=doc_id, text=text)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        (training(F.col("doc_id")) if train is None else F.coalesce(train, F.lit(True))).alias("train"),
        "text",
    )
    counts = materialize(word_counts(rows), "counts")
    lex = lexicon(counts, rows.filter("train").count())
    encoded = materialize(encode(rows, lex), "encoded")
    model, _ = baum_welch(encoded, lex, states, rounds)
    rare = (
        encoded.select("row_id", F.explode("rare").alias("h"))
        .join(counts.select(F.col("hash").alias("h"), "c"), "h", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_score"),
            F.count("c").alias("n_rare"),
        )
    )
    per_word = float(np.log10(lex.n_tokens + lex.n_types + 1))
    words = F.col("frequent_score") + F.coalesce("rare_score", F.lit(0.0))
    return (
        encoded.drop("classes", "rare")
        .join(rare, "row_id", "left")
        .join(class_likelihood(encoded, model), "row_id")
        .select(
            "doc_id",
            (~F.col("train")).alias("held_out"),
            "n_tokens",
            (
                F.col("n_frequent")
                + F.coalesce("n_rare", F.lit(0))
                + F.lit(1 if lex.n_texts else 0)
            ).alias("n_known"),
            F.lit(lex.n_tokens).cast("long").alias("train_tokens"),
            (words + float(np.log10(lex.n_texts + 1)) - F.col("n_tokens") * per_word).alias("base_score"),
            (words - F.col("size_score") + F.col("class_score")).alias("score"),
        )
    )
