import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetspectra.llm import hmm
from fleetspectra.llm.hmm import Expected, Model, forward, score_documents


def corpus(n=240, seed=2):
    """Two languages of own words and endings."""
    rng = random.Random(seed)
    words = {0: [f"{a}{b}ing" for a in "abcd" for b in "efgh"], 1: [f"{a}{b}heit," for a in "klmn" for b in "opqr"]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(rng.randint(1, 30)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (None, "AEing new"), (902, "Unseen words here"), (1, "aeing aeing")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, ROW_ID int")


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    def rows(a):
        return a / a.sum(axis=1, keepdims=True)
    emit = rows(rng.random((2, 4))).T
    return Model(rows(rng.random((1, 2)))[0], rows(rng.random((1, 2)))[0], rows(rng.random((2, 2))), emit)


def paths(model, start, seen):
    for z in itertools.product(range(2), repeat=len(seen)):
        p = start[z[0]] * model.emit[seen[0], z[0]]
        for a, b, c in zip(z, z[1:], seen[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        yield z, p


def test_forward_is_exact(model):
    texts = [[0], [3, 1, 2, 2, 0, 1], [1, 1, 0], [2, 3, 3, 0]]
    flat = np.array([c for t in texts for c in t])
    starts = np.cumsum([0, *map(len, texts)])
    want = [math.log(sum(p for _, p in paths(model, model.start, t))) for t in texts]
    assert np.allclose(forward(model, flat, starts), want)


def test_expected_counts_match_all_paths(model, monkeypatch):
    monkeypatch.setattr(hmm, "PASSAGE", 4)
    texts = [[0, 2, 1], [3, 1, 2, 2, 0, 1, 1], [2]]
    flat = np.array([c for t in texts for c in t])
    got = Expected(4, 2)
    got.add(model, flat, np.cumsum([0, *map(len, texts)]))
    start, middle, move, emit, total = np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for text in texts:
        for at in range(0, len(text), 4):
            part = text[at : at + 4]
            every = list(paths(model, model.middle if at else model.start, part))
            like = sum(p for _, p in every)
            total += math.log(like)
            for z, p in every:
                (middle if at else start)[z[0]] += p / like
                for a, b in zip(z, z[1:]):
                    move[a, b] += p / like
                for s, c in zip(z, part):
                    emit[c, s] += p / like
    for a, b in ((got.start, start), (got.middle, middle), (got.move, move), (got.emit, emit)):
        assert np.allclose(a, b)
    assert math.isclose(got.log_likelihood, total)


@pytest.mark.parametrize("frequent", [hmm.FREQUENT, 5])
def test_base_counts_match_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    rows = corpus()
    got = score_documents(frame(spark, rows), states=2, rounds=1).collect()
    assert len(got) == len(rows)
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), held(d), len(ws), sum(w in counts for w in ws), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for d, ws in tokens
    )
    names = ["held_out", "n_tokens", "n_known", "train_tokens"]
    assert want == sorted(
        (str(r["doc_id"]), *[r[x] for x in names], round(r["base_score"], 6)) for r in got
    )


def test_training_raises_the_likelihood_and_held_out_texts_score_better(spark):
    docs = frame(spark, corpus())
    rows = docs.selectExpr(
        "monotonically_increasing_id() as row_id", "doc_id", "text"
    ).withColumn("train", hmm.training(hmm.F.col("doc_id")))
    counts = hmm.word_counts(rows)
    lex = hmm.lexicon(counts, rows.filter("train").count())
    encoded = hmm.encode(rows, lex).cache()
    _, history = hmm.baum_welch(encoded, lex, 2, 6)
    # The prior counts as well, so a late round may lose a trace.
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(history, history[1:])) and history[-1] > history[0]
    got = [r for r in score_documents(docs, states=2, rounds=6).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_scores_are_probabilities(spark):
    """Over all texts of one word from a small vocabulary the scores add up to less than one."""
    rows = [(i, w) for i, w in enumerate(["a", "b", "c", "a", "a b"]) if not held(i)]
    got = score_documents(frame(spark, rows), states=2, rounds=2).collect()
    single = {r["n_tokens"]: r for r in got}
    assert set(single) <= {2, 3}
    seen = {t: 10 ** r["score"] for (d, t), r in zip(sorted(rows), sorted(got, key=lambda r: r["doc_id"]))}
    assert 0 < sum(seen.values()) < 1


def test_no_rows_and_nothing_to_learn_from(spark):
    assert score_documents(frame(spark, [])).collect() == []
    only_held = [(i, "a b") for i in range(60) if held(i)]
    got = score_documents(frame(spark, only_held), states=2, rounds=1).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert all(math.isfinite(r["score"]) for r in got)
