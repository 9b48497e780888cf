import random

import numpy as np
from pyspark.sql import functions as F

from fleetspectra.llm import toxicity
from fleetspectra.llm.toxicity import Model, _fit, fit_toxicity, score_toxicity, severity_udf


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rng.choice([1, 2, 5, 15])):
                words.insert(rng.randint(0, len(words)), rng.choice(["Zork,", "blarg", "(frob)"]))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, grade string, ID int")
    return docs, spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, toxic int, TEXT int")


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, [*labels, (None, 1), (5, None), (7, 0), (7, 1)][:-2])
    model = fit_toxicity(docs, marks)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert {i for i, r in got.items() if r["rejected"]} == {i for i in got if i % 9 == 0}
    assert np.all(np.diff(model.thresholds) > 0) and len(model.thresholds) == 3
    # More tied words, higher expected severity.
    hits = {i: sum(t.count(w) for w in ("Zork", "blarg", "frob")) for i, t in rows}
    few = [got[i]["expected_severity"] for i, h in hits.items() if h == 1]
    many = [got[i]["expected_severity"] for i, h in hits.items() if h == 15]
    assert max(few) < min(many) and max(many) <= 3


def test_given_grades_are_used(spark):
    rows, labels = corpus()
    text = dict(rows)
    graded = [(i, min(2, t * sum(text[i].count(w) for w in ("Zork", "blarg", "frob")))) for i, t in labels]
    docs, marks = frames(spark, rows, graded)
    assert len(fit_toxicity(docs, marks).thresholds) == 2


def test_fit_has_a_flat_gradient_at_its_end():
    """Compared with numerical derivatives of the mean log loss."""
    rng = np.random.default_rng(3)
    n, k = 300, 3
    x_row = np.repeat(np.arange(n), 2)
    x_word = rng.integers(0, k, 2 * n)
    x_value = rng.random(2 * n)
    score = np.bincount(x_row, np.array([2.0, -1.0, 0.5])[x_word] * x_value, minlength=n)
    grades = np.digitize(score + rng.logistic(size=n), [0.0, 1.5])
    weights, theta = _fit(x_row, x_word, x_value, grades, k, 2)

    def loss(w, t):
        eta = np.bincount(x_row, w[x_word] * x_value, minlength=n)
        above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(t - eta[:, None])), np.zeros((n, 1))])
        at = np.arange(n)
        return -np.log(above[at, grades] - above[at, grades + 1]).mean()

    for i in range(k + 2):
        step = np.zeros(k + 2)
        step[i] = 1e-4
        slope = loss(weights + step[:k], theta + step[k:]) - loss(weights - step[:k], theta - step[k:])
        assert abs(slope / 2e-4) < 5e-3


def test_missing_values_and_empty_tables(spark):
    rows, labels = corpus(200)
    docs, marks = frames(spark, [*rows, (None, None), (1000, ""), (1000, "zork " * 30_000)], labels)
    model = fit_toxicity(docs, marks)
    got = score_toxicity(docs.filter("doc_id is null or doc_id = 1000"), model).collect()
    assert sorted(r["rejected"] for r in got) == [False, False, True]
    assert score_toxicity(docs.limit(0), model).collect() == []
    for d, m in ((docs.limit(0), marks), (docs, marks.limit(0)), (docs, marks.filter("toxic = 0"))):
        none = fit_toxicity(d, m)
        assert not any(r["rejected"] for r in score_toxicity(docs, none).collect())


def test_texts_are_read_whole_and_in_pieces(spark, monkeypatch):
    model = Model(np.array([toxicity.xxhash.xxh64_intdigest(b"zork") >> 1]), np.array([3.0]), np.array([1.0, 2.0]))
    texts = ["zork", "a " * 50_000 + "ZORK!", None, "zorks", "zork zork"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    rows = df.select("i", severity_udf(model)(F.col("text")).alias("s")).orderBy("i").collect()
    eta = [3 * np.log1p(n) for n in (1, 1, 0, 0, 2)]
    want = [1 / (1 + np.exp(1 - e)) for e in eta]
    assert np.allclose([r["s"]["p_toxic"] for r in rows], want)


def test_a_repeated_labelled_id_gives_one_row_of_the_sample(spark, monkeypatch):
    rows, labels = corpus(300)
    docs, marks = frames(spark, rows + [(1, "w1 w2")] * 900, labels)
    sizes = {}
    write = toxicity.materialize

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(toxicity, "materialize", counted)
    fit_toxicity(docs, marks, sample_rows=100)
    assert sizes["sample"] == sizes["sampled"] == 100
