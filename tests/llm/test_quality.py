import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspectra.llm import quality
from fleetspectra.llm.queries import QUERIES
from fleetspectra.llm.quality import Voters, features, fit_quality, latent_axes, score_quality

DATA = "/root/testdata/sf0.01"


def frame(spark, rows):
    """With further columns whose names clash with what the operator makes."""
    return spark.createDataFrame(
        [(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, LABEL string"
    )


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def prose(i):
    rng = np.random.default_rng(i)
    words = ["the", "house", "of", "water", "runs", "and", "green", "stone", "by", "night"]
    return " ".join(rng.choice(words, 40)) + "."


def junk(i):
    rng = np.random.default_rng(i)
    return " ".join(f"{w}$$$" for w in rng.choice(["BUY", "NOW", "WIN"], 30))


def planted():
    return [(i, prose(i) if i % 2 else junk(i)) for i in range(120)]


def vote(voters, vector):
    """By the definition: the nearest and all that are as near as the last of them."""
    cosine = voters.vectors @ vector
    k = min(quality.NEIGHBOURS, len(cosine))
    last = np.sort(cosine)[-k]
    pairs = [(c, y) for c, y in zip(cosine, voters.labels) if c >= last - 1e-9 and c > 1e-9]
    if not pairs:
        return voters.labels.mean()
    return sum(c * y for c, y in pairs) / sum(c for c, _ in pairs)


def test_scores_match_a_plain_vote_and_blocks_change_nothing(spark, monkeypatch):
    docs = planted() + [(900 + i, junk(2)) for i in range(40)]
    given = [(i, i % 2) for i in range(0, 120, 3)]
    voters = fit_quality(frame(spark, docs), labels(spark, given))
    x = quality.latent_vectors(features(pa.array([t for _, t in docs])), voters.axes)
    want = [vote(voters, v) for v in x]
    assert np.allclose(voters.score(x), want)
    monkeypatch.setattr(quality, "BLOCK_ROWS", 7)
    assert np.allclose(voters.score(x), want)
    got = {r["doc_id"]: r for r in score_quality(frame(spark, docs), voters).collect()}
    assert np.allclose([got[i]["score"] for i, _ in docs], want)
    assert all(got[i]["predicted"] == i % 2 for i in range(120))


def test_axes_are_those_of_all_documents_on_any_split(spark):
    texts = [t for _, t in planted()]
    x = features(pa.array(texts))
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    values = np.linalg.eigvalsh((x * weight).T @ (x * weight))[::-1]
    for parts in (1, 9):
        axes = latent_axes(frame(spark, planted()).repartition(parts), axes=5)
        along = np.linalg.norm(x @ axes, axis=0) ** 2
        assert np.allclose(along, values[:5])


def test_features_of_shapes_and_repeats():
    one, again, empty, none = features(pa.array(["Ab,\tcd  12", "x x x x", " \n", None]))
    assert again[-1] == pytest.approx(np.sqrt(3 / 4)) and one[-1] == 0
    assert not empty.any() and not none.any()
    assert (one[: quality.WORDS] ** 2).sum() == pytest.approx(1)


def test_empty_long_repeated_and_null_rows(spark):
    rows = planted() + [(500, ""), (501, None), (None, prose(1)), (500, ""), (502, prose(3) * 20_000)]
    given = [(i, i % 2) for i in range(120)] + [(None, 1), (4, None), (6, 1), (6, 0), (777, 1)]
    voters = fit_quality(frame(spark, rows), labels(spark, given))
    assert len(voters.labels) == 119 + 1  # 4 has a label too, and no row is 777
    got = score_quality(frame(spark, rows), voters).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    mean = round(float(voters.labels.mean()), 9)
    assert {r["score"] for r in got if r["doc_id"] in (500, 501)} == {mean}
    assert [r["predicted"] for r in got if r["doc_id"] == 502] == [1]


def test_no_labels_and_no_documents(spark):
    voters = fit_quality(frame(spark, planted()), labels(spark, []))
    assert {r["score"] for r in score_quality(frame(spark, planted()), voters).collect()} == {0.5}
    nothing = fit_quality(frame(spark, []), labels(spark, [(1, 1)]))
    assert score_quality(frame(spark, []), nothing).collect() == []


def test_voters_are_bounded_in_rows(spark):
    rows = [(3, prose(i)) for i in range(400)] + planted()
    given = [(i, i % 2) for i in range(120)]
    voters = fit_quality(frame(spark, rows), labels(spark, given), sample_rows=50)
    assert len(voters.labels) == 50


def test_labels_of_other_rows_are_not_learned(spark):
    learn = lambda i: F.crc32(i.cast("string")) % 4 != 2
    given = [(i, i % 2) for i in range(120)]
    other = [(i, (1 - y) if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in given]
    a, b = (fit_quality(frame(spark, planted()), labels(spark, g), learn) for g in (given, other))
    assert np.array_equal(a.labels, b.labels) and len(a.labels) < 120


def test_ties_vote_in_any_order():
    axes = np.eye(quality.FEATURES, 3)
    vectors = np.array([[1.0, 0, 0]] * 40 + [[0, 1.0, 0]] * 3)
    marks = np.array([0.0, 1.0] * 20 + [1.0] * 3)
    ask = np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 0]])
    here = Voters(axes, vectors, marks).score(ask)
    turned = Voters(axes, vectors[::-1], marks[::-1]).score(ask)
    assert np.array_equal(here, turned) and here[0] == 0.5 and here[2] == round(marks.mean(), 9)


def test_query_on_held_out_rows(spark):
    rows = QUERIES["op11_neighbour_quality"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) >= 0.97
