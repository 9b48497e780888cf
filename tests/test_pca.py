"""Principal coordinates with and without a matrix of bins by bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspectra.operators import profile as pr
from test_cluster import planted


def by_svd(x, n=2):
    centered = x - x.mean(axis=0)
    u, s, v = np.linalg.svd(centered, full_matrices=False)
    signs = np.where(v.max(axis=1) >= -v.min(axis=1), 1.0, -1.0)[:n]
    return u[:, :n] * s[:n] * signs, s[:n] ** 2 / (s**2).sum()


def check(coordinates, shares, want, want_shares):
    got = {r["vin"]: (r["pc1"], r["pc2"]) for r in coordinates.collect()}
    assert len(got) == len(want)
    assert np.allclose([got[f"V{i:05d}"] for i in range(len(want))], want, atol=1e-6)
    assert np.allclose(shares, want_shares)


def test_both_ways_give_the_coordinates_of_the_definition(spark, monkeypatch):
    probs = np.diff(planted(90, 0.2), prepend=0.0, axis=1)
    rows = [(f"V{i:05d}", [float(v) for v in p]) for i, p in enumerate(probs)]
    dists = spark.createDataFrame(rows, "vin string, probs array<double>").repartition(4)
    want = by_svd(probs)
    check(*pr.pca_coordinates(dists), *want)
    monkeypatch.setattr(pr, "DENSE_BINS", 10)
    check(*pr.pca_coordinates(dists), *want)


def test_two_hundred_thousand_places(spark):
    rng = np.random.default_rng(4)
    n, places = 120, 200_000
    x = np.zeros((n, places), np.float64)
    for i in range(n):
        # Three kinds of vehicles, each at home in a region of its own.
        at = rng.choice(places // 4, 1700, replace=False) + (i % 3) * places // 4
        x[i, at] = 1.0
        x[i, (i % 3) * 7 : (i % 3) * 7 + 5] = 60.0 + i % 5
    x /= x.sum(axis=1, keepdims=True)
    i, j = np.nonzero(x)
    frame = spark.createDataFrame(
        __import__("pandas").DataFrame({"vin": [f"V{a:05d}" for a in i], "place": j, "p": x[i, j]})
    )
    assert frame.select(F.count_distinct("place")).first()[0] > 100_000
    check(*pr.pca_sparse(frame.repartition(6)), *by_svd(x))


def test_fleets_without_spread_or_vehicles(spark):
    same = spark.createDataFrame([(f"V{i}", b, 0.5) for i in range(4) for b in (0, 1)], "vin string, place int, p double")
    coordinates, shares = pr.pca_sparse(same)
    assert all(abs(r["pc1"]) < 1e-9 and abs(r["pc2"]) < 1e-9 for r in coordinates.collect())
    with pytest.raises(ValueError):
        pr.pca_sparse(same.where("false"))
