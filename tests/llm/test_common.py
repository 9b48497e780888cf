import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspectra.llm import common
from fleetspectra.llm.common import Words, pieces, prefix_sums, take


def texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = ["a", "bb", "Ccc", "", "é ", "\t", "\x0b\x0c", "\x1c", "\u00a0", "ÉZ", "\r\n"]
    return [" ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(n)] + [None, "", " "]


def words_of(w, k):
    return [w.vocabulary[c] for c in w.codes[w.starts[k] : w.starts[k + 1]]]


@pytest.mark.parametrize("piece_bytes", [1, 40, 300, 10**6])
@pytest.mark.parametrize("seed", range(5))
def test_words_of_pieces_are_those_of_each_text(monkeypatch, piece_bytes, seed):
    monkeypatch.setattr(common, "PIECE_BYTES", piece_bytes)
    rows = texts(60, seed)
    batch = pa.record_batch({"text": pa.array(rows), "i": pa.array(range(len(rows)))})
    seen = []
    for part in pieces([batch.slice(0, 20), batch.slice(20, 0), batch.slice(20)]):
        w = Words(part.column("text"))
        for k, i in enumerate(part.column("i").to_pylist()):
            assert words_of(w, k) == (rows[i] or "").encode().lower().split()
            seen.append(i)
    assert seen == list(range(len(rows)))


def test_words_of_slices():
    rows = texts(80, 9)
    whole = pa.array(rows)
    for a in range(0, 80, 7):
        for n in (0, 1, 2, 11):
            w = Words(whole.slice(a, n), lower=False)
            assert [words_of(w, k) for k in range(len(w.counts))] == [
                (t or "").encode().split() for t in rows[a : a + n]
            ]


def test_take_prefers_exact_names(spark):
    df = spark.createDataFrame([(1, "x", "y")], "n int, TEXT string, Text string")
    assert take(df, text="Text").first()["text"] == "y"
    assert take(df, "text").first()["text"] == "x"
    twice = df.select("n", F.col("n").alias("n"))
    assert take(twice, "n").columns == ["n"]
    with pytest.raises(ValueError, match="missing"):
        take(df, "missing")


def test_prefix_sums_over_pieces(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, v int").withColumn("c", F.floor(F.col("i") / 16))
    got = prefix_sums(df, ["k"], "c", [F.col("i")], before="v").collect()
    assert len(got) == 300
    for r in got:
        assert r["before"] == sum(v for k, i, v in rows if k == r["k"] and i < r["i"])
