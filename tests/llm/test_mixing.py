import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetspectra.llm import mixing
from fleetspectra.llm.mixing import hypergeometric, mix, mixed_documents, split_tree, targets


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows],
        "doc_id long, text string, source string, size int, Row_ID string",
    )


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None
        out.append((i, "w " * rng.randint(0, 60), source))
    out += [(1000, None, "s1"), (None, "a b c", "s2"), (5, "w w", "s5"), (5, "w w", "s5"), (1001, "", "empty")]
    return out


def water(sizes, weights, share, repeats):
    goal = share * sum(s for s, _ in sizes)
    out, open_ = {}, dict(enumerate(s for s, _ in sizes))
    left = goal
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i, s in open_.items() if left * weights[i % len(weights)] / total > repeats * s]
        if not over:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        # Cap the ones above together, then share the excess again.
        for i in over:
            out[i] = repeats * open_.pop(i)
        left = goal - sum(out.values())
    return out


@pytest.mark.parametrize("share,repeats", [(1.5, 2), (0.5, 1), (3.0, 2), (1.0, 1)])
def test_targets_reshare_what_is_above_the_caps(spark, share, repeats):
    sizes = [(100, "a"), (5, "b"), (900, "c"), (0, "d"), (40, "e"), (70, None)]
    df = spark.createDataFrame(sizes, "source_size long, source string")
    rows = targets(df, (3.0, 1.0, 2.0), share, repeats).orderBy("source_no").collect()
    want = water(sizes, (3.0, 1.0, 2.0), share, repeats)
    assert [r["source"] for r in rows] == ["a", "b", "c", "d", "e", None]
    assert all(math.isclose(r["target"], want[r["source_no"]], abs_tol=1e-6) for r in rows)


def test_quantiles_of_the_hypergeometric(spark):
    cases = [(5, 7, 4), (1, 0, 1), (0, 9, 3), (300, 500, 200), (40, 2, 41), (6, 6, 0)]
    us = [0.001, 0.2, 0.5, 0.77, 0.999]
    rows = [(g, b, d, u) for g, b, d in cases for u in us]
    df = spark.createDataFrame(rows, "g long, b long, d long, u double")
    k = hypergeometric(*[F.col(c) for c in "gbdu"])
    for r in df.select("*", k.alias("k")).collect():
        low, high = max(0, r["d"] - r["b"]), min(r["g"], r["d"])
        total, at = 0.0, low
        for x in range(low, high + 1):
            total += math.comb(r["g"], x) * math.comb(r["b"], r["d"] - x) / math.comb(r["g"] + r["b"], r["d"])
            at = x
            if total >= r["u"]:
                break
        assert r["k"] == at


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_tree_splits_quotas_exactly(spark, shards):
    quotas = [(0, 100), (1, 3), (2, 0), (3, 4000), (4, 57)]
    df = spark.createDataFrame(quotas, "source_no int, quota long")
    rows = split_tree(df, shards).collect()
    assert all(r["blocks"] >= 0 for r in rows)
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        per_source[r["source_no"]] += r["blocks"]
        per_shard[r["shard"]] += r["blocks"]
    assert dict(per_source) == dict(quotas)
    assert len(per_shard) == shards and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_tree_draws_have_the_right_mean(spark):
    df = spark.createDataFrame([(0, 30), (1, 70)], "source_no int, quota long")
    firsts = [
        split_tree(df, 2, seed).filter("shard = 0 and source_no = 0").first()["blocks"] for seed in range(25)
    ]
    # Mean 15, standard deviation 2.3 each.
    assert abs(sum(firsts) / 25 - 15) < 2 and len(set(firsts)) > 3


@pytest.mark.parametrize("block_words", [60, 65_536])
def test_mix_takes_near_its_targets(spark, block_words):
    rows = corpus()
    got = mix(frame(spark, rows), block_words=block_words, shards=4).collect()
    assert len(got) == len(rows)
    taken, goal, size = Counter(), {}, Counter()
    for r in sorted(got, key=lambda r: r["row_id"]):
        words = r["size"]
        assert len(r["draws"]) <= 2
        key = (r["source_size"], r["target"])
        taken[key] += words * len(r["draws"])
        size[key] += words
        goal[key] = r["target"]
    for key, target in goal.items():
        assert abs(taken[key] - target) <= 60 and target <= 2 * key[0] + 1e-9
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-3
    again = mix(frame(spark, rows), block_words=block_words, shards=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_follow_the_draws(spark, tmp_path):
    frame(spark, corpus()).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    mixed = mix(docs, block_words=100, shards=4)
    out = mixed_documents(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += len(r["draws"])
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    shards = Counter(d["shard"] for r in mixed.collect() for d in r["draws"])
    assert set(shards) == {0, 1, 2, 3}


def test_empty_and_blank_tables(spark):
    assert mix(frame(spark, [])).collect() == []
    blank = mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], len(r["draws"])) for r in blank] == [(0, 0.0, 1)] * 2


def test_many_small_sources_are_shuffled_instead_of_broadcast(spark, monkeypatch):
    rows = [(i, "a b c d", f"s{i % 40}") for i in range(400)]
    want = sorted(map(str, mix(frame(spark, rows), block_words=8, shards=3).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(mixing, "BLOCK_CHUNK", 2)
    assert sorted(map(str, mix(frame(spark, rows), block_words=8, shards=3).collect())) == want


def test_native_plan(spark):
    plan = mix(frame(spark, corpus(50)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_shard_has_the_shares_of_the_mix(spark):
    """With the production sizes, also where a source has few words: a draw of documents, not of whole sources."""
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(20, 120), "hot" if i % 3 == 0 else f"s{i % 8}") for i in range(6000)]
    got = mix(frame(spark, rows), shards=8).collect()
    source = {i: s for i, _, s in rows}
    words, whole, weight = Counter(), Counter(), Counter()
    for r in got:
        for d in r["draws"]:
            words[d["shard"], source[r["doc_id"]]] += r["size"]
            whole[d["shard"]] += r["size"]
            weight[source[r["doc_id"]]] += r["size"]
    total = sum(whole.values())
    assert len(whole) == 8 and max(whole.values()) < 1.25 * total / 8
    for s, taken in weight.items():
        drawn = taken / 70
        for shard in whole:
            # A fair draw of documents of about 70 words, five standard deviations and those of block sizes.
            assert abs(words[shard, s] / 70 - drawn / 8) < 6 * 1.5 * math.sqrt(drawn / 8)


def filled(docs, room):
    taken = []
    for _, row, size in docs:
        if size <= room:
            taken.append(row)
            room -= size
    left = [(size, key, row) for key, row, size in docs if row not in taken]
    if left and min(left)[0] - room < room:
        taken.append(min(left)[2])
    return set(taken)


def test_border_block_is_filled_in_order(spark):
    """Lists below, at and above a stretch, and thousands of texts of one word."""
    rng = random.Random(8)
    cases = [([(0, 9, 5)], 2.0), ([(0, 9, 5)], 3.0), ([(0, 9, 5)], 5.0)]
    for n in (1, 255, 256, 257, 700):
        docs = [(k, k * 7, rng.randint(1, 90)) for k in range(n)]
        cases.append((docs, rng.random() * sum(d[2] for d in docs)))
    cases.append(([(k, k, 1) for k in range(20_000)], 12_345.6))
    df = spark.createDataFrame(
        cases, "docs array<struct<order_key:bigint,row_id:bigint,size:bigint>>, room double"
    )
    rows = df.select("docs", "room", mixing._filled(F.col("docs"), F.col("room")).alias("taken")).collect()
    for r in rows:
        assert set(r["taken"]) == filled([tuple(d) for d in r["docs"]], r["room"])
        assert len(set(r["taken"])) == len(r["taken"])


@pytest.mark.parametrize("hot", [5, None])
def test_rows_of_a_repeated_id_fall_into_blocks_of_their_own(spark, tmp_path, hot):
    rows = [(hot, "w " * (i % 9 + 1), "a") for i in range(3000)]
    rows += [(100 + i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(3000)]
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/docs")
    got = mix(spark.read.parquet(f"{tmp_path}/docs"), shards=4).collect()
    words = Counter()
    for r in got:
        for d in r["draws"]:
            if r["doc_id"] == hot:
                words[d["shard"]] += r["size"]
    assert len(words) == 4 and max(words.values()) < 1.3 * min(words.values())
    # Another layout of the same rows gives the same mix.
    frame(spark, rows).repartition(2).write.parquet(f"{tmp_path}/again")
    again = mix(spark.read.parquet(f"{tmp_path}/again"), shards=4).collect()
    taken = [sorted((str(r["doc_id"]), r["size"], len(r["draws"])) for r in x) for x in (got, again)]
    assert taken[0] == taken[1]
