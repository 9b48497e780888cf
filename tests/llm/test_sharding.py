import random
import zlib
from collections import Counter

import pytest

from fleetspectra.llm import sharding
from fleetspectra.llm.sharding import SlotMap, balanced, grown, rebalanced, shard_documents


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "s") for r in rows], "doc_id long, text string, SLOT int, shard string")


def corpus():
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(1200)]
    return rows + [(None, "a"), (None, "a"), (None, None), (3, "other"), (3, "other"), (2000, "é" * 3000)]


def test_bytes_are_near_equal_and_places_gapless(spark):
    rows = corpus()
    df, slot_map = shard_documents(frame(spark, rows), shards=7, slots=512)
    got = df.collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    loads, places = Counter(), {}
    for r in got:
        assert slot_map.shard_of[r["virtual_slot"]] == r["shard"]
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_record_keeps_its_slot_in_any_corpus(spark):
    whole = {r["doc_id"]: r["virtual_slot"] for r in shard_documents(frame(spark, corpus()))[0].collect()}
    part = shard_documents(frame(spark, corpus()[:50]))[0].collect()
    assert all(whole[r["doc_id"]] == r["virtual_slot"] for r in part if r["doc_id"] != 3)


def test_growth_moves_slots_only_into_new_shards():
    rng = random.Random(1)
    loads = [rng.randint(0, 100) for _ in range(1000)]
    old = balanced(loads, 10)
    new = grown(old, loads, 12)
    assert new.version == 2
    moved = [b for a, b in zip(old.shard_of, new.shard_of) if a != b]
    assert set(moved) == {10, 11}
    totals = Counter()
    for load, shard in zip(loads, new.shard_of):
        totals[shard] += load
    assert max(totals.values()) < 1.1 * sum(loads) / 12


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_rebalancing_edits_few_slots(tolerance):
    rng = random.Random(2)
    loads = [rng.randint(1, 100) for _ in range(1000)]
    old = balanced(loads, 10)
    heavier = [3 * x if s == 4 else x for x, s in zip(loads, old.shard_of)]
    new = rebalanced(old, heavier, tolerance)
    moved = sum(a != b for a, b in zip(old.shard_of, new.shard_of))
    totals = Counter()
    for load, shard in zip(heavier, new.shard_of):
        totals[shard] += load
    assert 0 < moved < 100 and max(totals.values()) < 1.06 * sum(heavier) / 10
    assert rebalanced(new, heavier, 0.06).shard_of == new.shard_of


def test_versions_are_stored_side_by_side(spark, tmp_path):
    one = balanced([5, 1, 2, 7], 2)
    two = grown(one, [5, 1, 2, 7], 3)
    for m in (one, two):
        sharding.save_version(m, spark, f"{tmp_path}/maps")
    assert sharding.load_version(spark, f"{tmp_path}/maps") == two
    assert sharding.load_version(spark, f"{tmp_path}/maps", 1) == one
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_version(one, spark, f"{tmp_path}/maps")
    assert sharding.load_version(spark, f"{tmp_path}/maps", 1) == one
    assert isinstance(one, SlotMap)


def test_empty_table(spark):
    df, slot_map = shard_documents(frame(spark, []), shards=3, slots=8)
    assert df.collect() == [] and len(slot_map.shard_of) == 8


def test_rows_repeated_beyond_a_slot_are_spread(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(7000, "same text " * 20)] * 1500
    rows += [(None, None)] * 700
    df, slot_map = shard_documents(frame(spark, rows).repartition(5), shards=10, slots=1024)
    got = df.collect()
    loads, places = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        assert slot_map.shard_of[r["virtual_slot"]] == r["shard"]
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    assert max(loads.values()) < 1.05 * sum(loads.values()) / 10
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_stored_map_is_read_and_edited(spark, tmp_path):
    where = f"{tmp_path}/map"
    docs = frame(spark, corpus())
    first, one = shard_documents(docs, shards=4, slots=256, map_path=where)
    again, same = shard_documents(docs, shards=4, slots=256, map_path=where)
    assert same == one and sorted(first.drop("row_id").collect(), key=str) == sorted(again.drop("row_id").collect(), key=str)
    _, two = shard_documents(docs, shards=5, slots=256, map_path=where)
    assert (two.version, two.shards) == (2, 5) and sharding.load_version(spark, where) == two
    assert {b for a, b in zip(one.shard_of, two.shard_of) if a != b} == {4}
    with pytest.raises(ValueError):
        shard_documents(docs, shards=3, slots=256, map_path=where)
