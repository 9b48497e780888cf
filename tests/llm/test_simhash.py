import random

import numpy as np
import pytest
import xxhash

from fleetspectra.llm import simhash
from fleetspectra.llm.components import components
from fleetspectra.llm.simhash import fingerprint, links, simhash_groups


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n_nodes, edges):
    up = list(range(n_nodes))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n_nodes)]


def test_fingerprint_by_bit():
    rng = random.Random(1)
    texts = [None, "", " ", "One", "one TWO", "a b c", "É b c d"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 64)
    assert fingerprint(text) == whole == slow_fingerprint(text)


def planted(rng, groups, size, bits):
    out = set()
    for _ in range(groups):
        center = rng.getrandbits(64)
        for _ in range(size):
            x = center
            for b in rng.sample(range(64), rng.randint(0, bits)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("pair_limit", [512, 2])
@pytest.mark.parametrize("max_bits,blocks", [(3, 6), (2, 3), (1, 2)])
def test_links_connect_what_brute_force_connects(spark, pair_limit, max_bits, blocks):
    rng = random.Random(5)
    values = planted(rng, 6, 12, 4) + [rng.getrandbits(64) for _ in range(30)]
    values = sorted(set(values))
    near = [
        (i, j)
        for i in range(len(values))
        for j in range(i)
        if (values[i] ^ values[j]).bit_count() <= max_bits
    ]
    signed = [int(v) for v in np.array(values, np.uint64).view(np.int64)]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    at = {v: i for i, v in enumerate(signed)}
    edges = [(at[r["a"]], at[r["b"]]) for r in links(prints, max_bits, blocks, pair_limit).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= max_bits for a, b in edges)
    assert roots(len(values), edges) == roots(len(values), near)


def test_groups_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base),
        (3, base.upper()),
        (9, base.replace("w7 ", "v7 ")),
        (1, None),
        (2, ""),
        (4, "something else"),
        (None, "something  else"),
        (4, "something else"),
        (None, "alone here"),
    ]
    df = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, fingerprint int, Row_Id string"
    ).coalesce(1)
    got = simhash_groups(df).orderBy("row_id").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    prints = [slow_fingerprint(t) for _, t in rows]
    assert [r["fingerprint"] for r in got] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in got] == [3, 3, 3, 1, 1, 4, 4, 4, None]
    assert [r["keeper"] for r in got] == [False, True, False, True, False, True, False, False, True]
    assert simhash_groups(df.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(200, 300)]
    hub = [(7, i) for i in range(1000, 1300)]
    edges = spark.createDataFrame([*path, *hub, (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 200 for i in range(201, 301))
    assert all(got[i] == 7 for i in range(1000, 1300)) and len(got) == 400
    assert components(edges.limit(0)).collect() == []
