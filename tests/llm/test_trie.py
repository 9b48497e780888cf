import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from fleetspectra.llm.trie import prefix_trie, rebuilt

NAMES = (
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
)


def said(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, said(role, text), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        host = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(host, [])[:h] + own[c][h:]
    return out


def brute(rows):
    paths = rebuild(rows)
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], digest))
    return sorted(out, key=repr)


def frame(spark, rows):
    """With further columns whose names clash with what the operator makes."""
    return spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows],
        "conv_id long, turn long, role string, text string, shard int, KEYS string, n int",
    )


def found(spark, rows, parts=4, **sizes):
    nodes = prefix_trie(*rebuilt(frame(spark, rows).repartition(parts)), **sizes).collect()
    assert len({r["id"] for r in nodes}) == len(nodes)
    return sorted((tuple(r[n] for n in NAMES) for r in nodes), key=repr)


def chat(conv, length, text):
    return [(conv, t, "user" if t % 2 == 0 else "assistant", text(t)) for t in range(length)]


def mixed():
    rows = []
    for c in range(-7, 60):
        # Shared beginnings of different length, then turns of their own.
        rows += chat(c, 2 + abs(c) * 7 % 11, lambda t: f"É {t}" if t < 3 + c % 4 else f"{c} {t}")
    return rows


@pytest.mark.parametrize("slab, shard", [(64, 512), (3, 8), (1, 5), (2, 1)])
def test_nodes_match_brute_force_however_shards_and_slabs_are_cut(spark, slab, shard):
    rows = mixed()
    assert found(spark, rows, slab=slab, shard=shard) == brute(rows)


def test_nulls_ties_repeated_rows_and_turnless_conversations(spark):
    rows = mixed()[:60]
    rows += [(None, 1, "user", "lost"), (200, None, "user", "first"), (200, 0, None, None)]
    rows += [(200, 0, "user", "tie b"), (200, 0, "user", "tie a"), (200, 0, "user", "tie a")]
    rows += [(201, 5, "user", ""), (202, None, None, None), (203, 1, "user", "y" * 300_000)]
    # Their own turns all lie before the turns they keep, and there is no host.
    rows += [(c, 0, "user", "only") for c in range(1001, 1005)]
    assert any(not turns for turns in rebuild(rows).values())
    assert found(spark, rows, slab=2, shard=16) == brute(rows)


def test_copies_fill_many_shards_and_one_end_list(spark):
    rows = [r for c in range(300) for r in chat(c, 9, lambda t: f"same {t}")]
    got = found(spark, rows, slab=4, shard=32)
    assert got == brute(rows) and len(got) == 10


def test_one_long_conversation_is_walked_in_slabs(spark):
    rows = chat(7, 700, lambda t: f"w{t % 5}") + chat(8, 500, lambda t: f"w{t % 5}") + mixed()[:30]
    assert found(spark, rows, slab=32, shard=4) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [], parts=1) == []
    assert found(spark, [(None, 1, "user", "lost")], parts=1) == []
