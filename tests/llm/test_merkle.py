import hashlib

import pytest
from pyspark.sql import functions as F

from fleetspectra.llm import merkle
from fleetspectra.llm.merkle import build_manifest, lower_ascii, proofs, verify
from fleetspectra.llm.ordering import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, KEY string, hash int"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    doc, _, lang, source, n = row
    return H("".join(field(v) for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Root and, per node, its sides on every level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // 16 * 16
            paths[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + 16])))
        nodes = [H("".join(nodes[r : r + 16])) for r in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def brute(rows, altered):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        ranked = sorted(
            by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))
        )
        trees[s] = (ranked, *climb([leaf_of(r, r[1]) for r in ranked]))
    root, above = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, above):
        ranked, subroot, paths = trees[s]
        for r, path in zip(ranked, paths):
            whole = path + top
            node = leaf_of(r, altered(r))
            for left, right in whole:
                node = H(left + node + right)
            proof = H("".join(a + b for a, b in whole))
            out.append((r[0], leaf_of(r, r[1]), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA)


def found(docs, altered=None):
    rows = verify(proofs(build_manifest(docs, altered))).collect()
    return sorted((tuple(r[n] for n in NAMES) for r in rows), key=repr)


def even_ids():
    return F.when(F.col("doc_id") % 2 == 0, lower_ascii(F.col("text")))


def even(row):
    doc, text = row[:2]
    if doc is None or doc % 2 or text is None:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_small_trees_nulls_and_repeated_rows(spark):
    rows = [(i, f"Text {i} É", "en", f"s{i % 3}", i) for i in range(50)]
    rows += [(100, "lone", None, "é", None), (None, None, None, None, None), (7, "", "de", None, 0)]
    rows += [(3, "Text again", "en", "s0", 3)] * 2 + [(3, "x" * 200_000, "en", "s0", 1)]
    got = found(frame(spark, rows).repartition(5), even_ids())
    assert got == brute(rows, even)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4097])
def test_heights_around_every_level(spark, n):
    rows = [(i, f"A{i}", "en", "only", i) for i in range(n)]
    assert found(frame(spark, rows), even_ids()) == brute(rows, even)


def test_many_sources_make_a_top_tree_of_three_levels(spark):
    rows = [(i, f"A{i}", "en", f"s{i % 300}", i) for i in range(700)]
    assert found(frame(spark, rows)) == brute(rows, lambda r: r[1])


def test_equal_rows_are_cut_into_many_chunks(spark):
    rows = [(5, "same", "en", "s", 4)] * 3000
    got = found(frame(spark, rows).repartition(6))
    assert got == brute(rows, lambda r: r[1]) and len(got) == 3000


def test_proofs_of_stated_sources_touch_no_other(spark):
    rows = [(i, f"A{i}", "en", f"s{i % 4}", i) for i in range(400)] + [(900, "b", "en", None, 1)]
    manifest = build_manifest(frame(spark, rows))
    wanted = spark.createDataFrame([("s1",), (None,)], "source string")
    some = verify(proofs(manifest, wanted)).collect()
    assert {r["doc_id"] for r in some} == {i for i in range(400) if i % 4 == 1} | {900}
    assert all(r["verified"] and r["root"] == manifest.root for r in some)


def test_only_every_second_level_is_stored(spark):
    rows = [(i, f"A{i}", "en", "s", i) for i in range(5000)]
    manifest = build_manifest(frame(spark, rows))
    stored = [level.select(F.sum(F.size("nodes"))).first()[0] for level in manifest.sources.levels]
    assert stored == [5000, 20] and merkle.STEP == 2


def test_empty_table(spark):
    manifest = build_manifest(frame(spark, []))
    assert manifest.root is None
    assert verify(proofs(manifest)).collect() == []


def test_positions_of_a_hot_key(spark):
    rows = [("hot", i // 3) for i in range(900)] + [(f"k{i % 5}", i) for i in range(100)] + [(None, 1)]
    df = spark.createDataFrame(rows, "key string, x int").repartition(7)
    got = numbered(df, "key", ["x"], "t").collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r["pos"], r["x"]) for r in got if r["key"] == key)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted(x for k, x in rows if k == key)
        assert {r["n"] for r in got if r["key"] == key} == {len(mine)}
