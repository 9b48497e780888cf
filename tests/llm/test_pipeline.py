import random

import pytest

import corpus_pipeline as cp
from __spark_entry__ import oracle_sql, queries

ITEM = "Which of the seven rivers named above runs through the greatest number of countries before it meets the sea"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("l", "m", "st", "rn")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows, labels = [], []
    for i in range(200):
        text = prose(rng.randint(60, 200))
        if i % 10 == 0:
            text += " grumpf snarl grumpf"
        if i % 2 == 0:
            labels.append((i, 1, int(i % 10 == 0)))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    clean = rows[1][1]
    rows += [
        (300, clean, "en", "s1", 1),
        (301, clean.upper(), "en", "s1", 1),
        (302, prose(50) + " " + ITEM + " " + prose(50), "en", "s2", 1),
        (None, None, None, None, None),
        (303, "", "en", None, 0),
        (304, prose(30), "en", "s0", 1),
        (304, prose(30), "en", "s0", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_acts_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        assert i == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    toxic = {i for i in range(200) if i % 10 == 0}
    first = set(range(200)) - toxic | {300, 301, 302, 303, 304, None}
    assert set(kept["toxicity"]) == first and len(kept["toxicity"]) == 187
    # The null text and the empty text share fingerprint zero; the null id comes last.
    assert set(kept["simhash near-dedup"]) == first - {300, 301, None}
    assert set(kept["decontamination"]) == first - {300, 301, None, 302}
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert max(map(kept["mixing"].count, kept["mixing"])) <= 4  # 304 stands for two rows
    assert sorted(kept["sharding"], key=str) == sorted(kept["mixing"], key=str)


def test_run_gives_one_place_per_row(spark, folder):
    rows = cp.run(spark, folder).collect()
    places = {(r["shard"], r["slot"]) for r in rows}
    assert len(places) == len(rows) > 100


def test_all_is_registered():
    names = list(queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(oracle_sql()) <= set(names)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash near-dedup", "decontamination", "mixing", "sharding"]
