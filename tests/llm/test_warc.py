import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from fleetspectra.llm import warc
from fleetspectra.llm.queries import QUERIES

PAGES = [
    (3, "http://a/3", "<p>same</p>"),
    (1, "http://a/1", "<p>same</p>"),
    (2, None, None),
    (4, "http://a/4\r\nX: y", ""),
    (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (6, "u", "\n\n\r\n\r\n"),
    (7, "u", "é " * 5000),
    (None, "u", "<p>same</p>"),
    (1, "http://a/1", "<p>same</p>"),
    (8, "", "x" * 2_000_000),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(
        [(*r, "q", 1) for r in rows],
        "page_id long, url string, html string, payload string, row_id int",
    )


def test_captures_round_trip_through_archives(spark, tmp_path):
    pages = frame(spark).repartition(3)
    pages.write.parquet(f"{tmp_path}/pages")
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), f"{tmp_path}/warc")
    records = warc.read_records(spark, f"{tmp_path}/warc").cache()
    assert records.count() == 3 * len(PAGES)
    assert records.select("record_id").distinct().count() == 3 * len(PAGES)
    captures = warc.assemble(records).collect()
    assert len(captures) == len(PAGES)
    bodies = {}
    for c in captures:
        assert len(c["request"]) == len(c["metadata"]) == 1 and not c["others"]
        bodies[c["capture_id"]] = c
    for c in captures:
        r = c["response"]
        source = bodies[r["refers_to"]]["response"] if r["type"] == "revisit" else r
        payload = bytes(source["payload"])
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    want = sorted((str(p[0] or ""), (p[2] or "").encode()) for p in PAGES)
    got = []
    for c in captures:
        r = c["response"]
        source = bodies[r["refers_to"]]["response"] if r["type"] == "revisit" else r
        got.append((c["metadata"][0]["fields"]["page_id"], bytes(source["payload"])))
    assert sorted(got) == want
    # The smallest id of equal payloads is the response, and only one row of it.
    same = [c for c in captures if c["response"]["payload_bytes"] == 11]
    full = [c for c in same if c["response"]["type"] == "response"]
    assert len(same) == 4 and [c["metadata"][0]["fields"]["page_id"] for c in full] == ["1"]


def test_short_payloads_are_never_revisits(spark, tmp_path):
    warc.write_archives(frame(spark), f"{tmp_path}/w", min_revisit_bytes=12)
    kinds = warc.read_records(spark, f"{tmp_path}/w").groupBy("type").count().collect()
    assert {k["type"]: k["count"] for k in kinds} == {"request": 10, "metadata": 10, "response": 10}


def test_links_are_followed_from_either_side_and_over_records(spark):
    rows = [
        ("r1", "response", ["q1"]),
        ("q1", "request", []),
        ("m1", "metadata", ["q1"]),
        ("m2", "metadata", ["m1"]),
        ("m9", "metadata", ["nowhere"]),
        ("v2", "revisit", []),
        ("c2", "conversion", ["v2", "v2"]),
        ("m9b", "metadata", None),
    ]
    records = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "m9", "m9b", "v2"}
    assert got["r1"]["response"]["record_id"] == "r1"
    assert sorted(m["record_id"] for m in got["r1"]["metadata"]) == ["m1", "m2"]
    assert [m["record_id"] for m in got["r1"]["request"]] == ["q1"]
    assert got["m9"]["response"] is None and len(got["m9"]["metadata"]) == 1
    assert [m["record_id"] for m in got["v2"]["others"]] == ["c2"]


def test_no_pages(spark, tmp_path):
    warc.write_archives(frame(spark, []), f"{tmp_path}/w")
    assert warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).collect() == []


def test_records_cut_anywhere(spark):
    stream = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    stream += b"WARC/1.0\nWARC-Type: response\nContent-Length: 0\n\n\n\nWARC/1.0\r\nContent-Length: 1\r\n\r\nz"
    cutter = warc._Cutter()
    found = [r for line in stream.split(b"\n") for r in cutter.feed(line)]
    assert [b for _, b in found] == [b"\r\n\r\n", b"", b"z"]


@pytest.mark.parametrize("text", ["", "a", "é" * 50])
def test_base32_of_sha1(spark, text):
    got = spark.range(1).select(warc.sha1_base32(F.lit(text).cast("binary"))).first()[0]
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_query_with_missing_values(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["op2_warc_transactions"](spark, str(tmp_path)).collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] == 11)
    assert [g[0] for g in got] == [0, 1, 1, 3]
    assert sorted(g[1] for g in got) == ["response", "revisit", "revisit", "revisit"]
    assert all(g[2] == 1 for g in got if g[1] == "revisit")


def test_plain_archives_in_several_splits(spark, tmp_path):
    """Two plain files and a gzipped one; the plain ones are cut inside records, and at false marks."""
    mark = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    want = {}
    for f in range(3):
        stream = []
        for i in range(120):
            block = (mark * 20 + b"%d %d\n" % (f, i)) if i % 3 else b"\r\n" * i
            want[f"<{f}-{i}>"] = block
            head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{f}-{i}>\r\nContent-Length: {len(block)}"
            stream.append(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        (tmp_path / "w").mkdir(exist_ok=True)
        data = b"".join(stream)
        name = tmp_path / "w" / f"{f}.warc"
        name.write_bytes(data) if f else (tmp_path / "w" / "0.warc.gz").write_bytes(gzip.compress(data))
    settings = {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert spark.read.text(f"{tmp_path}/w").rdd.getNumPartitions() > 20
        rows = warc.read_records(spark, f"{tmp_path}/w").select("record_id", "payload").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == len(want) and {r[0]: bytes(r[1]) for r in rows} == want
