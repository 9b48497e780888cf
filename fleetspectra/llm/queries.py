"""The corpus queries, each over its whole table, with SQL counterparts where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.llm import (
    chat,
    decontaminate,
    exact_dedup,
    hmm,
    merkle,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    toxicity,
    trie,
    warc,
)
from fleetspectra.sources.tables import materialize, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_template_decontamination(spark, folder):
    found = decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.drop("row_id")


@query
def op2_warc_transactions(spark, folder):
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), archives)
    records = materialize(warc.read_records(spark, archives).drop("payload"), "records")
    captures = warc.assemble(records).select(
        F.try_element_at(F.col("metadata")[0]["fields"], F.lit("page_id"))
        .try_cast("long")
        .alias("page_id"),
        F.col("response.record_id").alias("record_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.regexp_replace("response.payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("first"),
    )
    captures = materialize(captures, "captures")
    firsts = captures.filter("record_type = 'response'").select(
        F.col("record_id").alias("r"), F.col("page_id").alias("refers_to")
    )
    return captures.join(firsts, F.col("first") == F.col("r"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op3_grace_dedup(spark, folder):
    return exact_dedup.grace_dedup(table(spark, folder, "documents"))


@query
def op4_budgeted_windows(spark, folder):
    mark = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(
        f"""SELECT * FROM VALUES (-1L, 0L, 'user', '{mark}'), (-1L, 1L, 'assistant', '{mark}')
            AS t(conv_id, turn, role, text)"""
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.chat_windows(rows.unionByName(extra)))


@query
def op5_hypergeometric_mix(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).cast("long").alias("taken"),
        F.col("draws.shard").alias("output_shards"),
    )


@query
def op6_hmm_score(spark, folder):
    return hmm.score_documents(table(spark, folder, "documents"))


@query
def op7_simhash_blocks(spark, folder):
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


@query
def op8_virtual_slots(spark, folder):
    sharded, _ = sharding.shard_documents(table(spark, folder, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query
def op9_deobfuscated_pii(spark, folder):
    found = pii.find_pii(table(spark, folder, "documents"))
    order = {k: i for i, k in enumerate(pii.KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])

    def joined(spans):
        keyed = F.transform(
            spans,
            lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["end"], s["kind"]),
        )
        text = F.transform(
            F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        )
        return F.array_join(text, ",")

    def count(kind):
        return F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(k) for k in pii.KINDS}
    return found.select(
        "doc_id",
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(joined(F.col("plain")), 256).alias("base_sha256"),
        joined(F.concat("plain", "disguised")).alias("spans"),
        F.size("disguised").cast("long").alias("n_disguised"),
    )


@query
def op10_ordinal_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, folder, "labels")))


def _crc32(number):
    return F.crc32(number.cast("string"))


@query
def op11_neighbour_quality(spark, folder):
    docs = table(spark, folder, "documents")
    voters = quality.fit_quality(
        docs, table(spark, folder, "labels"), lambda doc_id: _crc32(doc_id) % 4 != 2
    )
    held_out = F.coalesce(_crc32(F.col("doc_id")) % 4 == 2, F.lit(False))
    scored = quality.score_quality(docs, voters)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op12_merkle_proofs(spark, folder):
    tampered = F.when(_crc32(F.col("doc_id")) % 5 == 0, merkle.lower_ascii(F.col("text")))
    manifest = merkle.build_manifest(table(spark, folder, "documents"), tampered)
    return merkle.verify(merkle.proofs(manifest))


@query
def op13_prefix_trie(spark, folder):
    nodes = trie.prefix_trie(*trie.rebuilt(table(spark, folder, "conversations")))
    return nodes.drop("id", "parent_id")


_TURN = """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL
   SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                         (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))"""

_DIGITS = " || ".join(
    f"substr('{warc.BASE32}', 1 + ((v{i} >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0)
)



def _crc32_sql(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal text, bit by bit."""
    text = f"CAST({number} AS VARCHAR)"
    codes = f"list_transform(range(1, 1 + length({text})), lambda i: ord(substr({text}, i::INT, 1))::BIGINT)"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs ``{name}1`` ... from ``{name}0`` (key, i, h), and the siblings ``{name}_e0`` ... of each level."""
    out = []
    for k in range(levels):
        run = "PARTITION BY key, i // 16 ORDER BY i ROWS BETWEEN"
        left = f"string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING)"
        right = f"string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        out.append(
            f"""{name}_c{k} AS (SELECT *, count(*) OVER (PARTITION BY key) AS cnt FROM {name}{k}),
{name}_e{k} AS (SELECT key, i, cnt, coalesce({left}, '') AS l, coalesce({right}, '') AS r FROM {name}_c{k}),
{name}{k + 1} AS (SELECT key, i // 16 AS i, CASE WHEN any_value(cnt) = 1 THEN any_value(h)
  ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_c{k} GROUP BY key, i // 16)"""
        )
    return ",\n".join(out)


def _climb_sql(tree: str, rows: str, first: str, levels: int) -> str:
    """CTEs that lift ``first`` (id, key, i, f, p, ...) by the tree's levels to ``{rows}{levels}``."""
    out, below = [], first
    for k in range(levels):
        out.append(
            f"""{rows}{k + 1} AS (SELECT d.* REPLACE (d.i // 16 AS i,
  CASE WHEN e.cnt > 1 THEN sha256(e.l || d.f || e.r) ELSE d.f END AS f,
  CASE WHEN e.cnt > 1 THEN d.p || e.l || e.r ELSE d.p END AS p)
  FROM {below} d JOIN {tree}_e{k} e ON d.key = e.key AND d.i = e.i)"""
        )
        below = f"{rows}{k + 1}"
    return ",\n".join(out)


# 16 ** 6 leaves a source, and as many sources.
_LEVELS = 6
_SAID = "strlen(role)::VARCHAR || ':' || role || text"

ORACLES = {
    "op2_warc_transactions": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS x FROM p),
v AS (SELECT page_id, strlen(body) AS payload_bytes, x,
  {", ".join(f"('0x' || substr(x, {1 + 5 * i}, 5))::BIGINT AS v{i}" for i in range(8))} FROM h),
d AS (SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM v),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM d JOIN f USING (payload_digest)""",
    "op3_grace_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
  first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op4_budgeted_windows": rf"""
WITH RECURSIVE raw AS ({_TURN}),
t AS (SELECT conv_id, role, text,
  row_number() OVER w - 1 AS pos,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
  sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4) OVER w AS upto,
  length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
    + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'))
    + {len(chat.START) + len(chat.END) + 2} AS chars
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, tokens AS system_tokens, chars AS system_chars FROM t
  WHERE pos = 0 AND role = 'system'),
b AS (SELECT t.*, coalesce(system_tokens, 0) AS st, coalesce(system_chars, 0) AS sc,
  upto - tokens AS before,
  greatest(1, {chat.BUDGET} - coalesce(system_tokens, 0) - {chat.HISTORY_TOKENS}) AS share
  FROM t LEFT JOIN s USING (conv_id)),
body AS (SELECT * FROM b WHERE NOT (pos = 0 AND st > 0)),
walk AS (
  SELECT conv_id, pos, pos AS span, before AS base FROM body WHERE pos = (CASE WHEN st > 0 THEN 1 ELSE 0 END)
  UNION ALL
  SELECT n.conv_id, n.pos,
    CASE WHEN n.upto - w.base > n.share THEN n.pos ELSE w.span END,
    CASE WHEN n.upto - w.base > n.share THEN n.before ELSE w.base END
  FROM walk w JOIN body n ON n.conv_id = w.conv_id AND n.pos = w.pos + 1),
heads AS (SELECT w.conv_id, w.span, x.before, x.st, x.sc FROM walk w JOIN body x
  ON x.conv_id = w.conv_id AND x.pos = w.pos WHERE w.pos = w.span),
extra AS (
  SELECT h.conv_id, q.chars FROM heads h JOIN body q ON q.conv_id = h.conv_id AND q.pos < h.span
    AND q.pos >= h.span - {chat.HISTORY_TURNS} AND h.before - q.before <= {chat.HISTORY_TOKENS}
  UNION ALL SELECT conv_id, sc FROM heads WHERE st > 0
  UNION ALL SELECT conv_id, chars FROM b WHERE st > 0 AND pos = 0
    AND conv_id NOT IN (SELECT conv_id FROM body)
  UNION ALL SELECT conv_id, chars FROM body),
f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM extra GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g JOIN f USING (conv_id)""",
    "op12_merkle_proofs": f"""
WITH d AS (SELECT *, coalesce('+' || source, '') AS key, {" || ".join(_field_sql(c) for c in
    ("doc_id", "source", "lang", "n_chars"))} AS head,
  CASE WHEN {_crc32_sql("doc_id")} % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
leaves AS (SELECT doc_id, key, sha256(head || {_field_sql("text")}) AS leaf,
  sha256(head || {_field_sql("other")}) AS f FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM leaves),
s0 AS (SELECT key, i, leaf AS h FROM placed),
{_tree_sql("s", _LEVELS)},
t0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, h FROM s{_LEVELS}),
{_tree_sql("t", _LEVELS)},
a0 AS (SELECT doc_id, key, i, leaf, f, '' AS p FROM placed),
{_climb_sql("s", "a", "a0", _LEVELS)},
b0 AS (SELECT a.* REPLACE ('' AS key, n.i AS i), n.h AS subroot FROM a{_LEVELS} a
  JOIN (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i FROM s{_LEVELS}) n ON a.key = n.key),
{_climb_sql("t", "b", "b0", _LEVELS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified
FROM b{_LEVELS} b JOIN t{_LEVELS} t ON b.key = t.key""",
    "op13_prefix_trie": f"""
WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256({_SAID})) - 1 AS pos,
  sha256({_SAID}) AS k, strlen(text) AS bytes FROM raw),
l AS (SELECT c, count(*) AS n, {_crc32_sql("c")} % 9 AS h FROM t GROUP BY c),
convs AS (SELECT l.*, l.c - l.c % 5 AS host, least(l.h, coalesce(b.n, 0)) AS taken
  FROM l LEFT JOIN l b ON b.c = l.c - l.c % 5),
r AS (SELECT c, taken + pos - h AS d, k, bytes FROM t JOIN convs USING (c) WHERE pos >= h
  UNION ALL SELECT v.c, pos, k, bytes FROM t JOIN convs v ON t.c = v.host WHERE pos < taken),
m AS (SELECT c, 0 AS depth, '' AS path, '' AS up, 0 AS bytes FROM convs
  UNION ALL SELECT c, d + 1, string_agg(k, '') OVER w, coalesce(string_agg(k, '') OVER
    (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), bytes
  FROM r WINDOW w AS (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)),
ended AS (SELECT m.*, depth = max(depth) OVER (PARTITION BY c) AS last FROM m),
nodes AS (SELECT path, any_value(up) AS up, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
  any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM ended GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT m.path, count(*) FILTER (u.n_children = 0) AS n_leaves,
  sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM full_ u JOIN m ON m.c = u.conv_id AND m.depth <= u.depth GROUP BY m.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.up""",
}
