"""The corpus pipeline: five stages from ``documents`` to sharded training data.

Each stage takes what the one before kept and returns rows with the columns of ``documents``; the last one
returns the shard of every row. ``run`` writes each stage's rows to the shared folder and reads them again,
so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.llm import decontaminate, mixing, sharding, simhash, toxicity
from fleetspectra.sources.tables import materialize


def _with_row(docs: DataFrame) -> DataFrame:
    """Columns by number, so that no name clashes, and the row's number."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.withColumn("row", F.monotonically_increasing_id())


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not rejected as toxic."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.severity_udf(model)(F.col("text"))
    return docs.filter(score["p_toxic"] < toxicity.REJECT_AT)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id, of repeated ids the first row."""
    keepers = simhash.simhash_groups(docs).filter("keeper").select(F.col("row_id").alias("row"))
    return _named(_with_row(docs).join(keepers, "row", "left_semi"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, benchmark).select(F.col("row_id").alias("row"))
    return _named(_with_row(docs).join(found, "row", "left_anti"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, shuffled inside its shards."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, slot`` of every row."""
    return sharding.shard_documents(docs)[0].drop("row_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# The stages rest on hashes and models that DuckDB does not have; tests check them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
