"""Catalog tables and parquet folders as sources and sinks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspectra.operators.fleet import union_stats


def _is_path(source: str) -> bool:
    return "/" in source


def load(spark: SparkSession, source: str) -> DataFrame:
    """A catalog table by name, or a parquet folder or file by path."""
    return spark.read.parquet(source) if _is_path(source) else spark.table(source)


def load_numbered(spark: SparkSession, pattern: str, numbers: Iterable[int]) -> DataFrame:
    """Tables named by a number, e.g. ``"stats_sg{}"``, tagged with it and united by name.

    A filter on ``sales_group`` above the union leaves one branch to be scanned.
    """
    return union_stats({n: load(spark, pattern.format(n)) for n in numbers})


def save(
    df: DataFrame,
    target: str,
    partition_by: Iterable[str] = (),
    reads_target: bool = False,
) -> None:
    """Overwrite a table or a parquet folder.

    Set ``reads_target`` when the plan of ``df`` reads what it overwrites; the rows are then written
    aside first.
    """
    rows = materialize(df, "staged") if reads_target else df
    writer = rows.write.mode("overwrite").partitionBy(*partition_by)
    if _is_path(target):
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def save_bucketed(df: DataFrame, table: str, path: str, key: str = "vin", buckets: int = 16) -> DataFrame:
    """Save a table whose rows are dealt by ``key`` into sorted buckets, a file each; returns the table.

    Tables of equally many buckets join by the key, and are grouped by it, without another shuffle. Rows are
    hashed before they are written as the buckets are, so no task writes more than its own buckets.
    """
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share.

    The session names it in ``spark.checkpoint.dir``. Without that setting a folder in the warehouse is
    taken; a warehouse on a machine's own disk is refused where executors may run on other machines.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_by_hand = context._jsc.sc().getCheckpointDir()
        root = set_by_hand.get() if set_by_hand.isDefined() else None
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        require_shared(context, root)
    return f"{root.rstrip('/')}/{context.applicationId}"


def require_shared(context, root: str) -> None:
    """Raise if ``root`` lies on a local disk and the executors are not threads of the driver."""
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    scheme = path.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file" and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"{root} is no folder that executors share; name one in spark.checkpoint.dir")


def children(spark: SparkSession, where: str) -> list[str]:
    """Names of the folders and files in a folder; none if it is not there."""
    if not exists(spark, where):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path))


def fingerprint(spark: SparkSession, *sources: str) -> str:
    """A digest of the names, sizes and times of all files below the given paths."""
    seen = hashlib.sha256()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for source in sources:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        files = path.getFileSystem(conf).listFiles(path, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        seen.update(repr((source, sorted(found))).encode())
    return seen.hexdigest()[:32]


def kept(spark: SparkSession, where: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows written to ``where`` before, or else made and written now."""
    if not exists(spark, f"{where}/_SUCCESS"):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives executors."""
    return read_back(df.sparkSession, write_aside(df, name, compression), df.schema)


def write_aside(df: DataFrame, name: str, compression: str = "snappy") -> str:
    """Write ``df`` to a new path in the shared folder; returns the path, for ``discard``."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return path


def read_back(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, where: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discard(spark: SparkSession, where: str) -> None:
    """Delete what was written to a path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)


def clear_shared_folder(spark: SparkSession) -> None:
    """Delete everything this application has materialised."""
    discard(spark, shared_folder(spark))


def preview(df: DataFrame, n: int = 10, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    keys = order or tuple(df.columns)
    return df.orderBy(*[F.col(k) for k in keys]).limit(n)
