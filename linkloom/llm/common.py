"""Session plumbing shared by the corpus operators; `written` cuts lineage through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..storage import shared_dir, written

__all__ = ["WHITE", "bounded_batches", "bucketed", "documents", "embeddings", "held_out", "items", "labels", "parts_for", "shuffle_partitions", "spare_name", "written"]

#: The ASCII white space that separates words in every operator of this package.
WHITE = r"[\x20\x09-\x0D]+"

_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough that a batch of long texts stays far below a worker's memory."""
    ship_package(spark)
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    return spark


def spare_name(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written once to the shared folder in hash buckets of ``key``: groups and joins on it don't shuffle it again.

    Only the catalogue can name buckets; the name is dropped once the result refers to the files.
    """
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.bucketBy(min(buckets, 100_000), key).option("path", path).option("compression", "none").saveAsTable(name)
    table = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")
    return table


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id is held out: nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def parts_for(df: DataFrame, part_bytes: int = 32 << 20) -> int:
    """Partitions of about ``part_bytes`` of ``df``, by the size its plan states; no job runs."""
    stated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * shuffle_partitions(df.sparkSession), min(stated // part_bytes, 1 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
