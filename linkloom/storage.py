"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a single-process session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="linkloom-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: How much larger than its compressed file a written table is taken to be in memory, when Spark decides on broadcasts.
MEMORY_FACTOR = 32


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here.

    Keys and codes shrink so much in files that a table of millions of rows looks small enough for a
    broadcast, which the driver gathers whole; sizes of files count by ``MEMORY_FACTOR`` from here on.
    """
    df.sparkSession.conf.set("spark.sql.sources.fileCompressionFactor", str(MEMORY_FACTOR))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **{"parquet.block.size": str(32 << 20)}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once to the shared folder in hash buckets of ``key``, as many as the session has shuffle partitions.

    Rows that are not dealt by ``key`` yet should be given by `dealt`; then a bucket is one file. Joins and
    groups whose keys hold ``key`` need no exchange between such tables, and their results can be written in
    the same buckets again. For joins a setting of the session allows that, from here on. Another one bars
    it for unions: Spark 4.1 takes a union of bucketed tables as dealt, but reads its columnar parts one after another.
    Only the catalogue can name buckets; the name is dropped once the result refers to the files.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(MEMORY_FACTOR))
    name = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(bucket_count(spark), key).options(compression="zstd", path=f"{shared_dir(spark)}/{name}")
    writer.saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def bucket_count(spark: SparkSession) -> int:
    return min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` sent to the tasks that hold the buckets of ``key``."""
    return df.repartition(bucket_count(df.sparkSession), key)
