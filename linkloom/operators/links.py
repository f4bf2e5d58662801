"""The bipartite link table and its index maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table
from .determinism import ranked


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (pid, rid): customers and the parts they ordered."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("pid"), F.col("l_partkey").alias("rid")).distinct()


def explode_labels(df: DataFrame, entity: str, labels: str, separator: str = ";", out: str = "label") -> DataFrame:
    """(entity, label) rows of a separator-joined list column."""
    return df.select(entity, F.explode(F.split(F.col(labels), F.lit(separator))).alias(out)).filter(F.col(out) != "")


def implode_labels(df: DataFrame, entity: str, label: str, separator: str = ";", out: str = "labels") -> DataFrame:
    """One row an entity with its labels, distinct and sorted."""
    return df.groupBy(entity).agg(F.array_join(F.sort_array(F.collect_set(F.col(label).cast("string"))), separator).alias(out))


def dictionary_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): distinct values numbered from 0 in their order."""
    return ranked(df.select(column).distinct(), out, column)


def extend_index(known: DataFrame, new: DataFrame, column: str, index: str) -> DataFrame:
    """``known`` (column, index) and, for unknown values of ``new``, the numbers after its largest."""
    unknown = new.select(column).distinct().join(known, column, "left_anti")
    top = known.agg(F.coalesce(F.max(index), F.lit(-1)).alias("__top"))
    added = dictionary_encode(unknown, column, "__k").crossJoin(F.broadcast(top))
    return known.select(column, index).unionByName(added.select(column, (F.col("__top") + 1 + F.col("__k")).alias(index)))


def degrees(link: DataFrame, entity: str, out: str = "degree") -> DataFrame:
    return link.groupBy(entity).agg(F.count(F.lit(1)).alias(out))


def assemble(pairs: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Pairs with the attributes of both their entities; attributes are joined last, once an entity."""
    return pairs.join(left, left_key).join(right, right_key)
