"""Stand-ins for the data model's tables, from the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import links
from ..operators.pairwise import pairwise
from ..registry import table

LINKS = "links AS (SELECT DISTINCT o_custkey AS pid, l_partkey AS rid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SCORED = "scored AS (SELECT d.doc_id, l.quality AS y, l.toxic, d.lang, d.source, (d.n_chars % 1000)::DOUBLE / 1000::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id))"
COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
PAIRS = f"pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, {COSINE} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
SYM = "sym AS (SELECT i AS a, j AS b, sim FROM pairs UNION ALL SELECT j, i, sim FROM pairs)"
HIER = "hier AS (SELECT c_custkey, concat_ws('.', n_regionkey, n_nationkey, c_mktsegment) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)"
RXN = "rxn AS (SELECT p_partkey, concat(replace(p_brand, '#', ''), '.', p_type, '>>', replace(p_name, ' ', '.')) AS s FROM part)"


def hashed(seed: int | str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def number(seed: int | str, *keys: str) -> str:
    return f"('0x' || substr({hashed(seed, *keys)}, 1, 8))::BIGINT"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score in [0, 1): a prediction table."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return docs.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", "lang", "source", "score")


def vector_pairs(spark: SparkSession, sf: str, kernel: str = "cosine", at_least: float | None = None) -> DataFrame:
    return pairwise(table(spark, sf, "embeddings"), "vec_id", "embedding", kernel, at_least=at_least)


def hier(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a three-level code."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", "n_regionkey", "n_nationkey", "c_mktsegment").alias("code"))


def rxn(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as two-sided strings 'brand.type>>word.word'."""
    s = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.col("p_type"), F.lit(">>"), F.replace("p_name", F.lit(" "), F.lit(".")))
    return table(spark, sf, "part").select("p_partkey", s.alias("s"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


__all__ = [n for n in dir() if not n.startswith("_")] + ["links"]
