"""Node states by message passing, and graph-level vectors from node rows: attention weights, weighted means, the last node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import in_buckets, written


def attention_weights(nodes: DataFrame, graph: str, score: Column) -> DataFrame:
    """``nodes`` with ``weight``: the softmax of ``score`` within each graph, shifted by its largest score."""
    scored = written(nodes.withColumn("__s", score), "scored")
    most = written(scored.groupBy(graph).agg(F.max("__s").alias("__m")), "largest")
    shifted = scored.join(most, graph).withColumn("__e", F.exp(F.col("__s") - F.col("__m")))
    total = written(shifted.groupBy(graph).agg(F.sum("__e").alias("__t")), "totals")
    return shifted.join(total, graph).withColumn("weight", F.col("__e") / F.col("__t")).drop("__s", "__m", "__e", "__t")


def weighted_mean(nodes: DataFrame, graph: str, vector: str, weight: str | None = None, size: int | None = None) -> DataFrame:
    """(graph, pooled): weighted mean of the nodes' vectors; tasks add up before the exchange.

    With the ``size`` of the vectors each component is a plain sum, which is far cheaper for many
    small graphs than a summary object a graph.
    """
    if size is not None:
        w = F.lit(1.0) if weight is None else F.col(weight)
        sums = nodes.groupBy(graph).agg(F.sum(w).alias("__t"), *[F.sum(w * F.get(vector, F.lit(i)).cast("double")).alias(f"__v{i}") for i in range(size)])
        return sums.select(graph, F.array(*[F.col(f"__v{i}") / F.col("__t") for i in range(size)]).alias("pooled"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(vector).cast("array<double>"))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, F.col(weight))
    return nodes.groupBy(graph).agg(mean.alias("m")).select(graph, vector_to_array("m").alias("pooled"))


def attention_pooled(nodes: DataFrame, graph: str, vector: str, score: Column, size: int | None = None) -> DataFrame:
    """(graph, pooled): mean of the vectors by attention weight, the softmax of ``score`` within each graph.

    Nodes that are dealt by graph (`dealt`, `in_buckets`) cross the network no more.
    """
    scored = in_buckets(nodes.select(graph, vector, score.alias("__s")), "scored", graph)
    most = scored.groupBy(graph).agg(F.max("__s").alias("__m"))
    shifted = scored.join(most, graph).withColumn("__e", F.exp(F.col("__s") - F.col("__m")))
    return weighted_mean(shifted, graph, vector, "__e", size)


def last_node(nodes: DataFrame, graph: str, order: str, vector: str) -> DataFrame:
    """(graph, pooled): the vector of the last node, which stands for the whole graph."""
    last = nodes.groupBy(graph).agg(F.max(F.struct(order, vector)).alias("m"))
    return last.select(graph, F.col(f"m.{vector}").alias("pooled"))


Layers = list[tuple[list[list[float]], list[list[float]], list[float]]]


def message_passing(nodes: DataFrame, ends: DataFrame, graph: str, vector: str, layers: Layers) -> DataFrame:
    """(graph, node, layer, state): hidden states of all nodes (`layer_states`), layer 0 as given."""
    parts = [h.select(graph, "node", F.lit(k).alias("layer"), F.col("h").alias("state")) for k, h in enumerate(layer_states(nodes, ends, graph, vector, layers))]
    return reduce(DataFrame.unionByName, parts)


def layer_states(nodes: DataFrame, ends: DataFrame, graph: str, vector: str, layers: Layers) -> list[DataFrame]:
    """(graph, node, h) of each layer, as given for layer 0; each is in buckets of the graph.

    A layer is relu(A h + B sum of the neighbours' h + b) with fixed weights (A, B, b), which a model
    of known size has. ``ends`` has (graph, u, v) from each end; neighbours are added up by tasks
    before any exchange, so a node of many is no hot group. Nodes and ends in buckets of the graph
    (`in_buckets`) cross the network no more.
    """
    h = in_buckets(nodes.select(graph, "node", F.col(vector).cast("array<double>").alias("h")), "states", graph)
    out = [h]
    for own, others, bias in layers:
        size = len(others[0])
        theirs = ends.select(graph, "u", "v").join(h.select(graph, F.col("node").alias("v"), "h"), [graph, "v"])
        sums = theirs.groupBy(graph, F.col("u").alias("node")).agg(*[F.sum(F.get("h", F.lit(i))).alias(f"s{i}") for i in range(size)])
        met = h.join(sums, [graph, "node"], "left")
        mine, near = [F.get("h", F.lit(i)) for i in range(len(own[0]))], [F.coalesce(f"s{i}", F.lit(0.0)) for i in range(size)]
        total = lambda row, x: sum((float(w) * c for w, c in zip(row, x)), F.lit(0.0))
        mixed = F.array(*[F.greatest(total(a, mine) + float(c) + total(b, near), F.lit(0.0)) for a, b, c in zip(own, others, bias)])
        h = in_buckets(met.select(graph, "node", mixed.alias("h")), "states", graph)
        out.append(h)
    return out
