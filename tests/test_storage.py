"""Tables written between steps."""

from pyspark.sql import functions as F

from linkloom.operators import fingerprints, pooling
from linkloom.plans.graph_plans import LAYERS, graphs
from linkloom.storage import dealt, in_buckets, written


def test_a_large_table_in_a_small_file_is_not_gathered_by_the_driver(spark):
    wide = spark.range(1_000_000).select("id", (F.col("id") % 7).alias("code"))
    left, right = written(wide, "left"), written(wide.withColumnRenamed("code", "other"), "right")
    plan = left.join(right, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
    few = written(spark.range(10), "few")
    assert "Broadcast" in left.join(few, "id")._jdf.queryExecution().sparkPlan().toString()


def test_graphs_in_buckets_cross_the_network_once(spark, sf):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        atoms, bonds = graphs(spark, sf)
        ends = in_buckets(fingerprints.both_ways(bonds, "g"), "ends", "g")
        nodes = atoms.withColumn("h", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        states = pooling.layer_states(nodes, ends, "g", "h", LAYERS)
        last = states[-1].join(atoms.groupBy("g").agg(F.max("node").alias("node")), ["g", "node"])
        pooled = pooling.attention_pooled(last, "g", "h", F.col("h")[0], 3)
        found = fingerprints.environments(atoms, bonds, "g", 2)
        for df in (fingerprints.refined(found.filter("radius = 0").select("g", "node", "code"), ends, ["g"], 1), last, pooled):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_buckets_keep_all_rows_whether_dealt_or_not(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id")
    for given in (df.repartition(3), dealt(df, "k")):
        got = in_buckets(given, "few-rows", "k")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    more = got.unionByName(in_buckets(dealt(df, "k"), "more-rows", "k"))
    assert {r.k: r["count"] for r in more.groupBy("k").count().collect()} == {k: 2 * len(range(k, 1000, 37)) for k in range(37)}
    assert more.groupBy("k").count().count() == 37


def test_plain_sums_pool_like_summaries(spark):
    df = spark.createDataFrame([(g, [g / 3, k - 1.5], float(k)) for g in range(5) for k in range(g + 1)], "g int, v array<double>, s double")
    for plain, whole in ((pooling.attention_pooled(df, "g", "v", F.col("s"), 2), pooling.attention_pooled(df, "g", "v", F.col("s"))), (pooling.weighted_mean(df, "g", "v", size=2), pooling.weighted_mean(df, "g", "v"))):
        a, b = ({r.g: [round(x, 12) for x in r.pooled] for r in d.collect()} for d in (plain, whole))
        assert a == b and len(a) == 5
