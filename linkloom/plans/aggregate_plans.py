"""Aggregations and evaluation (A rows) and window logic (W rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F


from ..operators import determinism as D
from ..operators import grid
from ..operators import metrics as M
from ..operators import pairwise as P
from ..operators.links import degrees, links
from ..operators.splits import first_rows
from ..registry import query, table
from .fixtures import LINKS, PAIRS, SCORED, SYM, number, r6, scored

CONF = "sum(CASE WHEN y = 1 AND hit THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN y = 0 AND hit THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN y = 1 AND NOT hit THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN y = 0 AND NOT hit THEN 1 ELSE 0 END)::DOUBLE AS tn"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END"


@query("a1_group_count_mean", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def a1(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean"))


@query("a2_small_groups_dropped", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 50)")
def a2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    large = docs.groupBy("source").count().filter("count >= 50")
    return docs.join(large, "source", "left_semi").select("doc_id")


@query("a3_first_and_list", "SELECT o_custkey, min(o_orderdate) AS first_date, list_sort(list(o_orderkey)) AS orders FROM orders GROUP BY o_custkey")
def a3(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"), F.sort_array(F.collect_list("o_orderkey")).alias("orders"))


@query("a4_distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem")
def a4(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))


@query("a6_fold_reverses", "SELECT least(concat(p_brand, '|', p_type), concat(p_type, '|', p_brand)) AS k, min(p_partkey) AS keep FROM part GROUP BY 1")
def a6(spark, sf):
    k = F.least(F.concat_ws("|", "p_brand", "p_type"), F.concat_ws("|", "p_type", "p_brand")).alias("k")
    return table(spark, sf, "part").groupBy(k).agg(F.min("p_partkey").alias("keep"))


@query("a7_content_dedup", "SELECT min(doc_id) AS keep, count(*) AS copies, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM documents GROUP BY text")
def a7(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h"))
    out = g.agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies"), F.array_join(F.sort_array(F.collect_set("source")), ";").alias("sources"))
    return out.drop("h")


@query("a8_value_frequency", f"WITH {LINKS} SELECT rid, count(*) AS n FROM links GROUP BY rid ORDER BY n DESC, rid LIMIT 20")
def a8(spark, sf):
    return degrees(links(spark, sf), "rid", "n").orderBy(F.desc("n"), "rid").limit(20)


@query("a9_degree_distribution", f"WITH {LINKS}, d AS (SELECT pid, count(*) AS k FROM links GROUP BY pid) SELECT sum(k)::BIGINT AS nnz, round(avg(k), 6) AS mean, round(stddev_pop(k), 6) AS std, round(sum(k) / (count(*) * (SELECT count(DISTINCT rid) FROM links)), 9) AS density FROM d")
def a9(spark, sf):
    l = links(spark, sf)
    d = degrees(l, "pid", "k").agg(F.sum("k").alias("nnz"), F.avg("k").alias("m"), F.stddev_pop("k").alias("s"), F.count(F.lit(1)).alias("rows"))
    cols = l.select("rid").distinct().agg(F.count(F.lit(1)).alias("cols"))
    return d.crossJoin(cols).select("nnz", r6("m").alias("mean"), r6("s").alias("std"), F.round(F.col("nnz") / (F.col("rows") * F.col("cols")), 9).alias("density"))


@query("a10_coverage_k", f"WITH {LINKS}, d AS (SELECT rid, count(*) AS n FROM links GROUP BY rid), r AS (SELECT row_number() OVER (ORDER BY n DESC, rid) AS k, sum(n) OVER (ORDER BY n DESC, rid ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM d) AS share FROM d) SELECT min(k)::INTEGER AS k FROM r WHERE share > 0.8::DOUBLE")
def a10(spark, sf):
    return M.coverage_k(degrees(links(spark, sf), "rid", "n"), "rid", "n", 0.8)


@query("a11_pivot", "SELECT lang, round(avg(CASE WHEN quality = 0 THEN n_chars END), 6) AS mean_0, round(avg(CASE WHEN quality = 1 THEN n_chars END), 6) AS mean_1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a11(spark, sf):
    met = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = met.groupBy("lang").pivot("quality", [0, 1]).agg(F.avg("n_chars"))
    return p.select("lang", r6("`0`").alias("mean_0"), r6("`1`").alias("mean_1"))


@query("a12_percentiles", "SELECT event_type, round(quantile_cont(value::DOUBLE, 0.025::DOUBLE), 6) AS p025, round(quantile_cont(value::DOUBLE, 0.5::DOUBLE), 6) AS p500, round(quantile_cont(value::DOUBLE, 0.975::DOUBLE), 6) AS p975 FROM events GROUP BY event_type")
def a12(spark, sf):
    out = M.percentiles(table(spark, sf, "events"), "event_type", "value", {"p025": 0.025, "p500": 0.5, "p975": 0.975})
    return out.select("event_type", *[r6(c).alias(c) for c in ("p025", "p500", "p975")])


@query("a13_top_trials", "WITH t AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50), c AS (SELECT o_orderpriority, count(*) AS n FROM t GROUP BY 1) SELECT (SELECT o_orderpriority FROM c ORDER BY n DESC, o_orderpriority LIMIT 1) AS mode_priority, round(avg(o_totalprice), 4) AS mean_price FROM t")
def a13(spark, sf):
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    mode = top.groupBy("o_orderpriority").count().orderBy(F.desc("count"), "o_orderpriority").limit(1).select(F.col("o_orderpriority").alias("mode_priority"))
    return mode.crossJoin(top.agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price")))


@query("a14_confusion_rates", f"WITH {SCORED}, c AS (SELECT {CONF} FROM (SELECT y, score > 0.5::DOUBLE AS hit FROM scored)) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr FROM c")
def a14(spark, sf):
    c = scored(spark, sf).agg(*M.confusion(F.col("y"), M.positive(F.col("score"), 0.5)))
    r = M.rates()
    return c.select("tp", "fp", "fn", "tn", r6(r["fpr"]).alias("fpr"), r6(r["fnr"]).alias("fnr"))


@query("a15_threshold_metrics", f"WITH {SCORED}, c AS (SELECT lang, {CONF} FROM (SELECT lang, y, score >= 0.25::DOUBLE AS hit FROM scored) GROUP BY lang) SELECT lang, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round({F1}, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM c")
def a15(spark, sf):
    c = scored(spark, sf).groupBy("lang").agg(*M.confusion(F.col("y"), M.positive(F.col("score"), 0.25, inclusive=True)))
    r = M.rates()
    return c.select("lang", *[r6(r[k]).alias(k) for k in ("precision", "recall", "f1", "accuracy", "mcc")])


@query("a16_auroc", f"WITH {SCORED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 9) AS auroc FROM scored a, scored b WHERE a.y = 1 AND b.y = 0")
def a16(spark, sf):
    return M.auroc(scored(spark, sf)).select(F.round("auroc", 9).alias("auroc"))


@query(
    "a17_auprc",
    f"""WITH {SCORED}, g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY score),
    c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT score, tp::DOUBLE / (tp + fp) AS pr, tp::DOUBLE / (SELECT sum(y) FROM scored) AS rc FROM c),
    s AS (SELECT pr, rc, lag(pr) OVER (ORDER BY score DESC) AS pp, lag(rc) OVER (ORDER BY score DESC) AS prc FROM r)
    SELECT round(sum((rc - coalesce(prc, 0)) * (pr + coalesce(pp, pr)) / 2), 9) AS auprc FROM s""",
)
def a17(spark, sf):
    return M.auprc(scored(spark, sf)).select(F.round("auprc", 9).alias("auprc"))


_B, _SEED = 20, 11
BOOT = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM scored), n AS (SELECT count(*) AS n FROM scored),
    draws AS (SELECT b, {number(_SEED, 'b', 'd')} % n AS r FROM n, range({_B}) t(b), range((SELECT count(*) FROM scored)) u(d)),
    drawn AS (SELECT b, y, score FROM draws JOIN ranked USING (r))"""


@query(
    "a18_bootstrap_interval",
    f"""WITH {SCORED}, {BOOT}, c AS (SELECT b, {CONF} FROM (SELECT b, y, score >= 0.5::DOUBLE AS hit FROM drawn) GROUP BY b), f AS (SELECT {F1} AS f1 FROM c)
    SELECT round(avg(f1), 6) AS mean, round(quantile_cont(f1::DOUBLE, 0.025::DOUBLE), 6) AS ci_lower, round(quantile_cont(f1::DOUBLE, 0.975::DOUBLE), 6) AS ci_upper FROM f""",
)
def a18(spark, sf):
    drawn = M.bootstrap(scored(spark, sf).select("doc_id", "y", "score"), "doc_id", _B, _SEED)
    c = drawn.groupBy("replicate").agg(*M.confusion(F.col("y"), M.positive(F.col("score"), 0.5, inclusive=True), F.col("weight")))
    out = M.interval(c.select(M.rates()["f1"].alias("f1")), "f1")
    return out.select(*[r6(x).alias(x) for x in ("mean", "ci_lower", "ci_upper")])


@query(
    "a19_threshold_tuning",
    f"""WITH {SCORED}, {BOOT}, g AS (SELECT t, t / 99.0::DOUBLE AS threshold FROM range(100) x(t)),
    c AS (SELECT t, threshold, b, {CONF} FROM (SELECT t, threshold, b, y, score > threshold AS hit FROM drawn, g) GROUP BY ALL),
    m AS (SELECT t, threshold, round(avg({F1}), 9) AS f1 FROM c GROUP BY t, threshold)
    SELECT round(threshold, 9) AS threshold, round(f1, 6) AS f1 FROM m ORDER BY f1 DESC, t LIMIT 1""",
)
def a19(spark, sf):
    drawn = M.bootstrap(scored(spark, sf).select("doc_id", "y", "score"), "doc_id", _B, _SEED)
    counts = M.grid_counts(drawn, "y", "score", weight=F.col("weight"), by=["replicate"])
    means = counts.withColumn("f1", M.rates()["f1"]).groupBy("t", "threshold").agg(F.round(F.avg("f1"), 9).alias("f1"))
    return M.best_threshold(means).select(F.round("threshold", 9).alias("threshold"), r6("f1").alias("f1"))


@query("a20_metrics_by_bucket", f"WITH {SCORED}, b AS (SELECT CASE WHEN score < 0.4::DOUBLE THEN 0 WHEN score < 0.6::DOUBLE THEN 1 WHEN score < 0.8::DOUBLE THEN 2 ELSE 3 END AS bucket, toxic AS y, doc_id % 2 = 0 AS hit FROM scored WHERE score < 1), c AS (SELECT bucket, {CONF} FROM b GROUP BY bucket) SELECT bucket, round({F1}, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def a20(spark, sf):
    rows = scored(spark, sf).select(M.similarity_bin(F.col("score"), [0.0, 0.4, 0.6, 0.8, 1.0]).alias("bucket"), "toxic", (F.col("doc_id") % 2 == 0).alias("hit"))
    c = rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(*M.confusion(F.col("toxic"), F.col("hit")))
    return c.select("bucket", r6(M.rates()["f1"]).alias("f1"), r6(M.rates()["accuracy"]).alias("accuracy"))


@query("a21_chance_baseline", f"WITH {SCORED}, c AS (SELECT {CONF} FROM (SELECT y, {number(9, 'doc_id')} % 2 = 1 AS hit FROM scored)) SELECT round({F1}, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c")
def a21(spark, sf):
    c = scored(spark, sf).agg(*M.confusion(F.col("y"), D.hash_number(9, "doc_id") % 2 == 1))
    return c.select(r6(M.rates()["f1"]).alias("f1"), r6(M.rates()["accuracy"]).alias("accuracy"))


@query("a22_calibration", f"WITH {SCORED} SELECT floor(score / 0.05::DOUBLE)::BIGINT AS bin, count(*) AS n, round(avg(abs((CASE WHEN score > 0.5::DOUBLE THEN 1 ELSE 0 END) - y)), 6) AS error_rate, round(avg(abs(score - y)), 6) AS mean_abs FROM scored GROUP BY 1")
def a22(spark, sf):
    return M.calibration(scored(spark, sf), "y", "score").select("bin", "n", r6("error_rate").alias("error_rate"), r6("mean_abs").alias("mean_abs"))


@query("a23_mean_vectors", "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 1)) SELECT label, (p - 1)::INTEGER AS pos, round(avg(x::DOUBLE), 6) AS mean FROM e GROUP BY label, p")
def a23(spark, sf):
    e = table(spark, sf, "embeddings")
    many = e.groupBy("label").count().filter("count > 1")
    cells = e.join(many, "label", "left_semi").select("label", F.posexplode("embedding").alias("pos", "x"))
    return cells.groupBy("label", "pos").agg(r6(F.avg(F.col("x").cast("double"))).alias("mean"))


@query("a24_paired_t", "WITH d AS (SELECT l_extendedprice - l_quantity * 900 AS d FROM lineitem) SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, count(*) - 1 AS df FROM d")
def a24(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 900).alias("base"))
    return M.paired_t(rows, "l_extendedprice", "base").select(F.round("t", 4).alias("t"), "df")


@query("a25_quality_audit", "SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents WHERE n_chars > 500 GROUP BY lang")
def a25(spark, sf):
    docs = table(spark, sf, "documents")
    per = docs.groupBy("lang").agg(F.count_if(F.col("n_chars") > 500).alias("n"), F.count(F.lit(1)).alias("all"))
    return per.crossJoin(per.agg(F.sum("all").alias("total"))).filter("n > 0").select("lang", "n", r6(F.lit(100.0) * F.col("n") / F.col("total")).alias("share"))


@query("a28_fold_balance", f"WITH {SCORED} SELECT ({number(2, 'doc_id')} % 5)::INTEGER AS fold, count(*) AS n, round(avg(y), 6) AS positive FROM scored GROUP BY 1")
def a28(spark, sf):
    return scored(spark, sf).groupBy((D.hash_number(2, "doc_id") % 5).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("positive"))


@query("a29_similarity_histogram", f"WITH {PAIRS} SELECT floor((sim + 1) / 0.05::DOUBLE)::BIGINT AS bin, count(*) AS n FROM pairs GROUP BY 1")
def a29(spark, sf):
    return grid.binned(table(spark, sf, "embeddings"), "vec_id", "embedding", P.KERNELS["cosine"], lambda s: np.floor((s + 1) / 0.05))


@query(
    "a30_band_fractions",
    f"""WITH {PAIRS}, {SYM}, m AS (SELECT a, a % 5 AS fold, max(sim) AS s FROM sym WHERE a % 5 <> b % 5 GROUP BY a)
    SELECT fold, round(avg(CASE WHEN s <= 0.35::DOUBLE THEN 1 ELSE 0 END), 6) AS b1, round(avg(CASE WHEN s <= 0.4::DOUBLE THEN 1 ELSE 0 END) - avg(CASE WHEN s <= 0.35::DOUBLE THEN 1 ELSE 0 END), 6) AS b2, round(1 - avg(CASE WHEN s <= 0.4::DOUBLE THEN 1 ELSE 0 END), 6) AS b3 FROM m GROUP BY fold""",
)
def a30(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("fold", F.col("vec_id") % 5)
    m = grid.best(e, "vec_id", "embedding", 1, P.KERNELS["cosine"], differ="fold").select("a", F.col("sim").alias("s"))
    at = lambda t: F.avg((F.col("s") <= t).cast("int"))
    return m.groupBy((F.col("a") % 5).alias("fold")).agg(r6(at(0.35)).alias("b1"), r6(at(0.4) - at(0.35)).alias("b2"), r6(1 - at(0.4)).alias("b3"))


@query("a31_weighted_level", "SELECT round(sum((p_size % 5 + 1) * p_retailprice) / sum(p_retailprice), 6) AS level FROM part")
def a31(spark, sf):
    return table(spark, sf, "part").agg(r6(F.sum((F.col("p_size") % 5 + 1) * F.col("p_retailprice")) / F.sum("p_retailprice")).alias("level"))


@query("a32_paired_fractions", "SELECT round(avg(CASE WHEN l_tax - l_discount > 0.01::DOUBLE THEN 1 ELSE 0 END), 6) AS larger, round(avg(CASE WHEN l_tax > 0.06::DOUBLE THEN 1 ELSE 0 END), 6) AS high FROM lineitem")
def a32(spark, sf):
    share = lambda c: r6(F.avg(c.cast("int")))
    return table(spark, sf, "lineitem").agg(share(F.col("l_tax") - F.col("l_discount") > 0.01).alias("larger"), share(F.col("l_tax") > 0.06).alias("high"))


@query("w1_top_neighbours", f"WITH {PAIRS}, {SYM}, r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sym) SELECT a, b, rank::INTEGER AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10")
def w1(spark, sf):
    return grid.best(table(spark, sf, "embeddings"), "vec_id", "embedding", 10, P.KERNELS["cosine"]).select("a", "b", "rank", r6("sim").alias("sim"))


@query("w2_leave_one_out_accuracy", f"WITH {PAIRS}, {SYM}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sym), h AS (SELECT a, rank, x.label = y.label AS same FROM r JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id WHERE rank <= 5), q AS (SELECT a, max(CASE WHEN rank <= 1 AND same THEN 1 ELSE 0 END) AS k1, max(CASE WHEN rank <= 3 AND same THEN 1 ELSE 0 END) AS k3, max(CASE WHEN same THEN 1 ELSE 0 END) AS k5 FROM h GROUP BY a) SELECT round(avg(k1), 6) AS top1, round(avg(k3), 6) AS top3, round(avg(k5), 6) AS top5 FROM q")
def w2(spark, sf):
    label = table(spark, sf, "embeddings").select("vec_id", "label").filter("label IS NOT NULL")
    top = grid.best(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, P.KERNELS["cosine"])
    met = top.join(label.select(F.col("vec_id").alias("a"), F.col("label").alias("x")), "a").join(label.select(F.col("vec_id").alias("b"), F.col("label").alias("z")), "b")
    best = met.groupBy("a").agg(F.min(F.when(F.col("x") == F.col("z"), F.col("rank"))).alias("first"))
    hit = lambda k: r6(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int"))).alias(f"top{k}")
    return best.agg(hit(1), hit(3), hit(5))


@query("w3_empirical_cdf", f"WITH {SCORED} SELECT doc_id, round(row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) / count(*) OVER (PARTITION BY lang), 6) AS cdf, round(cume_dist() OVER (PARTITION BY lang ORDER BY score), 6) AS cdf_ties FROM scored")
def w3(spark, sf):
    """Places come from a distributed sort: a common language is no single task."""
    placed = D.ranked(scored(spark, sf).select("doc_id", "lang", "score"), "__r", "lang", "score", "doc_id")
    sizes = placed.groupBy("lang").agg(F.min("__r").alias("__first"), F.count(F.lit(1)).alias("__n"))
    ties = placed.groupBy("lang", "score").agg(F.max("__r").alias("__last"))
    met = placed.join(ties, ["lang", "score"]).join(sizes, "lang")
    share = lambda c: r6((F.col(c) - F.col("__first") + 1) / F.col("__n"))
    return met.select("doc_id", share("__r").alias("cdf"), share("__last").alias("cdf_ties"))


@query("w4_running_sums", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS up, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING), 2) AS down FROM orders")
def w4(spark, sf):
    w = Window.partitionBy("o_custkey")
    run = lambda *o: F.round(F.sum("o_totalprice").over(w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)), 2)
    return table(spark, sf, "orders").select("o_orderkey", run("o_orderdate", "o_orderkey").alias("up"), run(F.desc("o_orderdate"), F.desc("o_orderkey")).alias("down"))


@query("w5_best_row", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def w5(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("w6_first_occurrence", "SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def w6(spark, sf):
    return first_rows(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], "l_orderkey", "l_linenumber").drop("l_linenumber")


@query("w7_fill_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events")
def w7(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("since"))


@query("a27_cumulative_negatives", f"WITH s AS (SELECT l_linenumber AS epoch, l_suppkey, l_partkey FROM lineitem), f AS (SELECT l_suppkey, l_partkey, min(epoch) AS epoch FROM s GROUP BY ALL), n AS (SELECT epoch, count(*) AS new FROM f GROUP BY epoch), e AS (SELECT DISTINCT epoch FROM s) SELECT epoch, coalesce(new, 0) AS new, sum(coalesce(new, 0)) OVER (ORDER BY epoch)::BIGINT AS total FROM e LEFT JOIN n USING (epoch)")
def a27(spark, sf):
    from ..operators.negatives import cumulative_new

    return cumulative_new(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("epoch"), "l_suppkey", "l_partkey"), "epoch", "l_suppkey", "l_partkey")


@query("t7_flat_columns", "SELECT lang, round(avg(CASE WHEN quality = 0 THEN n_chars END), 6) AS n_chars_avg_0, max(CASE WHEN quality = 0 THEN n_chars END) AS n_chars_max_0, round(avg(CASE WHEN quality = 1 THEN n_chars END), 6) AS n_chars_avg_1, max(CASE WHEN quality = 1 THEN n_chars END) AS n_chars_max_1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def t7(spark, sf):
    """A pivot's names in levels (column, statistic, value) as one name each."""
    from ..schemas import flat_name

    met = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = met.groupBy("lang").pivot("quality", [0, 1]).agg(r6(F.avg("n_chars")).alias("avg"), F.max("n_chars").alias("max"))
    levels = [("n_chars", stat, value) for value in ("0", "1") for stat in ("avg", "max")]
    return p.select("lang", *[F.col(f"`{v}_{s}`").alias(flat_name(c, s, v)) for c, s, v in levels])
