"""Evaluation of scored rows: y is 1 or 0, score a double. One pass of conditional sums where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .determinism import hash_number, ranked, running_sums

GRID = 100


def positive(score: Column, threshold: Column | float, inclusive: bool = False) -> Column:
    """Whether a score counts as 1; the comparator is the caller's choice."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return score >= t if inclusive else score > t


def confusion(y: Column, hit: Column, weight: Column | None = None) -> list[Column]:
    w = weight if weight is not None else F.lit(1)
    cell = lambda c, name: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("long").alias(name)
    return [cell((y == 1) & hit, "tp"), cell((y == 0) & hit, "fp"), cell((y == 1) & ~hit, "fn"), cell((y == 0) & ~hit, "tn")]


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def rates() -> dict[str, Column]:
    """Metrics of columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.groupBy(score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n"))


def roc_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, tp, fp, p, n) for each distinct score as an inclusive threshold; sums run by partitions."""
    points = _by_score(df, y, score).select(F.col(score).alias("score"), "p", "n")
    return running_sums(points, [F.desc("score")], {"tp": "p", "fp": "n"}).select("score", "tp", "fp", "p", "n")


def auroc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Rank statistic: pairs won plus half the ties, over all pairs."""
    points = roc_points(df, y, score)
    won = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") * 0.5)
    return points.agg((won / (F.sum("p") * F.sum("n"))).alias("auroc"))


def auprc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Trapezoid of precision over recall, from recall 0 at the first point's precision."""
    pts = roc_points(df, y, score)
    total = pts.agg(F.sum("p").alias("total"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    # the point before has the sums without this one's rows
    tp, fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    before = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(precision)
    area = F.col("p") / F.col("total") * (precision + before) / 2
    return pts.crossJoin(F.broadcast(total)).agg(F.sum(area).alias("auprc"))


def grid_counts(df: DataFrame, y: str, score: str, points: int = GRID, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn at each threshold k / (points - 1), score > threshold.

    Rows are counted into threshold bins first: the grid meets counts, not rows.
    """
    by = by or []
    w = weight if weight is not None else F.lit(1)
    # number of grid thresholds below the score
    below = F.least(F.lit(points), F.greatest(F.lit(0), F.ceil(F.col(score) * (points - 1)).cast("int")))
    exact = F.when(below == 0, 0).otherwise(F.when(F.col(score) > (below - 1) / F.lit(float(points - 1)), below).otherwise(below - 1))
    exact = F.when((exact < points) & (F.col(score) > exact / F.lit(float(points - 1))), exact + 1).otherwise(exact)
    bins = df.groupBy(*by, exact.alias("k")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("n"))
    grid = bins.select(*by).distinct() if by else bins.sparkSession.range(1).select()
    grid = grid.crossJoin(bins.sparkSession.range(points).select(F.col("id").cast("int").alias("t")))
    bins = bins.withColumnRenamed("k", "__k")
    met = grid.join(bins, by) if by else grid.crossJoin(bins)
    over = F.col("__k") > F.col("t")
    cell = lambda c, v, name: F.sum(F.when(c, F.col(v)).otherwise(0)).alias(name)
    out = met.groupBy(*by, "t").agg(cell(over, "p", "tp"), cell(over, "n", "fp"), cell(~over, "p", "fn"), cell(~over, "n", "tn"))
    return out.withColumn("threshold", F.col("t") / F.lit(float(points - 1)))


def best_threshold(scored: DataFrame, metric: str = "f1") -> DataFrame:
    """The lowest threshold of the largest metric; 0.0 if the metric is 0 everywhere."""
    best = scored.agg(F.max(F.struct(F.round(metric, 12).alias("m"), (-F.col("t")).alias("nt"), F.col("threshold").alias("th"))).alias("b"))
    return best.select(F.when(F.col("b.m") > 0, F.col("b.th")).otherwise(0.0).alias("threshold"), F.col("b.m").alias(metric))


def bootstrap(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Resamples with replacement: ``replicate`` and the drawn row's columns.

    Draw d of replicate b picks the row of rank hash(b, d) mod n in key order: the same draws anywhere.
    """
    placed = ranked(df, "__r", key)
    n = placed.count()
    draws = df.sparkSession.range(replicates * n).select((F.col("id") / n).cast("int").alias("replicate"), (F.col("id") % n).alias("d"))
    draws = draws.withColumn("__r", hash_number(seed, "replicate", "d") % n).groupBy("replicate", "__r").agg(F.count(F.lit(1)).alias("weight"))
    return draws.join(placed, "__r").drop("__r")


def interval(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and 95 % percentile interval of replicates."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("ci_lower"), F.percentile(value, F.lit(0.975)).alias("ci_upper"))


def similarity_bin(sim: Column, bounds: list[float]) -> Column:
    """Index of the half-open bin [b_k, b_k+1); null outside: the top bound itself is outside."""
    out = F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(zip(bounds, bounds[1:])))):
        out = F.when((sim >= low) & (sim < high), k).otherwise(out)
    return out


def calibration(df: DataFrame, y: str, score: str, width: float = 0.05) -> DataFrame:
    """Mean absolute error by equal-width score bin."""
    bins = F.floor(F.col(score) / F.lit(width)).cast("long").alias("bin")
    error = F.abs(F.when(F.col(score) > 0.5, 1).otherwise(0) - F.col(y))
    return df.groupBy(bins).agg(F.count(F.lit(1)).alias("n"), F.avg(error.cast("double")).alias("error_rate"), F.avg(F.abs(F.col(score) - F.col(y))).alias("mean_abs"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """t statistic and degrees of freedom of paired differences."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.filter(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return out.select((F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def coverage_k(df: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """Smallest k whose first k keys, by falling count, hold more than ``share`` of the total."""
    run = ranked(running_sums(df.select(key, count), [F.desc(count), key], {"__sum": count}), "__k", F.desc(count), key)
    total = df.agg(F.sum(count).alias("__total"))
    return run.crossJoin(F.broadcast(total)).filter(F.col("__sum") / F.col("__total") > share).agg((F.min("__k") + 1).cast("int").alias("k"))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, name..): exact percentiles, interpolated between the two nearest rows.

    Rows are placed by a distributed sort and only those at the wanted places are looked at.
    """
    placed = ranked(df.select(group, value).filter(F.col(value).isNotNull()), "__r", group, value)
    sizes = placed.groupBy(group).agg(F.min("__r").alias("__first"), F.count(F.lit(1)).alias("__n"))
    met = placed.join(sizes, group).withColumn("__k", F.col("__r") - F.col("__first"))
    out = []
    for name, share in shares.items():
        at = (F.col("__n") - 1) * F.lit(share)
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("__k") - at))
        out.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return met.groupBy(group).agg(*out)
