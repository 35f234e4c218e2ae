"""Distributions, histograms, entropy and inequality of a column by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.measures import sample_kurtosis, sample_skewness

POINTS = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def distribution(df: DataFrame, group: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Moments, quantiles and outliers by group.

    Quantiles interpolate linearly and are exact, with memory by the number of different values; give ``accuracy`` for
    columns with many, which takes bounded sketches instead.
    """
    x = F.col(value)
    point = lambda p: F.percentile(x, F.lit(p)) if accuracy is None else F.percentile_approx(x, p, accuracy).cast("double")
    stats = df.where(x.isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("total"),
        sample_skewness(x).alias("skewness"), sample_kurtosis(x).alias("kurtosis"), *[point(p).alias(k) for k, p in POINTS.items()],
    )
    stats = stats.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0))
    fences = stats.select(group, (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"))
    out = df.join(fences, group).groupBy(group).agg(F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("outliers"))
    return stats.join(out, group)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n, share) of uniform bins between the extremes, the last one closed; empty bins are there too."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    lo, hi, total = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not total:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long, share double")
    step = (hi - lo) / bins if hi > lo else 1.0
    found = x.select(F.least(F.floor((F.col("x") - lo) / step), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("bin", (lo + F.col("bin") * step).alias("low"), (lo + (F.col("bin") + 1) * step).alias("high"), n.alias("n"), (n / total * 100).alias("share"))


def entropy(df: DataFrame, group: str, item: str) -> DataFrame:
    """Shannon entropy (bits) of the items' counts by group, and over its maximum; 0 where there is one item."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("c"))
    # H = log2(N) - sum(c log2 c) / N: one aggregation over the counts.
    out = counts.groupBy(group).agg(F.count("*").alias("items"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    h = F.when(F.col("items") > 1, F.log2("n") - F.col("s") / F.col("n")).otherwise(0.0)
    return out.select(group, "items", "n", h.alias("entropy"), F.when(F.col("items") > 1, h / F.log2("items")).otherwise(0.0).alias("normalized"))


def inequality(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """One row: gini, the shares of the 4 and 8 largest, and the Herfindahl index.

    Ranks over all rows without one sorting task: equal values are counted together, dealt into ranges by approximate
    quantiles, ranked inside each range, and shifted by what the ranges before hold.
    """
    x = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    cuts = x.approxQuantile("v", [i / parts for i in range(1, parts)], 0.001)
    counts = x.groupBy("v").agg(F.count("*").alias("c")).withColumn("part", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda q: q < F.col("v"))))
    sizes = counts.groupBy("part").agg(F.sum("c").alias("size"))
    before = F.broadcast(sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))  # at most ``parts`` rows
    up = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    ranks = counts.withColumn("up", up).join(before, "part").withColumn("last", F.col("base") + F.col("up"))
    # Ranks last-c+1 .. last hold v; the sum of those ranks is c * (2 * last - c + 1) / 2.
    g = ranks.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("total"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("squares"), F.sum(F.col("v") * F.col("c") * (2 * F.col("last") - F.col("c") + 1)).alias("weighted"))
    top = x.orderBy(F.desc("v")).limit(8).withColumn("r", F.row_number().over(Window.orderBy(F.desc("v"))))
    best = top.agg(F.sum(F.when(F.col("r") <= 4, F.col("v"))).alias("top4"), F.sum("v").alias("top8")).withColumn("one", F.lit(1))
    ok = (F.col("n") >= 2) & (F.col("total") > 0)
    gini = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))))).otherwise(0.0)
    share = lambda c: F.when(F.col("total") > 0, c / F.col("total")).otherwise(0.0)
    return g.withColumn("one", F.lit(1)).join(best, "one").select("n", gini.alias("gini"), share(F.col("top4")).alias("cr4"), share(F.col("top8")).alias("cr8"), F.when(F.col("total") > 0, F.col("squares") / F.pow("total", F.lit(2.0))).otherwise(0.0).alias("herfindahl"))
