"""Activity logs and components over time: run summaries, timelines, lifecycle and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_summary(events: DataFrame, run: str, scope: str, scopes: list[str], duration: Column, hit: Column) -> DataFrame:
    """Per run: events, events of each scope, total duration and cache hits; one aggregation, whatever the scopes."""
    each = [F.count_if(F.col(scope) == s).alias(f"n_{s}") for s in scopes]
    return events.groupBy(run).agg(F.count("*").alias("events"), *each, F.sum(duration).alias("duration"), F.count_if(hit).alias("hits"))


def timeline(items: DataFrame, at: str, unit: str = "day") -> DataFrame:
    """(bin, added, cumulative) by date bin: the window runs over bins, not items."""
    bins = items.where(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, F.col(at)).cast("date").alias("bin")).agg(F.count("*").alias("added"))
    return bins.withColumn("cumulative", F.sum("added").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


#: Days of the lifecycle limits.
HALF_YEAR, YEAR, TWO_YEARS, THREE_YEARS, QUARTER = 180, 365, 730, 1095, 90


def lifecycle(changes: DataFrame, component: str, at: str, reference: str) -> DataFrame:
    """Age, days since the last change, volatility (changes a month) and category of every component at a reference date."""
    g = changes.where(F.col(at).isNotNull()).groupBy(component).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("changes"))
    ref = F.to_date(F.lit(reference))
    g = g.select(component, "changes", F.greatest(F.datediff(ref, "first"), F.lit(0)).alias("age_days"), F.datediff(ref, "last").alias("idle_days"))
    age, idle = F.col("age_days"), F.col("idle_days")
    category = F.when(age < HALF_YEAR, "new").when((age >= THREE_YEARS) & (idle < HALF_YEAR), "legacy_hot").when((age >= TWO_YEARS) & (idle >= HALF_YEAR), "frozen").when((age >= YEAR) & (idle >= HALF_YEAR), "mature").when(idle < QUARTER, "active").otherwise("mature")
    return g.withColumn("volatility", F.when(age > 0, F.col("changes") / (age / 30.44)).otherwise(0.0)).withColumn("category", category)


#: What scores 10, the factors' weights, and the levels.
RISK_MAX = {"loc": 15_000, "complexity": 15, "volume": 4_000_000}
RISK_WEIGHT = {"loc": 0.25, "complexity": 0.25, "volume": 0.5}
RISK_LEVEL = (("CRITICAL", 7.0), ("HIGH", 5.0), ("MEDIUM", 3.0))


def risk_matrix(modules: DataFrame, maxima: dict | None = None) -> DataFrame:
    """Score, level and main factor of modules (module, loc, complexity, volume, incidents)."""
    top = maxima or RISK_MAX
    part = {k: F.least(F.lit(10.0), F.col(k) / top[k] * 10) * w for k, w in RISK_WEIGHT.items()}
    plain = part["loc"] + part["complexity"] + part["volume"]
    score = F.when(F.col("incidents") > 0, F.least(F.lit(10.0), plain + F.col("incidents") * 0.5)).otherwise(plain)
    level = F.lit("LOW")
    for name, least in reversed(RISK_LEVEL):
        level = F.when(score >= least, name).otherwise(level)
    most = F.greatest(*part.values())
    main = F.when(part["loc"] == most, "loc").when(part["complexity"] == most, "complexity").otherwise("volume")
    return modules.select("module", score.alias("risk_score"), level.alias("risk_level"), main.alias("primary_factor"))
