"""Drift over successive versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trend(value: str, step: str = "checkpoint"):
    """Change per step from the first to the last version; 0 with one version."""
    n = F.count(value)
    return F.when(n < 2, 0.0).otherwise((F.max_by(value, step) - F.min_by(value, step)) / (n - 1))


def cumulative(rows: DataFrame, chain: str, step: str, asks: str) -> DataFrame:
    """The asks of a step and of all before it."""
    w = Window.partitionBy(chain).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(asks, F.flatten(F.collect_list(asks).over(w)))


def with_prior(rows: DataFrame, chain: str, step: str, response: str) -> DataFrame:
    """The answer of the step before."""
    return rows.withColumn("prior", F.lag(response).over(Window.partitionBy(chain).orderBy(step)))


def until_error(rows: DataFrame, chain: str, step: str, error: str = "error") -> DataFrame:
    """Steps up to and with the first failed one."""
    w = Window.partitionBy(chain).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    broken = F.coalesce(F.max(F.col(error).isNotNull().cast("int")).over(w), F.lit(0))
    return rows.withColumn("_broken", broken).where("_broken = 0").drop("_broken")


def chains(rows: DataFrame, chain: str, values: list[str], expected: DataFrame) -> DataFrame:
    """Per chain: number of versions, expected number and the trend of each value."""
    per = rows.groupBy(chain).agg(F.count("*").alias("n"), *(trend(v).alias(f"{v}_drift") for v in values))
    return per.join(expected, chain)


def summary(per_chain: DataFrame, values: list[str]) -> DataFrame:
    """Mean drift and share of rising chains over full chains of two versions or more; how many were cut short."""
    full = (F.col("n") >= F.col("expected")) & (F.col("n") >= 2)
    out = [F.count_if(full).alias("complete"), F.count_if(F.col("n") < F.col("expected")).alias("truncated")]
    for v in values:
        drift = F.when(full, F.col(f"{v}_drift"))
        out += [F.avg(drift).alias(f"{v}_drift"), (100 * F.avg((drift > 0).cast("int"))).alias(f"pct_{v}_rising")]
    return per_chain.agg(*out)
