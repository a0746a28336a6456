"""Statistics over sparse observations, in which absent rows are zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sparse_moments(rows: DataFrame, keys: list[str], value: str, observations: int) -> DataFrame:
    """mean, variance (ddof 1), std over `observations` values of which absent ones are zero.

    The moments of the rows that are there, joined with a group of zeros: m n / J, and M2 + m^2 n (J - n) / J."""
    n, mean, m2 = F.col("n"), F.col("m"), F.col("v") * F.col("n")
    total = F.lit(float(observations))
    variance = F.greatest((m2 + mean * mean * n * (total - n) / total) / F.lit(float(observations - 1)), F.lit(0.0)) if observations > 1 else F.lit(None).cast("double")
    per = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return per.select(*keys, n.alias("nonzero"), (mean * n / total).alias("mean"), variance.alias("variance")).withColumn("std", F.sqrt("variance"))


def observed_sums(rows: DataFrame, observation: list[str], keys: list[str], value: str) -> DataFrame:
    """Sums inside an observation, before any statistic or curve."""
    return rows.groupBy(*observation, *keys).agg(F.sum(value).alias(value))


def quantiles(value: Column, probabilities: tuple[float, ...] = (0.05, 0.5, 0.95)) -> list[Column]:
    """Exact quantiles, linear between ranks."""
    return [F.percentile(value, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in probabilities]


def scalar_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sample variance and std, standard error, least, most, and quantiles; one value has no variance."""
    c = F.col(value)
    return rows.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_samp(c).alias("variance"), F.stddev_samp(c).alias("std"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("se"), F.min(c).alias("least"), F.max(c).alias("most"), *quantiles(c))


def coverage(sums: DataFrame, observation: str | list[str], axis: DataFrame, cells: int, value: str) -> DataFrame:
    """For each observation of the axis the share of cells with a positive sum; observations without rows are 0."""
    observation = [observation] if isinstance(observation, str) else observation
    seen = sums.groupBy(*observation).agg((F.count_if(F.col(value) > 0) / F.lit(float(cells))).alias("coverage"))
    return axis.join(seen, observation, "left").na.fill(0.0, ["coverage"])


def grouped_levels(rows: DataFrame, observation: str, value: str) -> DataFrame:
    """Sums for (observation, cell), (observation, bin) and (observation) in one pass by grouping sets; `level` tells which."""
    out = rows.groupingSets([[F.col(observation), F.col("cell_id")], [F.col(observation), F.col("bin")], [F.col(observation)]], F.col(observation), F.col("cell_id"), F.col("bin")).agg(F.sum(value).alias(value), F.grouping("cell_id").alias("_c"), F.grouping("bin").alias("_b"))
    return out.withColumn("level", F.when(F.col("_c") == 0, "cell").when(F.col("_b") == 0, "bin").otherwise("total")).drop("_c", "_b")


def color_scale(rows: DataFrame, value: str) -> DataFrame:
    """p95 and most of the positive finite values, and their number."""
    good = F.when((F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")) & (F.col(value).cast("double") < float("inf")), F.col(value).cast("double"))
    return rows.agg(F.percentile(good, F.lit(0.95)).alias("p95"), F.max(good).alias("most"), F.count(good).alias("n"))
