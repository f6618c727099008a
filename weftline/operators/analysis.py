"""Analysis of result tables and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """N, mean, std (0 for one), min, max, median of value."""
    v = F.col(value)
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))


def parameter_impact(df: DataFrame, params: list[str], value: str) -> DataFrame:
    """(param, setting, n, mean, std) over every setting of every parameter, by one unpivot and one aggregation."""
    u = df.select(*[F.col(p).cast("string").alias(p) for p in params], F.col(value).alias("_v")).unpivot(["_v"], params, "param", "setting")
    return u.groupBy("param", "setting").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"))


def success_shares(df: DataFrame, by: str, ok: Column, reused: Column, part: str, whole: str) -> DataFrame:
    """Runs, success rate, and of successful runs the reuse rate and the share of time spent in part, in per cent."""
    s = F.when(ok, 1.0)
    return df.groupBy(by).agg(
        F.count("*").alias("runs"), (100 * F.avg(ok.cast("int"))).alias("success_pct"), (100 * F.avg(F.when(ok, reused.cast("int")))).alias("reuse_pct"), (100 * F.sum(s * F.col(part)) / F.sum(s * F.col(whole))).alias("part_pct")
    )


def pivot_means(df: DataFrame, row: str, col: str, values: list, value: str) -> DataFrame:
    """A36"""
    return df.groupBy(row).pivot(col, values).agg(F.avg(value))


def dashboard(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """(axis, setting, n, mean, best) for every axis and over all, by grouping sets: one pass for all slices."""
    sets = df.select(*[F.col(a).cast("string").alias(a) for a in axes], F.col(value).alias("_v"))
    g = sets.groupingSets([[F.col(a)] for a in axes] + [[]], *[F.col(a) for a in axes]).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.max("_v").alias("best"), *[F.grouping(a).alias(f"g_{a}") for a in axes])
    axis = F.coalesce(*[F.when(F.col(f"g_{a}") == 0, F.lit(a)) for a in axes], F.lit("all"))
    setting = F.coalesce(*[F.when(F.col(f"g_{a}") == 0, F.col(a)) for a in axes])
    return g.select(axis.alias("axis"), setting.alias("setting"), "n", "mean", "best")


def project_stats(raw: DataFrame, task: DataFrame) -> DataFrame:
    """One row of counts, linkage and feasibility of a project, by one aggregation of each table."""
    linked = (F.col("task_name").isNotNull()) & (F.col("task_name") != "")
    r = raw.agg(
        F.count("*").alias("rows"), F.countDistinct("sha").alias("commits"), F.countDistinct(F.when(linked, F.col("sha"))).alias("linked_commits"),
        F.countDistinct(F.when(linked, F.col("task_name"))).alias("linked_tasks"), F.min("cmt_date").alias("first_date"), F.max("cmt_date").alias("last_date"),
    )
    full = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1))
    t = task.agg(F.count("*").alias("tasks"), full("description").alias("with_description"), full("comments").alias("with_comments"))
    c = F.greatest(F.col("commits"), F.lit(1))
    return r.join(F.broadcast(t)).select(
        "*", F.round(F.col("rows") / c, 2).alias("files_per_commit"), F.round(100 * F.col("linked_commits") / c, 2).alias("linkage_pct"),
        (F.col("linked_tasks") >= 600).alias("tickets_usable"), (F.col("commits") >= 600).alias("commits_usable"),
    )


def wins(df: DataFrame, project: str, variant: list[str], value: str) -> DataFrame:
    """For each variant, the number of projects it is best in (ties count for all)."""
    r = F.rank().over(Window.partitionBy(project).orderBy(F.col(value).desc()))
    return df.withColumn("_r", r).groupBy(*variant).agg(F.count(F.when(F.col("_r") == 1, 1)).alias("wins"), F.avg(value).alias("pooled"))


def paired(df: DataFrame, keys: list[str], model: str, a: str, b: str, value: str) -> DataFrame:
    """Of pairs of the same keys, n, mean and median of b's value less a's, and the share that b wins."""
    p = df.groupBy(*keys).pivot(model, [a, b]).agg(F.avg(value)).withColumn("_d", F.col(b) - F.col(a)).where("_d is not null")
    return p.agg(F.count("*").alias("pairs"), F.avg("_d").alias("mean_diff"), F.median("_d").alias("median_diff"), F.avg((F.col("_d") > 0).cast("int")).alias("win_share"))


def leaderboard(df: DataFrame, metric: str, n: int, least: bool = True, tie: str = "id") -> DataFrame:
    """T05, T06"""
    c = F.col(metric).asc_nulls_last() if least else F.col(metric).desc_nulls_last()
    return df.orderBy(c, tie).limit(n)


def compare_runs(df: DataFrame, runs: list, run: str, key: str, value: str) -> DataFrame:
    """Keys that all runs have, their values side by side and the smallest."""
    p = df.where(F.col(run).isin(runs)).groupBy(key).pivot(run, runs).agg(F.avg(value))
    for r in runs:
        p = p.where(F.col(f"`{r}`").isNotNull())
    return p.withColumn("least", F.least(*[F.col(f"`{r}`") for r in runs]))
