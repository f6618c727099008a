"""Retrieval metrics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import RANGE, cut_points, range_of

KS = (1, 3, 5, 10)


def per_query(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, depth: int | None = 10, skip_empty: bool = False) -> DataFrame:
    """(query_id, ap, rr, p_k, r_k ...) from queries (query_id), ranked (query_id, path, rank) and relevant (query_id, path, distinct).

    AP is the sum of precisions at hits by the number of relevant paths, RR the inverse of the first hit's rank; P@k divides by
    k even if fewer were returned. A query without relevant paths counts with zeros, or not at all with skip_empty. depth
    cuts the ranking; None takes all of it.
    """
    r = ranked if depth is None else ranked.where(F.col("rank") <= depth)
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = r.join(relevant, ["query_id", "path"]).select("query_id", "rank")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    h = hits.withColumn("nth", nth)
    at = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"h_{k}") for k in ks]
    a = h.groupBy("query_id").agg(F.sum(F.col("nth") / F.col("rank")).alias("s"), F.min("rank").alias("first"), *at)
    j = queries.select("query_id").distinct().join(n, "query_id", "inner" if skip_empty else "left").join(a, "query_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rel = F.greatest(z("n_rel"), F.lit(1))
    out = [(z("s") / rel).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        out += [(z(f"h_{k}") / k).alias(f"p_{k}"), (z(f"h_{k}") / rel).alias(f"r_{k}")]
    return j.select("query_id", *out)


def mean_metrics(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of all metric columns, and the number of queries."""
    cols = [c for c in per.columns if c != "query_id" and c not in (by or [])]
    return per.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *[F.avg(c).alias({"ap": "map", "rr": "mrr"}.get(c, c)) for c in cols])


def summary(df: DataFrame, value: str, by: list[str] | None = None, per: int = RANGE) -> DataFrame:
    """(n, min, max, mean, median, q1, q3, std): q1 and q3 are the elements n div 4 and 3 n div 4 of the sorted values (0-based; min and max below
    four values), std is the sample's, 0 for one value.

    Values are counted first. Distinct ones are dealt to ranges by fixed cut points; the ranges' sums, carried on, give where each
    range begins among a group's sorted values, so running counts are taken within a range only.
    """
    g = by or []
    v = df.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    v = v.withColumn("_p", range_of(F.col("x"), cut_points(v, "x", per), v.schema["x"].dataType.simpleString()))
    sums = v.groupBy(*g, "_p").agg(F.sum("c").alias("s"))
    before = F.sum("s").over(Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    off = sums.select(*[F.col(c).alias(f"o_{c}") for c in g], F.col("_p").alias("o_p"), F.coalesce(before, F.lit(0)).alias("lo"), F.sum("s").over(Window.partitionBy(*g)).alias("n"))
    on = F.col("_p") == F.col("o_p")
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    run = v.withColumn("hi", F.sum("c").over(Window.partitionBy(*g, "_p").orderBy("x"))).join(off if g else F.broadcast(off), on).withColumn("hi", F.col("hi") + F.col("lo"))
    at = lambda i: F.min(F.when(F.col("hi") > i, F.col("x")))
    a = run.groupBy(*g).agg(
        F.max("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"),
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"),
        at(F.floor(F.col("n") / 4)).alias("q1_"), at(F.floor(3 * F.col("n") / 4)).alias("q3_"),
    )
    s = df.where(F.col(value).isNotNull()).groupBy(*g).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    a = a.join(s, g) if g else a.join(F.broadcast(s))
    q = lambda c, m: F.when(F.col("n") >= 4, F.col(c)).otherwise(F.col(m))
    return a.select(*g, "n", "min", "max", "mean", "median", q("q1_", "min").alias("q1"), q("q3_", "max").alias("q3"), "std")


def ndcg(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with relevance 1: sum of 1 / log2(rank + 1) at hits over that of an ideal ranking; 0 without relevant paths."""
    h = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "path"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = queries.select("query_id").distinct().join(n, "query_id", "left").join(h, "query_id", "left")
    return j.select("query_id", F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))
