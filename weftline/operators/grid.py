"""The evaluation grid as one plan: axes are columns, not jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.vectors import mean_columns, pack
from weftline.operators import metrics
from weftline.operators.search import top_k
from weftline.operators.splits import in_test, numbered


def variants(tasks: DataFrame, order: str, key: str, strategies: list[str], windows: dict[str, int | None], n_test: int) -> DataFrame:
    """(key, split, win, side): of each task, the variants it is a test or training task of. Windows hold the last n training tasks."""
    base = numbered(tasks, order)
    out = None
    for s in strategies:
        d = base.select(key, order, in_test(s, n_test).alias("test"), F.lit(s).alias("split"))
        # position among training tasks from the end: those after it, less the test tasks after it
        test = d.where("test").select(F.lit(s).alias("win"), key, "split").withColumn("side", F.lit("test")).drop("win")
        train = numbered(d.where("not test").select(key, order, "split"), order)
        for w, n in windows.items():
            t = (train if n is None else train.where(F.col("rn") > F.col("n") - n)).select(key, "split", F.lit(w).alias("win"), F.lit("train").alias("side"))
            q = test.select(key, "split", F.lit(w).alias("win"), "side")
            both = t.unionByName(q)
            out = both if out is None else out.unionByName(both)
    return out


def evaluate(v: DataFrame, vectors: DataFrame, targets: DataFrame, key: str, dim: int, k: int = 10) -> DataFrame:
    """(split, win, target, queries, map, mrr, p_k, r_k ...): v from variants, vectors (key, v), targets (key, target, path, one row for each change).

    Centroids of all variants are one aggregation, their searches one exchange, their metrics one aggregation: a query's and a
    path's variant is part of their names.
    """
    name = lambda c: F.concat_ws("\x1f", "split", "win", "target", c)
    tr = v.where("side = 'train'").join(targets, key).join(vectors, key)
    c = tr.groupBy("split", "win", "target", "path").agg(*mean_columns("v", dim)).select("split", "win", "target", "path", pack(dim).alias("v"))
    kinds = targets.select("target").distinct()
    q = v.where("side = 'test'").join(vectors, key).join(F.broadcast(kinds))
    variant = F.concat_ws("\x1f", "split", "win", "target")
    per = top_k(q.select(name(key).alias("query_id"), "v", variant.alias("variant")), c.select("path", "v", variant.alias("variant")), k, by="variant")
    rel = q.select(key, "split", "win", "target", name(key).alias("query_id")).join(targets.select(key, "target", "path").distinct(), [key, "target"]).select("query_id", "path")
    m = metrics.per_query(q.select(name(key).alias("query_id")), per, rel, depth=k)
    p = F.split("query_id", "\x1f")
    m = m.withColumns({"split": p[0], "win": p[1], "target": p[2]})
    return metrics.mean_metrics(m, ["split", "win", "target"])
