"""Exact vector search: one query set against a collection, in blocks of numpy matrices or, for few queries, in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import cosine, euclidean, manhattan
from weftline.runtime import cores, stage

#: Queries that one task compares with its share of the collection.
BLOCK = 4096
#: Where all items are queries: those of one task, and queries and items of one product.
OWN, TILE, CHUNK = 16_384, 512, 4096


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Similarity for cosine, else the negative distance."""
    if metric == "cosine":
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        s = q @ v.T
        n = np.outer(a, b)
        return np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    if metric == "euclidean":
        # differences, not the expanded square: exact for near vectors
        return -np.stack([np.sqrt(((v - x) ** 2).sum(1)) for x in q]) if len(q) else np.zeros((0, len(v)))
    return -np.stack([np.abs(v - x).sum(1) for x in q]) if len(q) else np.zeros((0, len(v)))


def top_k(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", qid: str = "query_id", path: str = "path", vector: str = "v", by: str | None = None) -> DataFrame:
    """(query_id, path, score, rank) of each query's k best items, ties by path. score is the similarity for cosine, the distance otherwise.

    A stated set of queries meets all items in blocks: query blocks are sent once to each share of the items, every share keeps k
    for each query, and only those are ranked. No pair leaves its task. Vectors of other lengths than the query's are skipped. With `by`, a column
    of both sides, queries meet only items of the same value (query_id stays unique over all), in the same exchanges.
    """
    spark = items.sparkSession
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = (lambda d: F.col(by).cast("string")) if by else (lambda d: F.lit(""))
    # staged, since its size is asked for before it is used
    q = stage(queries.select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"), group(queries).alias("g")), "queries")
    blocks = max(1, -(-q.count() // BLOCK))
    q = q.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    q = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    i = items.select(F.col(path).alias("path"), F.col(vector).cast("array<double>").alias("v"), group(items).alias("g")).withColumn("s", F.pmod(F.xxhash64("path"), F.lit(shares)).cast("int"))
    i = i.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = queries.schema[qid].dataType.simpleString()

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        c = c.sort_values("path", ignore_index=True)
        c_dim = c.v.map(len).to_numpy() if len(c) else np.zeros(0, int)
        a_dim = a.v.map(len).to_numpy() if len(a) else np.zeros(0, int)
        for d in np.intersect1d(a_dim, c_dim):
            x, y = a[a_dim == d], c[c_dim == d]
            m, v, names = np.stack(x.v.to_numpy()), np.stack(y.v.to_numpy()), y.path.to_numpy()
            for z in range(0, len(m), 256):
                s = np.round(_scores(m[z : z + 256], v, metric), 12)
                o = np.argsort(-s, 1, kind="stable")[:, :k]
                t = np.take_along_axis(s, o, 1)
                out.append(pd.DataFrame({"query_id": np.repeat(x.qid.to_numpy()[z : z + 256], o.shape[1]), "path": names[o].reshape(-1), "score": t.reshape(-1)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype=object), "path": pd.Series(dtype=object), "score": pd.Series(dtype=float)})

    got = q.groupBy("g", "s", "b").cogroup(i.groupBy("g", "s", "b")).applyInPandas(run, f"query_id {kind}, path string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "path"))
    sign = F.col("score") if metric == "cosine" else -F.col("score")
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "path", sign.alias("score"), "rank")


class _Best:
    """The k best items of each query so far, by falling score and then by the items' numbers."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        n = np.linalg.norm(q, axis=1)
        self.q, self.norm, self.k = q, n, k
        self.unit = np.divide(q, n[:, None], out=np.zeros_like(q), where=n[:, None] > 0).astype(np.float32)
        self.score, self.item = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.name = np.full((len(q), k), None, object)
        # by how much a product of 32-bit unit vectors can be off
        self.eps = (q.shape[1] + 8) * 1.2e-7

    def see(self, v: np.ndarray, number: np.ndarray, names: np.ndarray) -> None:
        """Items with rising numbers: what a product of 32-bit numbers can't rule out is computed in 64 bits."""
        v, number, names = (x[_first_equal(v, self.k)] for x in (v, number, names))
        norm = np.linalg.norm(v, axis=1)
        unit = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0).astype(np.float32).T
        for z in range(0, len(self.q), TILE):
            r = self.unit[z : z + TILE] @ unit
            least = self.score[z : z + TILE, -1] - self.eps
            if len(v) >= self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(r, len(v) - self.k, 1)[:, len(v) - self.k] - 2 * self.eps)
            i, j = np.divmod(np.flatnonzero(r >= least.astype(np.float32)[:, None] - np.float32(1e-7)), len(v))
            if not len(i):
                continue
            i += z
            n = self.norm[i] * norm[j]
            s = np.concatenate([np.einsum("ij,ij->i", self.q[i[a : a + 65_536]], v[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)])
            s = np.round(np.divide(s, n, out=np.zeros_like(s), where=n > 0), 12)
            own = np.unique(i)
            row = np.concatenate([np.repeat(own, self.k), i])
            s, item, name = (np.concatenate([old[own].reshape(-1), new]) for old, new in ((self.score, s), (self.item, number[j]), (self.name, names[j])))
            o = np.lexsort((item, -s, row))
            o = o[np.arange(len(o)) - np.searchsorted(row[o], row[o]) < self.k]
            for old, new in ((self.score, s), (self.item, item), (self.name, name)):
                old[own] = new[o].reshape(len(own), self.k)


def _first_equal(v: np.ndarray, k: int) -> np.ndarray:
    """All rows but those after the k-th of equal ones, which can't be among k best."""
    _, first, group, n = np.unique(v @ np.random.default_rng(1).standard_normal(v.shape[1]), return_index=True, return_inverse=True, return_counts=True)
    if not len(v) or n.max() <= k:
        return np.arange(len(v))
    same = (v == v[first[group]]).all(1)
    o = np.lexsort((np.arange(len(v)), ~same, group))
    nth = np.empty(len(v), np.int64)
    nth[o] = np.arange(len(v)) - np.searchsorted(group[o], group[o])
    return np.flatnonzero(~same | (nth < k))


def each_top_k(items: DataFrame, k: int, path: str = "path", vector: str = "v") -> DataFrame:
    """T01 with every item as a query: (query_id, path, score, rank) of its k best items by cosine, itself included, ties by path; paths are unique.

    Nothing is exchanged for each two blocks: items are written once in the order of their paths, and a task that holds some thousand queries reads them
    all from the shared folder (which pyarrow must know). Products of 32-bit numbers rule out what can't be among a query's best by then.
    """
    spark = items.sparkSession
    i = items.select(F.col(path).alias("path"), F.col(vector).cast("array<double>").alias("v"))
    n = 3 * cores(spark)
    i = stage(i.repartitionByRange(n, "path").sortWithinPartitions("path"), "items", "zstd")
    tasks, at = max(n, -(-i.count() // OWN)), i._weft_path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = fs.FileSystem.from_uri(at if ":/" in at else f"file://{at}")
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))  # in the order of their ranges

        def read() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """(numbers, paths, elements, all vectors one after another)"""
            at = 0
            for f in files:
                for b in pq.ParquetFile(f, filesystem=store).iter_batches(CHUNK):
                    v = b.column("v")
                    yield np.arange(at, at + len(b)), b.column("path").to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy()), v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    at += len(b)

        def of(size: np.ndarray, flat: np.ndarray, d: int) -> np.ndarray:
            return flat[np.repeat(size == d, size)].reshape(-1, d)

        for b in batches:
            for task in b.id:
                own: dict[int, list] = {}
                for number, names, size, flat in read():
                    for d in np.unique(size):
                        sel = number[size == d] % tasks == task
                        own.setdefault(int(d), []).append((names[size == d][sel], of(size, flat, d)[sel]))
                for d, parts in own.items():
                    names, q = (np.concatenate(x) for x in zip(*parts))
                    if not len(q) or not d:
                        continue
                    best = _Best(q, k)
                    for number, items_, size, flat in read():
                        if (size == d).any():
                            best.see(of(size, flat, d), number[size == d], items_[size == d])
                    there = np.isfinite(best.score)
                    row, col = np.nonzero(there)
                    yield pd.DataFrame({"query_id": names[row], "path": best.name[there], "score": best.score[there], "rank": (col + 1).astype(np.int32)})

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, "query_id string, path string, score double, rank int")


def search_one(items: DataFrame, query: list[float], k: int, metric: str = "cosine", path: str = "path", vector: str = "v") -> DataFrame:
    """T01 for one query, in the JVM: (path, score), by TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    f = {"cosine": cosine, "euclidean": euclidean, "manhattan": manhattan}[metric]
    order = F.col("score").desc() if metric == "cosine" else F.col("score")
    s = items.where(F.size(vector) == len(query)).select(F.col(path).alias("path"), F.round(f(F.col(vector), q), 12).alias("score"))
    return s.orderBy(order, "path").limit(k)


def dual_search(queries: DataFrame, recent: DataFrame, whole: DataFrame, k_recent: int, k_all: int) -> DataFrame:
    """Both collections, each with its own k, labelled and not merged."""
    a = top_k(queries, recent, k_recent).withColumn("collection", F.lit("recent"))
    return a.unionByName(top_k(queries, whole, k_all).withColumn("collection", F.lit("all")))


def rrf(ranked: list[DataFrame], c: int = 60) -> DataFrame:
    """(query_id, path, score) by reciprocal ranks, sum of 1 / (c + rank)."""
    u = ranked[0].select("query_id", "path", "rank")
    for r in ranked[1:]:
        u = u.unionByName(r.select("query_id", "path", "rank"))
    return u.groupBy("query_id", "path").agg(F.sum(1 / (c + F.col("rank"))).alias("score"))


def weighted_fusion(recent: DataFrame, history: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Alpha * recent + (1 - alpha) * historical score, a missing side as 0, with where the path came from."""
    a = recent.select("query_id", "path", F.col("score").alias("ra"))
    b = history.select("query_id", "path", F.col("score").alias("rb"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    src = F.when(F.col("ra").isNull(), "historical").when(F.col("rb").isNull(), "recent").otherwise("both")
    return a.join(b, ["query_id", "path"], "full").select("query_id", "path", (alpha * z("ra") + (1 - alpha) * z("rb")).alias("score"), src.alias("source"))


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, path, rank): candidates (query_id, path, score, v) taken one by one by weight * score - (1 - weight) * the
    greatest similarity to those taken; ties by path. Candidates of a query are a top-k already, so a group is small."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("path", ignore_index=True)
        v = np.stack(g.v.to_numpy())
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        sim, near, left, out = v @ v.T, np.full(len(g), 0.0), np.ones(len(g), bool), []
        for _ in range(min(k, len(g))):
            s = np.where(left, np.round(weight * g.score.to_numpy() - (1 - weight) * near, 12), -np.inf)
            i = int(s.argmax())
            left[i] = False
            near = np.maximum(near, sim[i])
            out.append(g.path[i])
        return pd.DataFrame({"query_id": [g.query_id[0]] * len(out), "path": out, "rank": range(1, len(out) + 1)})

    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {candidates.schema['query_id'].dataType.simpleString()}, path string, rank int")
