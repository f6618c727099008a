"""Text to vectors: a protocol, a deterministic hashing embedder, means of known words, and trained word vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vectorizer = Callable[[list[str]], np.ndarray]


def hashing(dim: int = 64) -> Vectorizer:
    """U01, U05, U06 stand-in where no model is at hand: signed hashes of a text's words, scaled to length 1; zero for no words."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return run


#: Vectorizers by name.
VECTORIZERS: dict[str, Callable[..., Vectorizer]] = {"hashing": hashing}


def embed(df: DataFrame, id: str, text: Column, model: str = "hashing", dim: int = 64) -> DataFrame:
    """(id, v): vectors by Arrow batches; the model is made once for each batch stream."""
    make = VECTORIZERS[model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make(dim)
        for b in batches:
            yield pd.DataFrame({id: b[id], "v": list(f(b["_t"].tolist()))})

    return df.select(id, text.alias("_t")).mapInPandas(run, f"{id} {df.schema[id].dataType.simpleString()}, v array<float>")


def word_mean(tokens: DataFrame, vectors: DataFrame, id: str, token: str, dim: int) -> DataFrame:
    """(id, v), the mean of the vectors of a text's known words; texts without any have no row. A join and one aggregation."""
    j = tokens.select(id, F.col(token).alias("word")).join(vectors, "word")
    return j.groupBy(id).agg(*[F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(dim)]).select(id, F.array(*[F.col(f"_{i}") for i in range(dim)]).alias("v"))


def word2vec(tokens: DataFrame, column: str, dim: int = 32, min_count: int = 3, seed: int = 1) -> DataFrame:
    """(word, v) trained on arrays of tokens (skip-gram)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    m = Word2Vec(vectorSize=dim, minCount=min_count, maxIter=1, seed=seed, inputCol=column, outputCol="_o").fit(tokens.where(F.size(column) > 0))
    return m.getVectors().select("word", vector_to_array("vector").alias("v"))


def projection(df: DataFrame, id: str, vector: str, k: int = 2) -> DataFrame:
    """(id, p), principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    return PCA(k=k, inputCol="_x", outputCol="_p").fit(d).transform(d).select(id, vector_to_array("_p").alias("p"))


def procrustes(pairs: DataFrame, a: str, b: str, dim: int) -> np.ndarray:
    """The rotation that takes a closest to b: U V' of the SVD of the d x d sum of outer products. Each partition adds up its own
    and gives d rows, which are added up in Spark. Pairs with a null side are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((dim, dim))
        for x in batches:
            if len(x):
                m += np.stack(x["a"].to_numpy()).T @ np.stack(x["b"].to_numpy())
        yield pd.DataFrame(m, columns=cols).assign(i=np.arange(dim))

    cols = [f"c_{j}" for j in range(dim)]
    ab = pairs.select(*[F.slice(F.col(c).cast("array<double>"), 1, dim).alias(k) for c, k in ((a, "a"), (b, "b"))]).where("a is not null and b is not null")
    rows = ab.mapInPandas(run, ", ".join(f"{c} double" for c in cols) + ", i long").groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    m = np.zeros((dim, dim))
    for r in rows:
        m[r.i] = [r[c] for c in cols]
    u, _, vt = np.linalg.svd(m)
    return u @ vt
