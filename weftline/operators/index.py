"""A collection of vectors with one interface and two stores: a table of the catalog, or Parquet files in a folder (U08, SK07-SK12)."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.search import top_k
from weftline.runtime import stage


class VectorIndex(ABC):
    """Rows (id, path, vector, and axes: columns that searches filter by). A store says how rows are read, replaced and dropped."""

    def __init__(self, spark: SparkSession, name: str, axes: tuple[str, ...] = ("type",)) -> None:
        self.spark, self.name, self.axes = spark, name, axes

    @abstractmethod
    def rows(self) -> DataFrame: ...

    @abstractmethod
    def _write(self, df: DataFrame, mode: str) -> None: ...

    @abstractmethod
    def drop(self) -> None: ...

    def create(self, df: DataFrame) -> None:
        """SK07: the collection anew, so doing it again gives the same."""
        self._write(df.select("id", "path", "vector", *self.axes), "overwrite")

    def insert(self, df: DataFrame) -> None:
        """SK02: the rows whose ids the collection doesn't hold yet, the first of each id by path."""
        new = df.groupBy("id").agg(F.min_by(F.struct("path", "vector", *self.axes), "path").alias("s")).select("id", "s.*")
        self._write(stage(new.join(self.rows().select("id"), "id", "left_anti"), "insert"), "append")

    def upsert(self, df: DataFrame) -> None:
        """SK08: the rows take the place of those of their ids."""
        new = df.select("id", "path", "vector", *self.axes)
        self._write(stage(self.rows().select(*new.columns).join(new.select("id"), "id", "left_anti").unionByName(new), "upsert"), "overwrite")

    def search(self, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
        """(query_id, path, score, rank) of queries (query_id, v), among rows that a condition on the axes leaves; partitions beyond it aren't read."""
        r = self.rows().where("vector is not null")
        r = r if where is None else r.where(where)
        return top_k(queries, r.select("path", F.col("vector").alias("v")), k, metric)

    def info(self) -> DataFrame:
        """SK10: vectors and their lengths by the first axis."""
        return self.rows().groupBy(self.axes[0]).agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim"))


class TableIndex(VectorIndex):
    """In the session's catalog."""

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, df: DataFrame, mode: str) -> None:
        df.write.mode(mode).format("parquet").partitionBy(*self.axes).saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class FileIndex(VectorIndex):
    """In a folder, whose path is the name."""

    _schema: str | None = None

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.name) if self._schema else self.spark.read.parquet(self.name)

    def _write(self, df: DataFrame, mode: str) -> None:
        self._schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        df.write.mode(mode).partitionBy(*self.axes).parquet(self.name)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.name)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Stores by name.
STORES: dict[str, type[VectorIndex]] = {"table": TableIndex, "files": FileIndex}


def open_index(spark: SparkSession, store: str, name: str, axes: tuple[str, ...] = ("type",)) -> VectorIndex:
    if store not in STORES:
        raise ValueError(f"no such store: {store}; there are {', '.join(sorted(STORES))}")
    return STORES[store](spark, name, axes)
