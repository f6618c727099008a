"""Writing rules: ignore, upsert, conditional update, collections, backup, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_or_ignore(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SK01, SK02, SK06: the first row (by order) of each key. WindowGroupLimit cuts repeated keys before the exchange."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_r", rn).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """SK03: new rows replace old ones of their key, the last by order winning; keys only in one side stay. Write the result elsewhere, then swap."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    n = new.withColumn("_r", last).where("_r = 1").drop("_r")
    return old.join(n.select(key), key, "left_anti").select(*old.columns).unionByName(n, allowMissingColumns=True)


def fill_task_names(commits: DataFrame, found: DataFrame) -> DataFrame:
    """SK04: task_name of the commits that have none, by sha; found (sha, task_name) has the smallest name of a sha."""
    f = found.groupBy("sha").agg(F.min("task_name").alias("_t"))
    cols = commits.columns
    return commits.join(f, "sha", "left").withColumn("task_name", F.coalesce("task_name", "_t")).select(*cols)


def new_task_names(commits: DataFrame, task: DataFrame) -> DataFrame:
    """SK05: distinct names of commits that task does not hold yet."""
    return commits.where("task_name is not null and task_name <> ''").select(F.col("task_name").alias("name")).distinct().join(task.select("name"), "name", "left_anti")


def serving_rows(raw: DataFrame) -> DataFrame:
    """SC16: what the serving store holds: rows with a task and a path."""
    return raw.where("task_name is not null and path is not null").select("id", "task_name", "path", "message", "diff")


def create_collection(df: DataFrame, name: str, recreate: bool = True) -> None:
    """SK07, SK08: a table of (id, path, type, vector), recreated, so writing it again gives the same."""
    df.write.mode("overwrite" if recreate else "append").format("parquet").saveAsTable(name)


def drop_collections(spark: SparkSession, like: str = "%") -> list[str]:
    """SK12: drops the tables whose names match an SQL pattern; their names."""
    import re

    rx = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in like) + r"\Z", re.I)
    names = [t.name for t in spark.catalog.listTables() if not t.isTemporary and rx.match(t.name)]
    for n in names:
        spark.sql(f"DROP TABLE `{n}`")
    return names


def task_collection(task: DataFrame) -> DataFrame:
    """SK09: payload of task vectors: title and description cut to 500 characters."""
    m = F.struct(F.col("name").alias("task_name"), F.substring(F.coalesce("title", F.lit("")), 1, 500).alias("title"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"), (F.coalesce("comments", F.lit("")) != "").alias("has_comments"))
    return task.select("id", F.col("name").alias("path"), F.lit("task").alias("type"), m.alias("metadata"))


def collection_info(vectors: DataFrame, by: str = "type") -> DataFrame:
    """SK10, Q09: number of vectors and their lengths for each collection."""
    return vectors.groupBy(by).agg(F.count("*").alias("n"), F.count("vector").alias("vectors"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim"))


def backup(df: DataFrame, folder: str, by: str) -> None:
    """SK11: JSON lines in a folder for each collection."""
    df.write.mode("overwrite").partitionBy(by).json(folder)


def restore(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def missing_variants(axes: dict[str, list[str]], done: DataFrame) -> DataFrame:
    """SK13, S05, S02: combinations of the axes' values that done does not hold. Axes are a few values each."""
    spark = done.sparkSession
    out = None
    for a, values in axes.items():
        d = spark.createDataFrame([(v,) for v in values], f"{a} string")
        out = d if out is None else out.crossJoin(F.broadcast(d))
    return out.join(done.select(*axes), list(axes), "left_anti")


def write_results(df: DataFrame, folder: str, by: str | None = None, kind: str = "csv") -> None:
    """SK14: results as CSV with header or JSON, whole or by one column's values."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).format(kind).save(folder)
