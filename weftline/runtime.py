"""Session, shared-folder tables and partitioning helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_tables: dict[str, tuple] = {}


def session(master: str = "local[8]", app: str = "weftline") -> SparkSession:
    """A local session for tests and bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name, at = os.path.basename(here), os.path.join(tempfile.mkdtemp(prefix="weftline-py-"), "weftline_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir; a local one of our own only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stage(df: DataFrame, name: str = "t", codec: str = "snappy", by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there and survives lost executors. by: a folder for each value."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/weftline-tables/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).option("compression", codec).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._weft_path = at
    _tables[at] = (weakref.ref(spark),)
    return out


def drop(*dfs: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in dfs:
        at = getattr(df, "_weft_path", None)
        if at and at in _tables:
            _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    _tables.pop(at, None)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for at, (ref,) in list(_tables.items()):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _delete(spark, at)
        except Exception:
            pass


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Hash-repartitions by keys into a multiple of the cluster's cores (at least the shuffle partitions), for stages that are heavy per row."""
    n = max(factor * cores(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(k) for k in keys])


def wide(df: DataFrame) -> DataFrame:
    """df for a stage that is heavy per row: as it is, unless a scan has fewer splits than the cluster has cores; then its rows are dealt
    round robin. So large inputs are never shuffled for a map-only operator (spark.sql.files.maxPartitionBytes sets the size of their splits)."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
