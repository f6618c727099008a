"""Exact ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_rank(df: DataFrame, group: list[str], key: Column, out: str = "rank", buckets: int = 1024) -> DataFrame:
    """Adds 0-based ranks by hash of key inside each group, with no task that holds a whole group.

    Rows go to buckets by the hash of the (unique) key; bucket counts give each bucket's offset, and only rows of one group
    and bucket are ordered together. A group with a third of N rows thus costs windows of N / (3 * buckets) rows.
    Rows of equal key get different ranks in unspecified order. An empty input gives an empty result.
    """
    h = df.withColumn("_h", F.xxhash64(key)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))
    counts = h.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rn = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    ranked = h.withColumn("_r", rn - 1)
    g2 = [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    on = F.col("r._b") == F.col("o._b")
    for c in g2:
        on = on & c
    return ranked.alias("r").join(offset.alias("o"), on).select("r.*", (F.col("r._r") + F.col("o._o")).alias(out)).drop("_h", "_b", "_r")


#: Rows of a range, about; keys read for each range to find its cut points; ranges at most (so their offsets stay small).
RANGE, PROBES, RANGES = 250_000, 32, 4096


def cut_points(df: DataFrame, order: str, per: int = RANGE) -> list:
    """Values of order that cut df into ranges of about `per` rows, at most RANGES of them.

    They are read from the keys of the smallest hashes (PROBES for each range), once and for all: whatever is ranged by them
    later is ranged alike. Nulls are no cut points.
    """
    keys = df.select(F.col(order).alias("k"))
    parts = min(RANGES, -(-keys.count() // per))
    if parts < 2:
        return []
    probe = sorted(r.k for r in keys.where("k is not null").orderBy(F.xxhash64("k"), "k").limit(parts * PROBES).collect())
    return sorted(set(probe[i * len(probe) // parts] for i in range(1, parts))) if probe else []


def range_of(key: Column, cuts: list, kind: str) -> Column:
    """How many of the sorted cuts are at most key, by bisection; 0 for null."""
    if not cuts:
        return F.lit(0)
    a = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, b: F.when(F.get(a, at + b - 1) <= key, at + b).otherwise(at))


def ordered_rank(df: DataFrame, group: list[str], order: str, out: str = "rank", total: str | None = None, per: int = RANGE) -> DataFrame:
    """Adds 1-based positions by order inside each group (order is unique there, nulls first), and the group's rows as `total`.

    Rows are dealt to ranges by cut points fixed beforehand, the rows of each group and range are counted, and only rows of one group
    and range are ordered together, so no task holds a group. An empty input gives an empty result.
    """
    kind = df.schema[order].dataType.simpleString()
    r = df.withColumn("_p", range_of(F.col(order), cut_points(df, order, per), kind))
    counts = r.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_n").over(Window.partitionBy(*group))
    off = counts.select(*group, "_p", F.coalesce(before, F.lit(0)).alias("_o"), whole.alias("_t"))
    n = r.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(order)))
    on = F.col("r._p") == F.col("o._p")
    for c in group:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    # without groups there is an offset for each of at most RANGES ranges
    j = n.alias("r").join((off if group else F.broadcast(off)).alias("o"), on)
    cols = [F.col(f"r.{c}") for c in df.columns] + [(F.col("r._r") + F.col("o._o")).alias(out)]
    return j.select(*cols, *([F.col("o._t").alias(total)] if total else []))
