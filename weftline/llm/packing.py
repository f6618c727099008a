"""Filling fixed-capacity containers by best-fit decreasing.

Items of one size are interchangeable, so the packing is planned over the histogram of sizes (never more rows than the capacity):
open containers are kept by remaining capacity as ranges of container numbers, a segment tree finds the tightest capacity that
holds the next size, and whole ranges are filled at once. Items then take the planned places by their exact rank in their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import exact_rank
from weftline.runtime import stage


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; answers which is the smallest of at least s that has open containers."""

    def __init__(self, capacity: int) -> None:
        self.n = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.n)

    def set(self, r: int, open_: bool) -> None:
        i = self.n + r
        self.open[i] = open_
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, s: int) -> int | None:
        i = self.n + s
        if self.open[i]:
            return s
        while i > 1:  # up to the first right sibling that has any, then down its leftmost open path
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan_packing(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of sizes[s] items of each size s: the placements and the number of containers.

    A placement (size, lo, hi, first, per) puts the items ranked lo..hi-1 of a size, per to a container, from container first on.
    A range's remaining capacity falls by more than half whenever it is used up, and each size adds two ranges at most, so there
    are at most 2 * capacity * log2(capacity) placements, about 45,000 for 2,048, whatever the number of items.
    """
    tree, ranges = CapacityTree(capacity), {r: [] for r in range(capacity + 1)}
    out, used = [], 0

    def add(r: int, first: int, n: int) -> None:
        if n and r:
            if not ranges[r]:
                tree.set(r, True)
            ranges[r].append((first, n))

    for s in sorted((s for s, n in sizes.items() if n), reverse=True):
        if not 0 < s <= capacity:
            raise ValueError(f"size {s} is outside 1..{capacity}")
        at, n = 0, sizes[s]
        while at < n:
            r = tree.tightest(s)
            if r is None:
                per = capacity // s
                first, have, r = used, -(-(n - at) // per), capacity
                used += have
            else:
                first, have = ranges[r].pop()
                if not ranges[r]:
                    tree.set(r, False)
                per = r // s
            k = min(n - at, have * per)
            full, part = divmod(k, per)
            out.append((s, at, at + k, first, per))
            add(r - per * s, first, full)
            if part:
                add(r - part * s, first + full, 1)
            add(r, first + full + bool(part), have - full - bool(part))
            at += k
    return out, used


def pack(items: DataFrame, id: str, size: str, capacity: int = 2048) -> DataFrame:
    """(id, piece_no, n_tokens, container) of every piece of every item.

    An item of at most the capacity is one piece, number 0. A larger one fills pieces of the capacity in order, the rest being its last
    piece. Items of null, zero or negative size take no space and have no row. Ids should be unique; repeated ids are packed
    like different items. An empty table gives an empty result.
    """
    kind = items.schema[id].dataType.simpleString()
    n = F.col(size).cast("long")
    p = items.where(n > 0).select(F.col(id), n.alias("_n"), F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).alias("piece_no"))
    p = p.select(id, "piece_no", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece_no").cast("long") * capacity).cast("int").alias("n_tokens"))
    p = stage(p, "pieces")
    sizes = {r.n_tokens: r.n for r in p.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places, _ = plan_packing(sizes, capacity)
    ranked = exact_rank(p, ["n_tokens"], F.struct(F.col(id), F.col("piece_no")), "rank")
    a = np.array(sorted(places), np.int64).reshape(-1, 5)  # at most 2 * capacity * log2(capacity) rows
    shared = p.sparkSession.sparkContext.broadcast(a)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        key = a[:, 0] << 40 | a[:, 1]
        for b in batches:
            s, r = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            k = np.searchsorted(key, s << 40 | r, "right") - 1
            to = a[k, 3] + (r - a[k, 1]) // a[k, 4]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(to)], [id, "piece_no", "n_tokens", "container"])

    return ranked.select(id, "piece_no", "n_tokens", "rank").mapInArrow(place, f"{id} {kind}, piece_no int, n_tokens int, container long")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: pieces, tokens, containers, the fewest containers that could hold the tokens, and the share of space unused."""
    c = packed.groupBy("container").agg(F.count("*").alias("p"), F.sum("n_tokens").alias("t"))
    s = c.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"), F.max("t").alias("fullest"))
    return s.withColumn("least", F.ceil(F.col("tokens") / capacity)).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * capacity))
