"""Items that appear together, with how surprising it is.

Counts of common baskets are exact. What they are set against is a bipartite configuration null, fitted so that every item
keeps its expected number of baskets and every basket its expected size; a pair's count is then Poisson-binomial, its upper tail
is the p-value, and Benjamini-Hochberg over all pairs gives q.

With `least` 1 every pair is listed. With `least` 2 those that meet in one heavy basket and nowhere else are not, since a basket of a third of
all rows has more of them than anything can hold: the basket's members stand for them, and a table by the members' frequencies gives their lift and surprise.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.terms import pairs_in_groups
from weftline.runtime import cores, stage

#: Baskets with more frequent items than this are heavy.
HEAVY = 100
#: Heavy baskets in one list of an item; longer lists are cut.
CHUNK = 4096
#: Classes of the null: frequencies up to FINE one by one, beyond it by steps of this ratio.
FINE, STEP = 128, 1.01
#: Largest baskets whose part of a tail is convolved one by one.
LARGE = 256


@dataclass
class Study:
    """pairs (l, r, common, n_l, n_r, n_baskets, lift, expected, log10_p, log10_q); members (basket, item, n, size) of heavy baskets, and
    once (n_l, n_r, pairs, n_baskets, lift, expected, log10_p, log10_q): of two members that pairs doesn't list, which meet in that basket only."""

    pairs: DataFrame
    members: DataFrame
    once: DataFrame


@dataclass
class _Counted:
    pairs: DataFrame
    items: DataFrame
    heavy: DataFrame
    inc: DataFrame
    baskets: DataFrame
    shift: int


def count_pairs(inc: DataFrame, item: str, basket: str, least: int = 5, max_share: float | None = None, heavy: int = HEAVY, also: DataFrame | None = None) -> _Counted:
    """pairs (l, r, common, deep, note) of item ids, l < r as ids, with at least `least` common baskets, deep of them heavy; items (item, iid, n).

    Rows with a null item or basket are ignored, repeated rows count once. Items in fewer than `least` baskets, or in more than
    max_share of all, take part in no pair. With `least` 2, pairs with one common basket come out too unless that is a heavy one; with `least` 1 or 2, every pair of
    also (l, r: items, note: a number) whose two items have a basket, even if they never meet; it keeps its note.

    Two items with `least` common baskets still share one if each leaves out the least - 1 of its heavy baskets that come first in one order
    of all baskets (largest first): the last of their common ones is left out by neither. That empties baskets that hold a third of all
    rows. What is left is paired tile by tile to find candidates, whose heavy baskets are then counted from the items' own lists. Light
    baskets list at most heavy^2 / 2 pairs, which are added up before the shuffle.
    """
    inc = stage(inc.select(F.col(item).alias("item"), F.col(basket).alias("basket")).where("item is not null and basket is not null").distinct(), "inc")
    baskets = stage(inc.groupBy("basket").agg(F.count("*").alias("size")), "baskets")
    items = stage(inc.groupBy("item").agg(F.count("*").alias("n")).withColumn("mid", F.monotonically_increasing_id()), "items")
    # the id of an item begins with its frequency, so whoever has the id needs no join for that
    part, place = F.shiftright("mid", 33), F.col("mid").bitwiseAND((1 << 33) - 1)
    most = items.agg(F.max(place).alias("i"), F.max(part).alias("p"), F.max("n").alias("n")).first()
    low = (most.i or 0).bit_length()
    shift = low + (most.p or 0).bit_length()
    if shift + (most.n or 0).bit_length() > 63:
        raise ValueError("more items than ids can number")
    items = items.select("item", "n", F.shiftleft("n", shift).bitwiseOR(F.shiftleft(part, low)).bitwiseOR(place).alias("iid"))
    some = items.where(F.col("n") >= (least if least > 2 else 1))
    if max_share is not None:
        some = some.where(F.col("n") <= max_share * baskets.count())
    x = inc.join(some.select("item", "iid"), "item").select("iid", F.struct(F.xxhash64("basket"), F.hash("basket")).alias("b"))
    x = stage(x, "x")  # 96 bits of the basket's name
    big = stage(x.groupBy("b").agg(F.count("*").alias("s")).where(F.col("s") > heavy).withColumn("hid", F.monotonically_increasing_id()), "big")
    hv = stage(x.join(big, "b").select("iid", "hid", "s"), "heavy")
    light = x.join(big, "b", "left_anti").groupBy("b").agg(F.sort_array(F.collect_list("iid")).alias("g"))
    two = light.where(F.size("g") > 1).select(
        F.explode(F.expr("flatten(transform(sequence(1, size(g) - 1), i -> transform(slice(g, i + 1, size(g)), y -> struct(element_at(g, i) as l, y as r))))")).alias("p")
    )
    cand = two.select("p.l", "p.r", F.lit(1).alias("c"))
    first = F.row_number().over(Window.partitionBy("iid").orderBy(F.col("s").desc(), "hid"))
    left_out = hv.withColumn("k", first).where(F.col("k") <= least - 1).select("iid", "hid")
    kept = hv.join(left_out, ["iid", "hid"], "left_anti").select(F.col("hid").alias("g"), F.col("iid").alias("i"))
    cand = cand.unionByName(pairs_in_groups(kept, 1000).select("l", "r", F.lit(0).alias("c")))
    note = F.lit(None).cast("long")
    if also is not None:
        a, b = (items.select(F.col("item").alias(c), F.col("iid").alias(f"i{c}")) for c in ("l", "r"))
        w = also.select("l", "r", "note").join(a, "l").join(b, "r").where("il <> ir").select(F.least("il", "ir").alias("l"), F.greatest("il", "ir").alias("r"), F.lit(0).alias("c"), F.col("note").cast("long"))
        cand, note = cand.withColumn("note", note).unionByName(w), F.max("note")
    cand = cand.groupBy("l", "r").agg(F.sum("c").alias("c"), note.alias("note"))
    n_big = big.count()
    chunks = max(1, -(-n_big // CHUNK))
    lists = hv.groupBy("iid", F.pmod(F.xxhash64("hid"), F.lit(chunks)).alias("ck")).agg(F.collect_list("hid").alias("hb"))
    side = lambda c: lists.select(F.col("iid").alias(c), F.col("hb").alias(f"{c}b"), "ck")
    if not n_big:
        j = cand.withColumn("deep", F.lit(0))
    elif chunks == 1:
        j = cand.join(_small(side("l").drop("ck"), hv), "l", "left").join(_small(side("r").drop("ck"), hv), "r", "left")
        j = j.withColumn("deep", F.when(F.col("lb").isNotNull() & F.col("rb").isNotNull(), F.size(F.array_intersect("lb", "rb"))).otherwise(0))
    else:  # the chunks of the side that has fewer meet those of the other one by one, so a hot item's list is in no one cell
        cand = stage(cand, "candidates")
        deg = hv.groupBy("iid").agg(F.count("*").alias("h"))
        o = cand.join(deg.withColumnsRenamed({"iid": "l", "h": "hl"}), "l").join(deg.withColumnsRenamed({"iid": "r", "h": "hr"}), "r")
        swap = F.col("hl") <= F.col("hr")
        o = o.select("l", "r", F.when(swap, F.col("l")).otherwise(F.col("r")).alias("a"), F.when(swap, F.col("r")).otherwise(F.col("l")).alias("b"))
        m = o.join(side("a"), "a").join(side("b"), ["b", "ck"]).groupBy("l", "r").agg(F.sum(F.size(F.array_intersect("ab", "bb"))).alias("deep"))
        j = cand.join(m, ["l", "r"], "left").withColumn("deep", F.coalesce("deep", F.lit(0)))
    pairs = j.select("l", "r", (F.col("c") + F.col("deep")).alias("common"), F.col("deep").cast("long").alias("deep"), "note")
    pairs = pairs.where((F.col("common") >= (least if least > 2 else 1)) | F.col("note").isNotNull())
    return _Counted(pairs, items, hv, inc, baskets, shift)


def _small(lists: DataFrame, hv: DataFrame) -> DataFrame:
    """Sent to all if it is small."""
    return F.broadcast(lists) if hv.count() <= 500_000 else lists


def _class(k: Column) -> Column:
    return F.when(k <= FINE, k).otherwise(FINE + F.ceil(F.log(k / FINE) / float(np.log(STEP)))).cast("int")


def histogram(df: DataFrame, k: str) -> list[tuple[float, int]]:
    """(mean frequency, number) of each class; a class spans a hundredth of its frequency at most, so there are some 2,000 for a billion."""
    return [(r.k, r.n) for r in df.groupBy(_class(F.col(k)).alias("c")).agg(F.avg(k).alias("k"), F.count("*").alias("n")).orderBy("c").collect()]


class Null:
    """Bipartite configuration model over classes of items by frequency and of baskets by size, of which there are some thousands
    however large the data are. Items get the weight that keeps their own frequency exactly, given the baskets' weights."""

    def __init__(self, degrees: list[tuple[float, int]], sizes: list[tuple[float, int]], rounds: int = 5000, tol: float = 1e-6) -> None:
        d, m = np.array([k for k, _ in degrees], float), np.array([n for _, n in degrees], float)
        s, self.n = np.array([k for k, _ in sizes], float), np.array([n for _, n in sizes], float)
        self.baskets = self.n.sum()
        rows = max(1.0, (d * m).sum())
        x, y = d / np.sqrt(rows), s / np.sqrt(rows)
        off = 0.0
        for _ in range(rounds if len(d) and len(s) else 0):
            x = d / ((self.n * y) / (1 + np.outer(x, y))).sum(1)
            w = (m * x)[:, None] / (1 + np.outer(x, y))
            y1 = s / w.sum(0)
            off = np.abs(y * w.sum(0) / s - 1).max()  # by how much the expected sizes are off, frequencies being met
            y = y1
            if off < tol:
                break
        if off > 1e-3:
            warnings.warn(f"the null's expected basket sizes are still off by {off:.1e} of themselves")
        self.y = y

    def probabilities(self, d: np.ndarray) -> np.ndarray:
        """Of items of each frequency, the probability to be in a basket of each class: the weight that gives the frequency, by safeguarded Newton."""
        d = np.minimum(d.astype(float), self.baskets * (1 - 1e-9))
        lo, hi = np.full(len(d), -60.0), np.full(len(d), 60.0)
        t = np.log(np.maximum(d, 1e-300) / max(1e-300, (self.n * self.y).sum()))
        for _ in range(200):
            p = np.exp(t)[:, None] * self.y
            p = p / (1 + p)
            g = (p * self.n).sum(1) - d
            if (np.abs(g) <= 1e-12 * np.maximum(d, 1e-300)).all():
                break
            hi, lo = np.where(g > 0, t, hi), np.where(g > 0, lo, t)
            new = t - g / np.maximum((p * (1 - p) * self.n).sum(1), 1e-300)
            t = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        p = np.exp(t)[:, None] * self.y
        return np.where(d[:, None] > 0, p / (1 + p), 0.0)


def upper_tail(q: np.ndarray, n: np.ndarray, c: int) -> float:
    """log10 of P(X >= c) for X the sum of n[i] Bernoulli(q[i]): exact terms of the tilted distribution around c, by its
    characteristic function, so that neither underflow nor cancellation touches far tails."""
    total, mean = n.sum(), (n * q).sum()
    if c <= 0:
        return 0.0
    if c > total or mean <= 0:
        return -np.inf
    t = 0.0
    if c > mean:  # tilt the mean to c by Newton in the log-odds
        lo, hi = 0.0, 60.0
        t = min(np.log(c / mean), 50.0)
        for _ in range(100):
            w = q * np.exp(t) / (1 - q + q * np.exp(t))
            g = (n * w).sum() - c
            if abs(g) < 1e-9 * c or hi - lo < 1e-12:
                break
            if g > 0:
                hi = t
            else:
                lo = t
            step = t - g / max((n * w * (1 - w)).sum(), 1e-300)
            t = step if lo < step < hi and abs(step - t) < (hi - lo) / 2 else (lo + hi) / 2
    w = q * np.exp(t) / (1 - q + q * np.exp(t))
    k = (n * np.log1p(q * np.expm1(t))).sum()
    sd = np.sqrt((n * w * (1 - w)).sum())
    size = int(2 ** np.ceil(np.log2(16 * sd + 40)))
    z = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    phi = np.exp((n * np.log(1 - w + w * z[:, None])).sum(1))
    base = int(round((n * w).sum())) - size // 2
    pm = np.fft.irfft(phi * np.exp(2j * np.pi * np.arange(size // 2 + 1) * base / size), size)
    at = base + np.arange(size)
    use = (at >= c) & (at <= total)
    tail = (np.maximum(pm[use], 0) * np.exp(-t * (at[use] - c))).sum()
    return float(min(0.0, (np.log(max(tail, 1e-300)) + k - t * c) / np.log(10)))


def upper_tails(q: np.ndarray, n: np.ndarray, which: np.ndarray, c: np.ndarray) -> np.ndarray:
    """upper_tail of each (row of q, c), for all rows at once. The largest baskets (the last classes) are convolved one by one; of the many
    others' sum, terms follow from its power sums: k P(k) = P(k-1) T1 - P(k-2) T2 + ..., Ti being the sum of n (q / (1 - q))^i. That keeps
    its digits where no few baskets make up the sum; rows where they do, and far counts, go by upper_tail one by one."""
    out = np.zeros(len(c))
    mean = q @ n
    split = len(n) - int(np.searchsorted(np.cumsum(n[::-1]), LARGE, "right"))
    r = q[:, :split] / (1 - q[:, :split])
    t, power = [], np.ones_like(r)
    for _ in range(12):
        power = power * r
        t.append(power @ n[:split])
    with np.errstate(divide="ignore", invalid="ignore"):
        few = np.where(t[0] > 0, t[1] / t[0] ** 2, 0.0) if len(t[0]) else np.zeros(0)
    own = (c > 0) & (c <= 200) & (mean[which] > 0) & (mean[which] <= 200) & (few[which] * c <= 0.1)
    rows = np.unique(which[own])
    if len(rows):
        top = int(c[own].max() + 40 + 10 * np.sqrt(mean[rows].max()))
        p = np.zeros((top + 1, len(rows)))
        p[0] = np.exp(np.log1p(-q[rows][:, :split]) @ n[:split])
        for k in range(1, top + 1):
            p[k] = np.maximum(0, sum((-1) ** (i + 1) * t[i - 1][rows] * p[k - i] for i in range(1, min(k, len(t)) + 1)) / k)
        for j in range(split, len(n)):
            x = q[rows, j]
            for _ in range(int(n[j])):
                p[1:] = p[1:] * (1 - x) + p[:-1] * x
                p[0] *= 1 - x
        at, k = np.searchsorted(rows, which[own]), c[own].astype(int)
        tail, head = np.cumsum(p[::-1], 0)[::-1], np.cumsum(p, 0)
        with np.errstate(divide="ignore"):
            out[own] = np.log10(np.where(k >= mean[which[own]], tail[k, at], 1 - head[k - 1, at]))
    own &= np.isfinite(out) & (out > -250)
    for i in np.flatnonzero(~own & (c > 0)):
        out[i] = upper_tail(q[which[i]], n, int(c[i]))
    return np.minimum(out, 0.0)


def _score(kinds: DataFrame, null: Null, least: int) -> DataFrame:
    """Adds expected and log10_p to kinds (a, b, common, m): frequencies a <= b. With least, p is that of the count given that it is least or more."""
    shared = kinds.sparkSession.sparkContext.broadcast(null)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        null = shared.value
        for b in batches:
            b = b.reset_index(drop=True)
            pair, which = np.unique(np.stack([b.a, b.b], 1), axis=0, return_inverse=True)
            which = which.reshape(-1)
            out, mean = np.zeros(len(b)), np.zeros(len(b))
            u = np.unique(pair)
            pu = null.probabilities(u)  # an item without any basket meets nothing
            for z in range(0, len(pair), 512):
                own = (which >= z) & (which < z + 512)
                q = pu[np.searchsorted(u, pair[z : z + 512, 0])] * pu[np.searchsorted(u, pair[z : z + 512, 1])]
                w, c = which[own] - z, b.common.to_numpy()[own]
                mean[own] = (q @ null.n)[w]
                out[own] = upper_tails(q, null.n, w, c)
                if least:
                    out[own] -= upper_tails(q, null.n, w, np.full(len(w), least))
            yield b.assign(expected=mean, log10_p=np.minimum(out, 0.0))

    k = kinds.repartition(2 * cores(kinds.sparkSession), "a", "b")
    return stage(k.mapInPandas(run, "a long, b long, common long, m long, expected double, log10_p double"), "tails")


def surprise(kinds: DataFrame, null: Null, tests: int, least: int = 0) -> DataFrame:
    """kinds with expected, log10_p and log10_q: Benjamini-Hochberg over `tests` pairs, of which m are of each kind and all others have p 1.

    p is rounded up to a thousandth of its logarithm, beyond 1e-320 to a thousandth of that logarithm itself, so steps are some
    300,000 at most and one window suffices for them.
    """
    k = _score(kinds, null, least)
    lp = F.col("log10_p")
    step = F.when(lp >= -320, F.ceil(lp * 1000)).otherwise(-(320_000 + F.floor(F.log(-lp / 320) * 1000))).cast("long")
    value = F.when(F.col("step") >= -320_000, F.col("step") / 1000).otherwise(-320 * F.exp((-F.col("step") - 320_000) / 1000))
    per = k.groupBy(step.alias("step")).agg(F.sum("m").alias("m"))
    raw = value + F.log10(F.lit(float(max(1, tests)))) - F.log10(F.sum("m").over(Window.orderBy("step")))
    per = per.withColumn("raw", raw).select("step", F.least(F.lit(0.0), F.min("raw").over(Window.orderBy(F.col("step").desc()))).alias("log10_q"))
    return k.withColumn("step", step).join(F.broadcast(per), "step").drop("step")


def study(inc: DataFrame, item: str, basket: str, least: int = 2, max_share: float | None = None, also: DataFrame | None = None, heavy: int = HEAVY) -> Study:
    """Pairs of items with at least `least` common baskets, l < r by code points; lift is common * n_baskets / (n_l * n_r).

    With `least` 1 every pair that meets is listed, and once is empty. With `least` 2 pairs with one common basket are listed too, but for those whose only one is heavy, which
    members and once hold. In both q is over all n (n - 1) / 2 pairs of items. also (l, r, note), l and r distinct, l < r: pairs that come out even if they never
    meet, with common 0, and with their note (null for other pairs); an item without any basket has n 0, and its pairs no lift. With a greater `least`, p and q are given
    that a pair meets so often, over the pairs that do. An empty table gives empty results.
    """
    if also is not None and (least > 2 or max_share is not None):
        raise ValueError("pairs that are not counted would come out as never met")
    got = count_pairs(inc, item, basket, least, max_share, heavy, also)
    items = got.items
    null = Null(histogram(items, "n"), histogram(got.baskets, "size"))
    n_baskets, n_items = got.baskets.count(), items.count()
    freq = lambda c: F.shiftright(c, got.shift)
    p = stage(got.pairs, "pairs").withColumns({"a": F.least(freq("l"), freq("r")), "b": F.greatest(freq("l"), freq("r"))})
    kinds = p.groupBy("a", "b", "common").agg(F.count("*").alias("m"))
    once = kinds.limit(0)
    if least == 2:
        # pairs of members by frequency, less those that are listed
        per = stage(got.heavy.groupBy("hid", freq("iid").alias("n")).agg(F.count("*").alias("m")), "frequencies")
        j = per.select("hid", F.col("n").alias("a"), F.col("m").alias("ma")).join(per.select("hid", F.col("n").alias("b"), F.col("m").alias("mb")), "hid").where("a <= b")
        every = j.groupBy("a", "b").agg(F.sum(F.when(F.col("a") == F.col("b"), F.expr("ma * (ma - 1) div 2")).otherwise(F.col("ma") * F.col("mb"))).alias("t"))
        listed = p.groupBy("a", "b").agg(F.sum("deep").alias("t"))
        once = every.unionByName(listed.withColumn("t", -F.col("t"))).groupBy("a", "b").agg(F.sum("t").alias("m")).where("m > 0").select("a", "b", F.lit(1).cast("long").alias("common"), "m")
    whole = kinds.withColumn("listed", F.lit(1)).unionByName(once.withColumn("listed", F.lit(0)))
    all_kinds = stage(whole.groupBy("a", "b", "common").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("listed")).alias("listed")), "kinds")
    tests = n_items * (n_items - 1) // 2 if least <= 2 else p.count()
    k = stage(surprise(all_kinds.select("a", "b", "common", "m"), null, tests, 0 if least <= 2 else least), "kinds")
    # names and kinds are joined to bare ids; kinds last and sent to all while they are few
    few = k.count() <= 100_000
    scored = lambda d: d.join(F.broadcast(k.drop("m")) if few else k.drop("m"), ["a", "b", "common"])
    s = p.drop("deep") if also is not None else p.drop("deep", "note")
    s = (s if few else scored(s)).join(items.select(F.col("iid").alias("r"), F.col("item").alias("y")), "r").join(items.select(F.col("iid").alias("l"), F.col("item").alias("x")), "l")
    s = scored(s) if few else s
    up = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(up, a).otherwise(b)
    nx, ny = freq("l"), freq("r")
    kept = ["note"] if also is not None else []
    pairs = s.select(
        pick(F.col("x"), F.col("y")).alias("l"), pick(F.col("y"), F.col("x")).alias("r"), "common", pick(nx, ny).alias("n_l"), pick(ny, nx).alias("n_r"), F.lit(n_baskets).alias("n_baskets"),
        (F.col("common") * n_baskets / (nx * ny)).alias("lift"), "expected", "log10_p", "log10_q", *kept,
    )
    if also is not None:
        nl, nr = (items.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}")) for c in ("l", "r"))
        z = also.select("l", "r", "note").join(nl, "l", "left").join(nr, "r", "left").where("n_l is null or n_r is null")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        nothing = F.lit(0.0)
        pairs = pairs.unionByName(z.select("l", "r", F.lit(0).cast("long").alias("common"), zero("n_l"), zero("n_r"), F.lit(n_baskets).alias("n_baskets"), F.lit(None).cast("double").alias("lift"), nothing.alias("expected"), nothing.alias("log10_p"), nothing.alias("log10_q"), F.col("note").cast("long")))
    o = k.join(all_kinds.select("a", "b", "common", (F.col("m") - F.col("listed")).alias("pairs")), ["a", "b", "common"]).where("common = 1 and pairs > 0")
    o = o.select(F.col("a").alias("n_l"), F.col("b").alias("n_r"), "pairs", F.lit(n_baskets).alias("n_baskets"), (F.lit(n_baskets) / (F.col("a") * F.col("b"))).alias("lift"), "expected", "log10_p", "log10_q")
    # the heavy baskets' names: their members are more than `heavy`, so few baskets qualify; sizes are of all items
    named = got.inc.join(got.baskets.where(F.col("size") > heavy), "basket").join(items.select("item", "n"), "item")
    return Study(pairs, named.select("basket", "item", "n", "size"), o)


def cooccurrence(inc: DataFrame, item: str, basket: str, least: int = 2, max_share: float | None = None, also: DataFrame | None = None) -> DataFrame:
    """The pairs of a study."""
    return study(inc, item, basket, least, max_share, also).pairs
