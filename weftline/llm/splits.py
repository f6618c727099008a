"""Splits that keep related records together.

Records of one task or one commit, directly or through other tasks and commits, form a component and share a split. Components
of one size and label profile (what they hold, and the years of their first commit) are interchangeable, so they are bundled. Bundles
of one size are the sources of a min-cost flow whose unit is a component: to the splits, up to what each split still lacks in all and of each
label, with costs for every row of deviation. Flows in whole units are whole, so sizes are solved one after another, the largest
first, and what rounding to components leaves is a deviation that smaller sizes make up. Members are taken by hash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import commit_time, resolve_commits, sha_text, task_key
from weftline.operators.components import connected_components
from weftline.operators.ranking import exact_rank
from weftline.runtime import stage

#: Cost of a row above a split's quota of all rows, of one above its quota of a label's rows, and of a component above its share of a bundle.
OVER_TOTAL, OVER_LABEL, OVER_BUNDLE = 1_000_000, 1000, 30
#: A quota is filled in so many steps of rising cost, so that splits that cannot all be filled are filled alike.
STEPS = 20
#: Years of first commits that one label spans.
YEARS = 5


def link_records(raw: DataFrame) -> DataFrame:
    """(id, task_key, commit, commit_time) of raw with canonical task, commit and date; null where a value names none. raw is read once."""
    r = raw.select("id", sha_text(F.col("sha")).alias("sha"), task_key(F.col("task_name")).alias("task_key"), commit_time(F.col("cmt_date"), F.col("created_at")).alias("commit_time"))
    return resolve_commits(stage(r, "canonical"), "sha", "commit").drop("sha")


def tie_tasks(links: DataFrame) -> DataFrame:
    """(node, component) of the tasks that share commits with other tasks, directly or not; component is the smallest name.

    Every commit ties its tasks to the smallest of them, so a commit or task with a third of all rows gives no more edges
    than it has distinct partners. Rows without task or without commit tie nothing.
    """
    e = links.where("task_key is not null and commit is not null").select("task_key", "commit").distinct()
    low = e.groupBy("commit").agg(F.min("task_key").alias("low"), F.count("*").alias("n")).where("n > 1")
    return connected_components(e.join(low, "commit").where("task_key <> low").select("task_key", "low").distinct(), "task_key", "low")


def assign_groups(links: DataFrame, ties: DataFrame) -> DataFrame:
    """Adds group_key: 'T:' and the smallest task name of the component, 'C:' and a commit with no task, or 'R:' and the row id."""
    t = links.join(ties, links.task_key == ties.node, "left").withColumn("root", F.coalesce("component", "task_key")).drop("node", "component")
    # a row without task follows its commit's tasks, which are tied to each other
    via = t.where("root is not null and commit is not null").groupBy(F.col("commit").alias("c")).agg(F.min("root").alias("via"))
    g = t.join(via, t.commit == via.c, "left").drop("c")
    root = F.coalesce("root", "via")
    return g.withColumn(
        "group_key",
        F.when(root.isNotNull(), F.concat(F.lit("T:"), root)).when(F.col("commit").isNotNull(), F.concat(F.lit("C:"), F.col("commit"))).otherwise(F.concat(F.lit("R:"), F.coalesce(F.col("id").cast("string"), F.lit("")))),
    ).drop("root", "via")


class _Flow:
    """Successive shortest paths with Dijkstra and potentials, on integral capacities and costs."""

    def __init__(self, n: int) -> None:
        self.g: list[list[list[int]]] = [[] for _ in range(n)]

    def arc(self, u: int, v: int, cap: int, cost: int) -> list[int]:
        a = [v, cap, cost, len(self.g[v])]
        self.g[u].append(a)
        self.g[v].append([u, 0, -cost, len(self.g[u]) - 1])
        return a

    def run(self, s: int, t: int) -> None:
        pot = [0] * len(self.g)
        while True:
            dist, prev = {s: 0}, {}
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for i, (v, cap, cost, _) in enumerate(self.g[u]):
                    if cap > 0 and (nd := d + cost + pot[u] - pot[v]) < dist.get(v, 1 << 62):
                        dist[v], prev[v] = nd, (u, i)
                        heapq.heappush(heap, (nd, v))
            if t not in dist:
                return
            far = max(dist.values())
            for v in range(len(pot)):
                pot[v] += dist.get(v, far)
            push, v = 1 << 62, t
            while v != s:
                u, i = prev[v]
                push, v = min(push, self.g[u][i][1]), u
            v = t
            while v != s:
                u, i = prev[v]
                a = self.g[u][i]
                a[1] -= push
                self.g[v][a[3]][1] += push
                v = u


def plan_bundles(bundles: list[tuple[int, str, int]], plan: list[tuple[str, float]]) -> dict[tuple[int, str], list[int]]:
    """(size, label) -> how many of the bundle's components each split of plan gets. bundles: (size, label, components).

    Bundles are at most the square root of twice the rows for each label, and labels some dozens, so this runs on the driver however many
    rows there are; the network of one size has a node for each of its bundles, each of its labels and split, and each split.
    """
    total = sum(s * n for s, _, n in bundles)
    out = {(s, lab): [0] * len(plan) for s, lab, _ in bundles}
    if not total or not plan:
        return out
    whole = sum(Fraction(w).limit_denominator(10**6) for _, w in plan)
    share = [Fraction(w).limit_denominator(10**6) / whole for _, w in plan]
    m, left = len(plan), _apportion(total, share)
    rows, by_size = defaultdict(int), defaultdict(list)
    for s, lab, n in bundles:
        rows[lab] += s * n
        by_size[s].append((lab, n))
    lab_left = {lab: _apportion(n, share) for lab, n in rows.items()}
    for size in sorted(by_size, reverse=True):
        own = sorted(by_size[size])
        count = sum(n for _, n in own)
        f = _Flow(2 + len(own) * (1 + m) + m)
        split = lambda k: 2 + len(own) * (1 + m) + k  # noqa: B023,E731
        arcs = {}
        for i, (lab, n) in enumerate(own):
            bundle = 2 + i * (1 + m)
            f.arc(0, bundle, n, 0)
            for k, w in enumerate(_apportion(n, share)):
                arcs[lab, k] = [f.arc(bundle, bundle + 1 + k, w, 0), f.arc(bundle, bundle + 1 + k, n, OVER_BUNDLE)]
                for cap, over in _units(lab_left[lab][k], size, n):
                    f.arc(bundle + 1 + k, split(k), cap, over * OVER_LABEL)
        for k in range(m):
            for cap, over in _units(left[k], size, count):
                if over:
                    f.arc(split(k), 1, cap, over * OVER_TOTAL)
                else:
                    for j in range(STEPS):
                        f.arc(split(k), 1, cap * (j + 1) // STEPS - cap * j // STEPS, j)
        f.run(0, 1)
        for (lab, k), two in arcs.items():
            got = sum(f.g[a[0]][a[3]][1] for a in two)
            out[size, lab][k] = got
            left[k] -= size * got
            lab_left[lab][k] -= size * got
    return out


def _units(left: int, size: int, n: int) -> list[tuple[int, int]]:
    """(components, rows beyond the quota for each) in the order of cost, when `left` rows are lacking: those that fit, the one that fits in part, the others."""
    fit = max(0, left) // size
    part = max(0, left) - fit * size
    return [(fit, 0), (1 if part else 0, size - part), (n, size)]


def _apportion(n: int, share: list[Fraction]) -> list[int]:
    q = [int(n * s) for s in share]
    for k in sorted(range(len(share)), key=lambda k: (q[k] - n * share[k], k))[: n - sum(q)]:
        q[k] += 1
    return q


def split_records(raw: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per row of raw: (id, task_key, commit, commit_time, group_key, split).

    Shares of rows of plan (split, share; its few rows are read to the driver, rows with a null or non-positive share are ignored) are
    met as nearly as whole components allow. A label is what the component holds (tasks, a commit alone or a row alone) and the years of its first
    readable commit. Null and unreadable values tie nothing, but rows with neither id, task nor commit are one group. Repeated rows stay rows of
    their own. An empty table gives an empty result; an empty plan gives null splits.
    """
    links = stage(link_records(raw), "links")
    grouped = stage(assign_groups(links, stage(tie_tasks(links), "ties")), "grouped")
    years = F.coalesce(F.floor(F.year(F.min("commit_time")) / YEARS).cast("string"), F.lit("-"))
    comps = stage(grouped.groupBy("group_key").agg(F.count("*").alias("size"), F.concat_ws(":", F.substring("group_key", 1, 1), years).alias("label")), "comps")
    bundles = [(r["size"], r.label, r.n) for r in comps.groupBy("size", "label").agg(F.count("*").alias("n")).collect()]
    wanted = [(r["split"], r.share) for r in plan.where("split is not null and share > 0").orderBy("split").collect()]
    counts = plan_bundles(bundles, wanted)
    rows, schema = [], "size long, label string, split string, lo long, hi long"
    for (size, lab), per in counts.items():
        at = 0
        for (name, _), n in zip(wanted, per):
            if n:
                rows.append((size, lab, name, at, at + n))
                at += n
    cut = raw.sparkSession.createDataFrame(rows, schema)
    if len(rows) <= 100_000:  # splits x labels x the square root of twice the rows
        cut = F.broadcast(cut)
    ranked = exact_rank(comps, ["size", "label"], F.col("group_key"), "rank", 256).alias("c")
    got = ranked.join(cut.alias("p"), (F.col("c.size") == F.col("p.size")) & (F.col("c.label") == F.col("p.label")) & (F.col("c.rank") >= F.col("p.lo")) & (F.col("c.rank") < F.col("p.hi")), "left")
    got = got.select(F.col("c.group_key").alias("gk"), "split")
    return grouped.join(got, grouped.group_key == got.gk, "left").select("id", "task_key", "commit", "commit_time", "group_key", "split")


def split_report(assigned: DataFrame, plan: DataFrame) -> DataFrame:
    """(split, rows, share, wanted, groups, first_commit, last_commit) of each split that got rows, with readable dates only."""
    a = assigned.groupBy("split", "group_key").agg(F.count("*").alias("n"), F.min("commit_time").alias("a"), F.max("commit_time").alias("b"))
    s = a.groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.min("a").alias("first_commit"), F.max("b").alias("last_commit"))
    total = s.agg(F.sum("rows").alias("total"))
    return s.join(F.broadcast(total)).join(F.broadcast(plan.groupBy("split").agg(F.max("share").alias("wanted"))), "split", "left").select(
        "split", "rows", (F.col("rows") / F.col("total")).alias("share"), "wanted", "groups", "first_commit", "last_commit"
    )


def tied_tasks(assigned: DataFrame) -> DataFrame:
    """(task_name, group_name) of every task that shares a commit, directly or through others, with another task, from records that have got
    their splits (of split_records): tasks of one group, named after the smallest of them."""
    t = assigned.where("task_key is not null and split is not null").select(F.col("task_key").alias("task_name"), F.substring("group_key", 3, 1 << 30).alias("group_name")).distinct()
    tied = t.where("task_name <> group_name").select("group_name").distinct()
    return t.join(tied, "group_name", "left_semi").select("task_name", "group_name")
