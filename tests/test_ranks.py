"""Positions, splits and pairs where the data outgrow one range, one sample or one group."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics, ranking, splits, terms


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("other"))


def test_ordinal_of_two_million(spark, many):
    r = splits.ordinal(many, "k", per=40_000)
    true = spark.range(2_000_003).select(F.col("id").alias("t")).join(many.select("k"), F.col("t") == F.col("k"), "left_anti").count()
    assert true == 3
    x = r.agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.min("rn").alias("a"), F.max("rn").alias("b")).first()
    assert tuple(x) == (2_000_000, 2_000_000, 1, 2_000_000)
    # in order: every key's position is one more than the number of smaller keys, gaps being the three missing keys
    assert r.where((F.col("rn") - 1 > F.col("k")) | (F.col("k") - F.col("rn") + 1 > 3)).count() == 0


@pytest.mark.parametrize("strategy", ["recent", "modn", "lastn", "firstn", "middlen"])
def test_splits_of_two_million(many, strategy):
    s = splits.split(many, "k", strategy, 200).where("is_test").select("k").collect()
    assert len(s) == 200
    k = sorted(r.k for r in s)
    if strategy == "firstn":
        assert k[-1] < 205
    if strategy in ("recent", "lastn"):
        assert k[0] >= 2_000_000 - 205
    if strategy == "modn":
        assert {round((b - a) / 10_000) for a, b in zip(k, k[1:])} == {1}


def test_ordered_rank_in_hot_groups(spark):
    df = spark.range(5000).select(F.concat(F.lit("x"), F.md5(F.col("id").cast("string"))).alias("k"), F.when(F.col("id") < 3500, "hot").when(F.col("id") < 4000, F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"))
    got = ranking.ordered_rank(df, ["g"], "k", "rk", "n", per=300).collect()
    per = {}
    for r in got:
        per.setdefault(r.g, []).append((r.k, r.rk, r.n))
    assert len(got) == 5000
    for v in per.values():
        assert [x[1] for x in sorted(v)] == list(range(1, len(v) + 1)) and {x[2] for x in v} == {len(v)}
    nulls = spark.createDataFrame([(None,), (3,), (1,)], "k int")
    assert sorted((r.k is not None, r.k or 0, r.rk) for r in ranking.ordered_rank(nulls, [], "k", "rk").collect()) == [(False, 0, 1), (True, 1, 2), (True, 3, 3)]
    assert ranking.ordered_rank(nulls.limit(0), [], "k").collect() == []


def test_summary_over_ranges(spark):
    rng = random.Random(3)
    v = [(g, rng.randrange(900)) for g in ["a", "b", None] for _ in range(700)]
    df = spark.createDataFrame(v, "g string, x long")

    def want(xs):
        xs = sorted(xs)
        n = len(xs)
        return n, xs[0], xs[-1], (xs[(n - 1) // 2] + xs[n // 2]) / 2, xs[n // 4], xs[3 * n // 4]

    pick = lambda r: (r.n, r.min, r.max, r.median, r.q1, r.q3)
    assert pick(metrics.summary(df, "x", per=100).first()) == want([x for _, x in v])
    got = {r.g: pick(r) for r in metrics.summary(df.where("g is not null"), "x", ["g"], per=100).collect()}
    assert got == {g: want([x for h, x in v if h == g]) for g in "ab"}


def test_zones_divide_a_hot_run(spark):
    t = [(f"t{i:04d}", 1) for i in range(900)] + [("big", 50), ("bigger", 60)]
    target, zone, have, want = sum(x for _, x in t) / 4, 1, 0, {}
    for term, x in sorted(t, key=lambda p: (-p[1], p[0])):
        want[term] = zone
        have += x
        if have >= target and zone < 4:
            zone, have = zone + 1, 0
    assert {r.term: r.zone for r in terms.bradford_zones(spark.createDataFrame(t, "term string, total long"), "term", "total").collect()} == want


def test_pairs_where_one_group_has_a_third(spark):
    rng = random.Random(5)
    d = [("hot", i) for i in range(40)] + [(f"g{rng.randrange(12)}", rng.randrange(30)) for _ in range(80)]
    groups = {}
    for g, i in d:
        groups.setdefault(g, set()).add(i)
    want = Counter(p for s in groups.values() for p in itertools.combinations(sorted(s), 2))
    for hot in (3, 7, 1000):
        assert {(r.l, r.r): r.cnt for r in terms.unordered_links(spark.createDataFrame(d, "g string, i int"), "g", "i", hot).collect()} == want
    c = Counter((g, f"t{i % 17:02d}") for g, i in d)
    want = Counter()
    for g in groups:
        own = sorted((t, n) for (h, t), n in c.items() if h == g)
        for t, n in own:
            want[t, t] += n * (n - 1) // 2
        for (a, m), (b, n) in itertools.combinations(own, 2):
            want[a, b] += m * n
    want = {k: n for k, n in want.items() if n}
    df = spark.createDataFrame([(g, t, n) for (g, t), n in c.items()], "g string, t string, c long")
    for hot in (3, 1000):
        assert {(r.a, r.b): r.cnt for r in terms.token_pairs(df, "g", "t", "c", hot).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_greedy_pairs_like_the_sequence(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(14)]
    p = {}
    for a, b in itertools.combinations_with_replacement(names, 2):
        if rng.random() < 0.5:
            p[a, b] = rng.randrange(1, 9)
    df = {t: rng.randrange(1, 5) for t in names if rng.random() < 0.9}
    used, want = set(), []
    for (a, b), n in sorted(p.items(), key=lambda x: (-x[1], x[0])):
        if n > df.get(a, 0) and n > df.get(b, 0) and not {a, b} & used:
            used |= {a, b}
            want.append((a, b, n))
    got = terms.greedy_pairs(spark.createDataFrame([(*k, n) for k, n in p.items()], "a string, b string, cnt long"), spark.createDataFrame(list(df.items()), "token string, df long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_commit_of_very_many_rows(spark):
    # a third of all rows are of one commit; one of its rows has a long diff, most have none
    diffs = [None if i % 3 else f"d{i}" for i in range(6000)]
    diffs[900] = "x" * 3000
    raw = [(i, "a" * 40, "A subject long enough", f"p{i % 5}", d, None) for i, d in enumerate(diffs)] + [(9000 + i, f"{i:040x}", "Another good subject", "p", "y" * 5000, None) for i in range(9)]
    got = {r.sha: r["diff"] for r in splits.commit_tasks(spark.createDataFrame(raw, "id long, sha string, message string, path string, diff string, cmt_date string"), salts=4).collect()}
    assert got["a" * 40] == "\n".join(d or "" for d in diffs)[:4000] and len(got) == 10 and got[f"{1:040x}"] == "y" * 4000
