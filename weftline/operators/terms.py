"""Term statistics: dictionaries, TF-IDF, concentration, Bradford zones, links."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import ordered_rank
from weftline.runtime import stage


def bigrams(tokens: DataFrame, doc: str, array: str) -> DataFrame:
    """(doc, pos, prev, cur) of every token of an array, prev null for the first. Arrays stay in one row, so no window is needed."""
    e = tokens.select(doc, array, F.posexplode(array).alias("pos", "cur"))
    return e.select(doc, "pos", F.when(F.col("pos") > 0, F.get(F.col(array), F.col("pos") - 1)).alias("prev"), "cur")


def module_tfidf(counts: DataFrame, task_modules: DataFrame, total_modules: int | Column) -> DataFrame:
    """(module, term, tf, idf, tfidf). counts (task_name, term, cnt); tf over all token rows of the tasks that touch the module;
    idf = ln(M / df) if M > df, else 0."""
    j = counts.join(task_modules, "task_name").groupBy("module", "term").agg(F.sum("cnt").alias("c"))
    size = j.groupBy("module").agg(F.sum("c").alias("size"))
    df = j.groupBy("term").agg(F.count("*").alias("df"))
    m = F.lit(total_modules) if isinstance(total_modules, int) else total_modules
    idf = F.when(m > F.col("df"), F.ln(m / F.col("df"))).otherwise(F.lit(0.0))
    out = j.join(size, "module").join(df, "term").withColumn("tf", F.col("c") / F.col("size")).withColumn("idf", idf)
    return out.select("module", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def corpus_tfidf(counts: DataFrame, doc: str, term: str, cnt: str) -> DataFrame:
    """(doc, term, weight): idf = ln((1 + n) / (1 + df)) + 1, raw counts, each document's row of length 1. The document's
    length is a window over its own rows, so the counts are shuffled once by term and once by document."""
    n = counts.select(doc).distinct().agg(F.count("*").alias("n"))
    df = counts.groupBy(term).agg(F.count("*").alias("df")).join(F.broadcast(n)).select(term, (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(df, term).withColumn("w", F.col(cnt) * F.col("idf"))
    return w.select(doc, term, (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).alias("weight"))


def tf_df_idf(words: DataFrame, doc: str, term: str) -> DataFrame:
    """(term, tf, df, idf) with idf = ln(N / (df + 1)), which may be negative."""
    per = words.groupBy(term, doc).agg(F.count("*").alias("c"))
    n = words.select(doc).distinct().agg(F.count("*").alias("n"))
    t = per.groupBy(term).agg(F.sum("c").alias("tf"), F.count("*").alias("df"))
    return t.join(F.broadcast(n)).select(term, "tf", "df", F.ln(F.col("n") / (F.col("df") + 1)).alias("idf"))


def concentration(term_nodes: DataFrame) -> DataFrame:
    """(term, file_cnt, root_cnt, hhi_file, hhi_root, composite, rank) from (term, node, root, lvl, is_file, cnt) rows,
    cnt being added up by node. Shares are of the term's total over all levels. rank = deepest level, one more if
    there are several roots."""
    n = term_nodes.groupBy("term", "node", "root", "lvl", "is_file").agg(F.sum("cnt").alias("c"))
    total = n.groupBy("term").agg(
        F.sum("c").alias("t"),
        F.sum(F.when(F.col("is_file"), F.col("c") * F.col("c"))).alias("f2"),
        F.count(F.when(F.col("is_file"), 1)).alias("file_cnt"),
        F.max("lvl").alias("max_lvl"),
    )
    r = n.groupBy("term", "root").agg(F.sum("c").alias("rc")).groupBy("term").agg(F.sum(F.col("rc") * F.col("rc")).alias("r2"), F.count("*").alias("root_cnt"))
    sq = lambda c: F.coalesce(F.col(c), F.lit(0)) / (F.col("t") * F.col("t"))
    return total.join(r, "term").select(
        "term", "file_cnt", "root_cnt", sq("f2").alias("hhi_file"), sq("r2").alias("hhi_root"), (sq("f2") * sq("r2")).alias("composite"), (F.col("max_lvl") + F.when(F.col("root_cnt") > 1, 1).otherwise(0)).alias("rank")
    )


def hhi(df: DataFrame, key: str, count: str) -> DataFrame:
    """(key, hhi), the sum of squared shares of count; 0 for a total of 0."""
    s = df.groupBy(key).agg(F.sum(count).alias("t"), F.sum(F.col(count) * F.col(count)).alias("q"))
    return s.select(key, F.when(F.col("t") == 0, 0.0).otherwise(F.col("q") / (F.col("t") * F.col("t"))).alias("hhi"))


def bradford_zones(totals: DataFrame, term: str, total: str, zones: int = 4) -> DataFrame:
    """(term, total, zone): terms by falling total fill a zone until its own sum reaches a `zones`-th of all; the excess is dropped.

    The running sum needs one order over the vocabulary, which is counted by total first: there are at most the square root
    of twice the occurrences of distinct totals, and the boundary of a zone inside a run of equal totals (at most zones - 1 of them) follows
    from its rank. Ranks of such a run are taken in ranges of its terms, so a run of half the vocabulary is in no single task.
    """
    runs = totals.groupBy(F.col(total).alias("x")).agg(F.count("*").alias("n")).orderBy(F.col("x").desc()).collect()
    target = sum(r.x * r.n for r in runs) / zones
    zone, have, plan = 1, 0, []  # (x, ranks below hi, zone)
    for r in runs:
        at = 0
        while at < r.n:
            if zone == zones or not r.x:
                k = r.n - at
            else:
                k = min(r.n - at, max(1, -int((have - target) // r.x)))
            plan.append((r.x, at, at + k, zone))
            have += k * r.x
            at += k
            if zone < zones and have >= target:
                zone, have = zone + 1, 0
    # zones fall with the total: outside the divided runs, the greatest total of each zone tells it
    parts = Counter(x for x, *_ in plan)
    inside = [x for x, k in parts.items() if k > 1]
    top = [max(x for x, *_, z in plan if z == k) for k in sorted({z for *_, z in plan})]
    plain = F.lit(1)
    for k, x in zip(sorted({z for *_, z in plan}), top):
        plain = F.when(F.col(total) <= x, F.lit(k)).otherwise(plain)
    outer = totals.where(~F.col(total).isin(inside)) if inside else totals
    out = outer.select(term, total, plain.cast("int").alias("zone"))
    if inside:
        rk = ordered_rank(totals.where(F.col(total).isin(inside)), [total], term, "_rk")
        z = F.lit(None).cast("int")
        for x, lo, hi, k in plan:
            if x in inside:
                z = F.when((F.col(total) == x) & (F.col("_rk") > lo) & (F.col("_rk") <= hi), F.lit(k)).otherwise(z)
        out = out.unionByName(rk.select(term, total, z.alias("zone")))
    return out


def pairs_in_groups(d: DataFrame, hot: int, loops: bool = False) -> DataFrame:
    """(l, r) of every two different items of a group of d (g, i), l < r, and of each item with itself with loops; d is distinct.

    A group of at most `hot` items is one array whose items are paired one by one, so no list of its pairs is built. A larger one is cut into
    tiles by hash; every two of its tiles are a task's work of their own, to which each item goes once for each tile.
    """
    size = d.groupBy("g").agg(F.count("*").alias("n"))
    big = size.where(F.col("n") > hot)  # their number grows with the data, so Spark chooses the join by its size
    light = d.join(big, "g", "left_anti").groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("a"))
    one = light.select("a", F.posexplode("a").alias("k", "l"))
    two = one.select("l", F.explode(F.slice("a", F.col("k") + (1 if loops else 2), F.size("a"))).alias("r"))
    t = d.join(big, "g").withColumn("m", F.ceil(F.col("n") / hot).cast("int")).withColumn("t", F.pmod(F.xxhash64("i"), F.col("m")).cast("int"))
    t = t.select("g", "i", "t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("u"))
    tiles = t.select("g", F.least("t", "u").alias("p"), F.greatest("t", "u").alias("q"), "t", "i").groupBy("g", "p", "q")
    own = lambda c: F.collect_list(F.when(F.col("t") == F.col(c), F.col("i")))
    x = tiles.agg(own("p").alias("a"), own("q").alias("b")).select(F.explode("a").alias("x"), "b", (F.col("p") == F.col("q")).alias("same"))
    x = x.select("x", F.explode("b").alias("y"), "same")
    ok = (F.col("x") < F.col("y")) | ~F.col("same")
    heavy = x.where(ok | (F.col("x") == F.col("y")) if loops else ok).select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r"))
    return two.unionByName(heavy)


def unordered_links(pairs: DataFrame, group: str, item: str, hot: int = 1000) -> DataFrame:
    """(l, r, cnt): in how many groups two items stand together, l < r. Null groups and items tie nothing."""
    d = pairs.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    return pairs_in_groups(d, hot).groupBy("l", "r").agg(F.count("*").alias("cnt"))


def token_pairs(counts: DataFrame, doc: str, token: str, cnt: str, hot: int = 1000) -> DataFrame:
    """(a, b, cnt) of all pairs of positions in a document, a <= b: products of counts, and n (n - 1) / 2 for equal tokens.

    counts has a row for each document and token. Products are added up before the shuffle.
    """
    d = counts.select(F.col(doc).alias("g"), F.struct(F.col(token).alias("tok"), F.col(cnt).alias("c")).alias("i")).where("g is not null and i.tok is not null").distinct()
    p = pairs_in_groups(d, hot, True)
    same = F.col("l.tok") == F.col("r.tok")
    n = F.when(same, F.expr("l.c * (l.c - 1) div 2")).otherwise(F.col("l.c") * F.col("r.c"))
    return p.select(F.col("l.tok").alias("a"), F.col("r.tok").alias("b"), n.alias("n")).where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("cnt"))


def greedy_pairs(pairs: DataFrame, df: DataFrame, max_rounds: int = 200) -> DataFrame:
    """A10: pairs (a, b, cnt) by falling count, ties by a and b, each token used once, count above both document frequencies.

    A pair that is the first of both its tokens is taken by the sequence whatever else is. So each round takes all of them at once,
    drops the pairs of their tokens, and goes on with the rest: the sequence's result without its one task. Pairs of a token
    with itself use it twice, so they are taken only if nothing better uses it.
    """
    x = df.select(F.col("token").alias("a"), F.col("df").alias("da"))
    y = df.select(F.col("token").alias("b"), F.col("df").alias("db"))
    left = stage(pairs.join(x, "a", "left").join(y, "b", "left").where("cnt > coalesce(da, 0) and cnt > coalesce(db, 0)").select("a", "b", "cnt"), "left")
    out = left.limit(0)
    for _ in range(max_rounds):
        key = F.struct((-F.col("cnt")).alias("n"), "a", "b")
        ends = left.select(F.col("a").alias("t"), key.alias("k")).union(left.select(F.col("b").alias("t"), key.alias("k")))
        first = ends.groupBy("t").agg(F.min("k").alias("k"))
        win = first.groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n = 2 or k.a = k.b")
        win = stage(win.select("k.a", "k.b", (-F.col("k.n")).alias("cnt")), "taken")
        if win.isEmpty():
            return out
        used = win.select(F.col("a").alias("t")).union(win.select(F.col("b").alias("t"))).distinct()
        out = out.unionByName(win)
        left = stage(left.join(used, left.a == used.t, "left_anti").join(used, F.col("b") == used.t, "left_anti"), "left")
    raise RuntimeError("greedy pairs did not settle")
