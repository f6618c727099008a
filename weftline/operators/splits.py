"""Train and test splits, windows and the commit task unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import RANGE, ordered_rank


def ordinal(df: DataFrame, order: str, out: str = "rn", per: int = RANGE) -> DataFrame:
    """1-based position by order (unique, nulls first), without one task that holds all rows."""
    return ordered_rank(df, [], order, out, per=per)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """ordinal plus n, the number of rows."""
    return ordered_rank(df, [], order, "rn", "n")


def in_test(strategy: str, k: int) -> Column:
    """T11-T13 over rn and n: recent (last k), modn (every n div k-th from the first, the first k), lastn, firstn, middlen. Fewer rows than k are all test."""
    rn, n, step = F.col("rn"), F.col("n"), F.floor(F.col("n") / k)
    rule = {
        "recent": rn > n - k,
        "lastn": rn > n - k,
        "firstn": rn <= k,
        "middlen": (rn > F.floor((n - k) / 2)) & (rn <= F.floor((n - k) / 2) + k),
        # a modulus of 0 must not be evaluated where there are fewer rows than k
        "modn": (F.pmod(rn - 1, F.greatest(step, F.lit(1))) == 0) & (F.floor((rn - 1) / F.greatest(step, F.lit(1))) < k),
    }[strategy]
    return rule | (n <= k)


def split(df: DataFrame, order: str, strategy: str, k: int) -> DataFrame:
    """Adds is_test."""
    return numbered(df, order).withColumn("is_test", in_test(strategy, k)).drop("rn", "n")


def split_by_id(df: DataFrame, id: str, k: int) -> DataFrame:
    """Ids divisible by (n div k) are test; beyond k, and below four fifths of it, rows by MD5 of the id are left out or added until there are k.

    Hash order stands in for a seeded random choice, so that every engine gets the same rows.
    """
    n = df.agg(F.count("*").alias("n"))
    step = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    x = df.join(F.broadcast(n)).withColumn("hit", F.pmod(F.col(id), step) == 0)
    hits = x.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"))
    # candidates in order: hits first, then the others; only the k smallest are looked at
    top = x.select(id, (~F.col("hit")).alias("o"), F.md5(F.col(id).cast("string")).alias("h")).orderBy("o", "h").limit(k)
    fill = F.col("hits") < 0.8 * k
    t = top.join(F.broadcast(hits)).where(~F.col("o") | fill).select(id, F.lit(True).alias("is_test"))
    return df.join(F.broadcast(t), id, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def last_n(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The last n rows by order; all for None."""
    return df if n is None else df.orderBy(F.col(order).desc()).limit(n)


def commit_tasks(raw: DataFrame, max_files: int = 50, min_subject: int = 8, max_diff: int = 4000, when: Column | None = None, salts: int = 64) -> DataFrame:
    """One task per commit that is no merge, touches at most max_files paths and has a subject of min_subject characters:
    (sha, title, description, diff, files, ts). Title is the first line of the first message (by id) that is not null; diffs
    are joined by lines in order of id, nulls as empty, cut to max_diff characters.

    A commit may have any number of rows (one for each path, ticket and repetition). Only rows that can reach into the first max_diff characters
    are gathered: running lengths tell them, first within salts of the commit by id, so that no task sees all rows of a hot commit, then over
    what is left of all salts (max_diff + 1 rows of each at most).
    """
    ts = F.try_to_timestamp(F.col("cmt_date")) if when is None else when
    r = raw.where("sha is not null and sha <> ''")
    per = r.groupBy("sha").agg(F.countDistinct("path").alias("files"), F.min_by("message", F.when(F.col("message").isNotNull(), F.col("id"))).alias("description"), F.min(ts).alias("ts"))
    title = F.substring_index("description", "\n", 1)
    ok = per.withColumn("title", title).where((F.col("files") <= max_files) & ~F.lower("title").startswith("merge ") & (F.length(F.trim("title")) >= min_subject))
    d = r.select("sha", "id", F.substring(F.coalesce("diff", F.lit("")), 1, max_diff).alias("diff"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    for key in (["sha", "salt"], ["sha"]):
        before = F.sum(F.length("diff") + 1).over(Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("at", before).where(F.col("at").isNull() | (F.col("at") < max_diff)).drop("at")
    joined = d.join(ok.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("id", "diff"))).alias("a"))
    text = F.substring(F.array_join(F.transform("a", lambda x: x["diff"]), "\n"), 1, max_diff)
    return ok.join(joined.select("sha", text.alias("diff")), "sha", "left").select("sha", "title", "description", "diff", "files", "ts")
