"""Canonical forms of task names, commit ids, paths and commit dates, as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.isspace sees it, for Java character classes.
WS = r"\s\x1c-\x1f\x85\p{Z}﻿"

#: Readable layouts of a commit date.
DATE_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][XX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][ ][XXX][XX]",
    "dd/MM/yyyy HH:mm[:ss]",
]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def task_key(c: Column) -> Column:
    """KEY-NUMBER in upper case without leading zeros, from any written form (brackets, URL, lower case, other dashes,
    missing dash, trailing remarks); null where the value names no task."""
    tail = F.regexp_replace(trimmed(c), r"^(?i:[a-z][a-z+.-]*://).*/(?=[^/]*\d)", "")
    pat = r"^[^\p{L}\p{N}]*([A-Za-z][A-Za-z0-9]*?)[\s_#:.\p{Pd}−\p{Zs}]*0*([0-9]+)(?![\p{L}\p{N}])"
    key, num = F.regexp_extract(tail, pat, 1), F.regexp_extract(tail, pat, 2)
    return F.when((key != "") & (num != ""), F.concat(F.upper(key), F.lit("-"), num))


def sha_text(c: Column) -> Column:
    """Lower-case hex of 4 to 40 digits without blanks around it; null for placeholders, the all-zero id and anything else."""
    t = F.lower(trimmed(c))
    return F.when(t.rlike("^[0-9a-f]{4,40}$") & ~t.rlike("^0{40}$"), t)


def resolve_commits(df: DataFrame, sha: str = "sha", out: str = "commit") -> DataFrame:
    """Adds the full id of the commit that Git would resolve the value to, the table being the repository: a full id is
    itself, an abbreviation (4 digits or more) counts if exactly one full id of the table begins with it, anything else is null.

    Abbreviations are few beside full ids; each full id is compared at the lengths that abbreviations have (36 at most), so
    the work stays linear and no prefix bucket is joined with itself.
    """
    t = df.withColumn("_s", sha_text(F.col(sha)))
    full = t.where(F.length("_s") == 40).select("_s").distinct()
    short = t.where(F.length("_s") < 40).select(F.col("_s").alias("_a")).distinct()
    lengths = sorted(r[0] for r in short.select(F.length("_a").alias("n")).distinct().collect())
    if not lengths:
        return t.withColumn(out, F.when(F.length("_s") == 40, F.col("_s"))).drop("_s")
    heads = full.select("_s", F.explode(F.array(*[F.substring("_s", 1, n) for n in lengths])).alias("_a"))
    found = heads.join(short, "_a").groupBy("_a").agg(F.count("*").alias("_n"), F.min("_s").alias("_full")).where("_n = 1").drop("_n")
    return (
        t.withColumn("_a", F.when(F.length("_s") < 40, F.col("_s")))
        .join(found, "_a", "left")
        .withColumn(out, F.when(F.length("_s") == 40, F.col("_s")).otherwise(F.col("_full")))
        .drop("_s", "_a", "_full")
    )


def path_text(c: Column) -> Column:
    """Forward slashes, no blanks around it, no empty, '.' or '..' segments (resolved; '..' at the top is dropped); null for no path."""
    segs = F.split(F.regexp_replace(trimmed(c), r"\\", "/"), "/")
    segs = F.filter(segs, lambda s: (s != "") & (s != "."))
    done = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s != "..", F.concat(a, F.array(s))).when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a),
    )
    simple = trimmed(c)
    plain = simple.rlike(r"^[^/\\.][^/\\]*(/[^/\\.][^/\\]*)*$")
    return F.when(plain, simple).otherwise(F.nullif(F.array_join(done, "/"), F.lit("")))


def commit_time(c: Column, loaded: Column | None = None) -> Column:
    """Timestamp (UTC where no offset stands) of a commit date in any of DATE_LAYOUTS; null for missing, unreadable and
    senseless values: the epoch's first day or before, or later than a day after loading."""
    t = trimmed(c)
    ts = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_LAYOUTS])
    ok = ts >= F.lit("1970-01-02").cast("timestamp")
    if loaded is not None:
        ok = ok & (loaded.isNull() | (ts <= loaded + F.expr("interval 1 day")))
    return F.when(ok, ts)
