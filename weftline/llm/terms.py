"""Frequency of every distinct term by last-seen counters.

Titles are cut into terms in the JVM, one row for each occurrence. Occurrences are hash-partitioned by term, hot terms being spread over
salts of the record, and come ordered by record. A partition then holds, for a term, its occurrences, its records and the record it was last
seen in: an occurrence adds to the records only if that record is another one. So no set of records is kept, and since a record has
one salt, the partial counters of a term simply add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cores, stage

#: A partition's counters are passed on, between two records, when they hold so many terms, so memory doesn't grow with the vocabulary.
FLUSH = 500_000
#: Parts that the occurrences of a term are spread over, by record.
SALTS = 16


def title_terms(c):
    """Terms of a title: every character but ASCII letters, digits, white space and '-' deleted, lower case, split at white space."""
    ws = r"\s\x1c-\x1f\x85\p{Z}"
    kept = F.lower(F.regexp_replace(c, f"[^a-zA-Z0-9{ws}-]", ""))
    return F.filter(F.split(kept, f"[{ws}]+"), lambda t: t != "")


def one_per_record(df: DataFrame, key: str, value: str) -> DataFrame:
    """The first value (smallest, nulls last) of each key; rows without key stay records of their own."""
    d = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    keyed = d.where("k is not null").groupBy("k").agg(F.min("v").alias("v")).select("v")
    return keyed.unionAll(d.where("k is null").select("v"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counters from occurrences (term, rec) that come ordered by rec."""
    seen: dict[str, list[int]] = {}
    schema = pa.schema([("term", pa.string()), ("total", pa.int64()), ("recs", pa.int64())])
    last = None

    def out() -> pa.RecordBatch:
        a = list(seen.values())
        cols = [list(seen), [x[0] for x in a], [x[1] for x in a]]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    def add(terms: pa.Array, rec: np.ndarray) -> None:
        words = terms.dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # within a term by record
        c, r = code[order], rec[order]
        start = np.concatenate([[True], c[1:] != c[:-1]])
        new = start.copy()
        new[1:] |= r[1:] != r[:-1]
        first = np.flatnonzero(start)
        final = np.append(first[1:], len(r)) - 1
        total, recs = np.diff(np.append(first, len(r))), np.add.reduceat(new.astype(np.int64), first)
        for t, n_all, n_rec, r0, r1 in zip(words.dictionary.take(pa.array(c[first])).to_pylist(), total.tolist(), recs.tolist(), r[first].tolist(), r[final].tolist()):
            if (s := seen.get(t)) is None:
                seen[t] = [n_all, n_rec, r1]
            else:
                s[0] += n_all
                s[1] += n_rec - (s[2] == r0)  # the record went on from the batch before
                s[2] = r1

    for b in batches:
        rec = b.column(1).to_numpy()
        if not len(rec):
            continue
        cut = 0
        if len(seen) > FLUSH:
            other = np.flatnonzero(rec != last)
            cut = int(other[0]) if len(other) else len(rec)
            if cut:
                add(b.column(0).slice(0, cut), rec[:cut])
            if cut < len(rec):
                yield out()
        if cut < len(rec):
            add(b.column(0).slice(cut), rec[cut:])
        last = rec[-1]
    yield out()


def term_counts(texts: DataFrame, column: str = "v") -> DataFrame:
    """(term, total_count, task_cnt, n_records): occurrences and records of every term; n_records has records with a term.

    Null and empty texts have no terms. An empty table gives an empty result.
    """
    # written once, so that records keep their numbers whatever is computed again
    recs = stage(texts.select(title_terms(F.col(column)).alias("ts")).where(F.size("ts") > 0).withColumn("rec", F.monotonically_increasing_id()), "records")
    occ = recs.select(F.explode("ts").alias("term"), "rec")
    spark = texts.sparkSession
    n = max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = occ.repartition(n, F.col("term"), F.pmod(F.xxhash64("rec"), F.lit(SALTS))).sortWithinPartitions("rec").mapInArrow(_count, "term string, total long, recs long")
    s = part.groupBy("term").agg(F.sum("total").alias("total_count"), F.sum("recs").alias("task_cnt"))
    return s.withColumn("n_records", F.lit(recs.count()).cast("long"))


def mark(min_records: int = 3, max_share: float = 0.05):
    """`rare` below min_records records, else `common` above max_share of the records that have terms, else null."""
    return F.when(F.col("task_cnt") < min_records, "rare").when(F.col("task_cnt") * round(1 / max_share) > F.col("n_records"), "common")


def term_report(task: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts of every title term afresh beside the stored ones, with the mark.

    Stored terms are matched without letter case and blanks; several stored rows of one term are told apart by n_stored, and the
    greatest of their counts stands. Terms only stored come out with zero counts and no mark.
    """
    c = term_counts(one_per_record(task, "name", "title"))
    st = stored.groupBy(F.lower(F.trim("term")).alias("st")).agg(F.max("total_count").alias("stored_total_count"), F.max("task_cnt").alias("stored_task_cnt"), F.count("*").alias("n_stored")).where("st is not null")
    j = c.withColumn("mark", mark()).join(st, F.col("term") == F.col("st"), "full")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return j.select(
        F.coalesce("term", "st").alias("term"),
        zero("total_count").alias("total_count"),
        zero("task_cnt").alias("task_cnt"),
        "stored_total_count",
        "stored_task_cnt",
        zero("n_stored").alias("n_stored"),
        (zero("total_count").eqNullSafe(F.col("stored_total_count")) & zero("task_cnt").eqNullSafe(F.col("stored_task_cnt"))).alias("agrees"),
        "mark",
    )


def marked_terms(task: DataFrame) -> DataFrame:
    c = term_counts(one_per_record(task, "name", "title"))
    return c.select("term", mark().alias("mark")).where("mark is not null")
