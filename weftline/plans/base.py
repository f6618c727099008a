"""Base relations of the queries, as DataFrames and as the SQL they are compared with."""

from pyspark.sql import functions as F

from weftline.functions.text import file_path
from weftline.functions.vectors import usable
from weftline.runtime import table

DIM = 64

#: Tickets once each; changes with a ticket and a path; task vectors by name; the ticket's words of the title.
SQL = {
    "t": "SELECT DISTINCT id, name, title, description, comments FROM task",
    "r": "SELECT id, sha, cmt_date, message, path, diff, task_name FROM rawdata WHERE task_name IS NOT NULL AND task_name <> '' AND path IS NOT NULL AND path <> ''",
    "f": "SELECT DISTINCT task_name, regexp_replace(replace(path, '\\', '/'), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS file FROM r",
    "v": f"SELECT path AS name, arg_min(vec, id) AS v FROM (SELECT id, path, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS vec FROM vec_collection WHERE type = 'task' AND vector IS NOT NULL AND len(vector) = {DIM} AND path IS NOT NULL) WHERE len(list_filter(vec, lambda x: isfinite(x))) = {DIM} AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY path",
    "w": "SELECT id, name, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM t",
    "tt": "SELECT id, name, term, count(*) AS cnt FROM w GROUP BY ALL",
    "tm": "SELECT DISTINCT task_name, CASE WHEN contains(root, '.') THEN '' ELSE root END AS module FROM (SELECT task_name, split_part(regexp_replace(path, '^/+|/+$', '', 'g'), '/', 1) AS root FROM r)",
}
_NEEDS = {"f": ["r"], "w": ["t"], "tt": ["t", "w"], "tm": ["r"]}


def ctes(*names: str, more: str = "") -> str:
    """WITH clause of the named base relations and what they need, then more of its own."""
    out: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in out:
                out.append(m)
    parts = [f"{n} AS ({SQL[n]})" for n in out] + ([more] if more else [])
    return "WITH " + ", ".join(parts) + " "


def tickets(spark, d):
    return table(spark, d, "task").select("id", "name", "title", "description", "comments").distinct()


def changes(spark, d):
    r = table(spark, d, "rawdata").select("id", "sha", "cmt_date", "message", "path", "diff", "task_name")
    return r.where("task_name is not null and task_name <> '' and path is not null and path <> ''")


def task_files(spark, d):
    """Distinct (task_name, file)."""
    return changes(spark, d).select("task_name", file_path(F.col("path")).alias("file")).distinct()


def task_vectors(spark, d):
    v = table(spark, d, "vec_collection").where("type = 'task' and path is not null").where(usable(F.col("vector"), DIM))
    return v.groupBy(F.col("path").alias("name")).agg(F.min_by("vector", "id").cast("array<double>").alias("v"))


def title_words(spark, d):
    """(id, name, term) for every occurrence of a term in a title."""
    from weftline.functions.text import title_terms

    return tickets(spark, d).select("id", "name", F.explode(title_terms(F.col("title"))).alias("term"))


def title_term_counts(spark, d):
    return title_words(spark, d).groupBy("id", "name", "term").agg(F.count("*").alias("cnt"))


def task_modules(spark, d):
    """Distinct (task_name, module) by root folder; '' for files at the top."""
    from weftline.functions.text import root_module

    return changes(spark, d).select("task_name", root_module(F.col("path")).alias("module")).distinct()
