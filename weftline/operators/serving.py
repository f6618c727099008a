"""Look-ups of tasks, files and diffs, and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import head_lines, preview

#: Most results of a call.
CAPS = {"modules": 50, "files": 50, "tasks": 20, "list": 1000}


def cap(n: int, what: str) -> int:
    return max(0, min(n, CAPS[what]))


def list_tasks(raw: DataFrame, n: int = 100) -> DataFrame:
    """(task_name, changes, files, message) of the tasks with the most changes, ties by name."""
    g = raw.where("task_name is not null and task_name <> ''").groupBy("task_name")
    a = g.agg(F.count("*").alias("changes"), F.countDistinct("path").alias("files"), F.max("message").alias("message"))
    return a.orderBy(F.col("changes").desc(), "task_name").limit(cap(n, "list")).withColumn("message", preview(F.col("message")))


def task_files(raw: DataFrame, task: str) -> DataFrame:
    """Q05: (id, path, diff_length) of a task's changes."""
    return raw.where(F.col("task_name") == task).select("id", "path", F.length("diff").alias("diff_length"))


def file_diff(raw: DataFrame, task: str, path: str) -> DataFrame:
    """Q06: the first change of a path for a task."""
    return raw.where((F.col("task_name") == task) & (F.col("path") == path)).orderBy("id").limit(1).select("id", "task_name", "path", "message", "diff")


def task_summary(raw: DataFrame, n_paths: int = 10) -> DataFrame:
    """(task_name, changes, files, diff_chars, paths): of every task, with its first n_paths paths.

    Paths are distinct by task before they are gathered, so a task with a third of all rows gathers its distinct paths, no rows.
    """
    t = raw.where("task_name is not null and task_name <> ''")
    p = t.groupBy("task_name", "path").agg(F.count("*").alias("c"), F.sum(F.length("diff")).alias("d"))
    g = p.groupBy("task_name").agg(F.sum("c").alias("changes"), F.count("path").alias("files"), F.coalesce(F.sum("d"), F.lit(0)).alias("diff_chars"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("task_name").orderBy("path"))
    few = p.where("path is not null").withColumn("k", k).where(F.col("k") <= n_paths).groupBy("task_name").agg(F.sort_array(F.collect_list("path")).alias("ps"))
    return g.join(few, "task_name", "left").select("task_name", "changes", "files", "diff_chars", F.coalesce(F.array_join("ps", "|"), F.lit("")).alias("paths"))


def file_summary(raw: DataFrame, path: str, n: int = 10) -> DataFrame:
    """The last n tasks of a path with their numbers of changes."""
    g = raw.where((F.col("path") == path) & F.col("task_name").isNotNull()).groupBy("task_name").agg(F.max("id").alias("last_id"), F.count("*").alias("changes"))
    return g.orderBy(F.col("last_id").desc()).limit(n)


def ui_changes(raw: DataFrame, task: str, n: int = 50) -> DataFrame:
    """Q14: the first n changes of a task with previews of their diffs."""
    return raw.where(F.col("task_name") == task).orderBy("id").limit(n).select("id", "path", preview(F.col("diff")).alias("diff"))


def module_info(collection: DataFrame, path: str) -> DataFrame:
    """Q10: the first row of an exact path."""
    return collection.where(F.col("path") == path).orderBy("id").limit(1).select("id", "path", "type", F.size("vector").alias("dim"))


def module_fingerprints(changes: DataFrame, n_tasks: int = 20) -> DataFrame:
    """Q11: (module, num_tasks, task_ids): of every module, its first n_tasks tasks by name."""
    from pyspark.sql import Window

    d = changes.select("module", "task_name").distinct()
    k = F.row_number().over(Window.partitionBy("module").orderBy("task_name"))
    few = d.withColumn("k", k).where(F.col("k") <= n_tasks).groupBy("module").agg(F.sort_array(F.collect_list("task_name")).alias("t"))
    return d.groupBy("module").agg(F.count("*").alias("num_tasks")).join(few, "module").select("module", "num_tasks", F.array_join("t", "|").alias("task_ids"))


def module_evolution(changes: DataFrame, when: Column) -> DataFrame:
    """Q13: (module, month, changes, tasks)."""
    d = changes.withColumn("month", F.date_format(F.date_trunc("month", when), "yyyy-MM")).where("month is not null")
    return d.groupBy("module", "month").agg(F.count("*").alias("changes"), F.countDistinct("task_name").alias("tasks"))


def enrich(ranked: DataFrame, task: DataFrame, raw: DataFrame, n_tasks: int = 10, n_diffs: int = 3, chars: int = 2000) -> DataFrame:
    """Q17: of each query's first n_tasks tasks, title, description and the first n_diffs diffs cut to chars."""
    from pyspark.sql import Window

    top = ranked.where(F.col("rank") <= n_tasks).select("query_id", F.col("path").alias("task_name"), "rank")
    k = F.row_number().over(Window.partitionBy("task_name").orderBy("id"))
    wanted = raw.where("diff is not null").join(top.select("task_name").distinct(), "task_name", "left_semi")
    diffs = wanted.withColumn("k", k).where(F.col("k") <= n_diffs).groupBy("task_name").agg(F.sort_array(F.collect_list(F.struct("k", "path", F.substring("diff", 1, chars).alias("diff")))).alias("d"))
    t = task.select(F.col("name").alias("task_name"), "title", preview(F.col("description")).alias("description"))
    j = top.join(t, "task_name", "left").join(diffs, "task_name", "left")
    return j.select("query_id", "task_name", "rank", "title", "description", F.coalesce(F.array_join(F.transform("d", lambda x: F.concat(x["path"], F.lit(": "), x["diff"])), "\n"), F.lit("")).alias("diffs"))


def prompt(query: Column, modules: Column, files: Column, tasks: Column, snippets: Column, limit: int = 4000) -> Column:
    """F32, Q15: the assembled prompt; modules, files: arrays of (path, score), tasks: (path, title, description, score), snippets: (path, content, score)."""
    sim = lambda x: F.format_string(" (similarity: %.4f)", x["score"])

    def part(title: str, a: Column, n: int, line) -> Column:
        items = F.transform(F.slice(a, 1, n), line)
        return F.when(F.size(a) > 0, F.concat(F.lit("\n" + title + "\n"), F.array_join(items, "\n")))

    no = lambda i: F.concat((i + 1).cast("string"), F.lit(". "))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Task Description\n"), query, F.lit("\n")),
        part("## Relevant Modules (by semantic similarity)", modules, 3, lambda x, i: F.concat(no(i), F.lit("**"), x["path"], F.lit("**"), sim(x))),
        part("## Similar Historical Tasks", tasks, 3, lambda x, i: F.concat(no(i), F.lit("Task "), x["path"], F.lit(": "), F.coalesce(x["title"], F.lit("")), F.lit("\n   "), F.substring(F.coalesce(x["description"], F.lit("")), 1, 200), F.lit("..."), sim(x))),
        part("## Relevant Files (top matches)", files, 5, lambda x, i: F.concat(no(i), x["path"], sim(x))),
        part("## Code Context (actual file content)", snippets, 3, lambda x, i: F.concat(F.lit("\n### File "), (i + 1).cast("string"), F.lit(": "), x["path"], sim(x), F.lit("\n```\n"), head_lines(x["content"], 50), F.lit("\n```"))),
    )
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n\n[Context truncated...]"))).otherwise(text)
