"""Readers: landed tracker JSON and HTML, result files, logs, vectors, file contents, databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import html_clean

RAWDATA = "id long, sha string, author_name string, author_email string, cmt_date string, message string, path string, diff string, task_name string"
TASK = "id long, name string, title string, description string, comments string"
#: Issue documents of the trackers as their public interfaces return them, reduced to the fields used.
JIRA = "struct<key:string,fields:struct<summary:string,description:string,comment:struct<comments:array<struct<body:string>>>>>"
GITHUB = "struct<number:long,title:string,body:string,pull_request:string,comments_list:array<struct<body:string>>>"
GITLAB = "struct<iid:long,title:string,description:string,notes:array<struct<body:string,system:boolean>>>"
GITLAB_MR = "struct<iid:long,state:string,closes:array<struct<iid:long>>,commits:array<string>,files:array<string>>"
YOUTRACK = "struct<idReadable:string,summary:string,description:string,comments:array<struct<text:string>>>"


def _task(name: Column, title: Column, description: Column, comments: Column) -> list[Column]:
    return [name.alias("name"), title.alias("title"), description.alias("description"), comments.alias("comments")]


def jira_issues(df: DataFrame, json: str = "json") -> DataFrame:
    """SC03: comments are the bodies as one JSON array text, as they are stored; '[]' for none."""
    j = F.from_json(json, JIRA)
    bodies = F.coalesce(F.transform(j["fields"]["comment"]["comments"], lambda c: c["body"]), F.array().cast("array<string>"))
    return df.select(*_task(j["key"], j["fields"]["summary"], j["fields"]["description"], F.to_json(bodies)))


def jira_html(df: DataFrame, name: str = "name", html: str = "html") -> DataFrame:
    """SC04, SC05: title and description by their element ids, comments by the class of their bodies; nested markup is cleaned."""

    def by_id(i: str, tag: str) -> Column:
        hit = F.regexp_extract(html, rf'(?is)<{tag}[^>]*\bid="{i}"[^>]*>(.*?)</{tag}>', 1)
        return F.nullif(html_clean(hit), F.lit(""))

    comments = F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<div[^>]*class="[^"]*action-body[^"]*"[^>]*>(.*?)</div>'), 1), html_clean)
    return df.select(*_task(F.col(name), by_id("summary-val", "h1"), by_id("description-val", "div"), F.array_join(comments, " ")))


def github_issues(df: DataFrame, json: str = "json") -> DataFrame:
    """SC06, SC11: pull requests are no issues; comments joined by a blank. Pages that answered 404 or 410 are landed as null and give empty fields."""
    j = F.from_json(json, GITHUB)
    d = df.select("*", j.alias("_j")).where(F.col("_j.pull_request").isNull())
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return d.select(*_task(F.concat(F.lit("#"), F.col("_j.number")), e("_j.title"), e("_j.body"), F.coalesce(F.array_join("_j.comments_list.body", " "), F.lit(""))))


def gitlab_issues(df: DataFrame, json: str = "json") -> DataFrame:
    """SC08: notes of the system are dropped, the others joined by a blank."""
    j = F.from_json(json, GITLAB)
    notes = F.filter(j["notes"], lambda n: ~F.coalesce(n["system"], F.lit(False)))
    return df.select(*_task(F.concat(F.lit("#"), j["iid"]), j["title"], j["description"], F.coalesce(F.array_join(F.transform(notes, lambda n: n["body"]), " "), F.lit(""))))


def gitlab_merge_links(df: DataFrame, json: str = "json") -> DataFrame:
    """SC09: (issue, mr, commits, files) of every issue that a merged request closes."""
    d = df.select(F.from_json(json, GITLAB_MR).alias("j")).where("j.state = 'merged'")
    return d.select(F.explode("j.closes.iid").alias("issue"), F.col("j.iid").alias("mr"), F.col("j.commits").alias("commits"), F.col("j.files").alias("files"))


def youtrack_issues(df: DataFrame, json: str = "json") -> DataFrame:
    """SC10: all fields cleaned of markup, comments joined by a blank."""
    j = F.from_json(json, YOUTRACK)
    text = F.array_join(F.transform(j["comments"], lambda c: c["text"]), " ")
    return df.select(*_task(j["idReadable"], html_clean(j["summary"]), html_clean(j["description"]), html_clean(text)))


TRACKERS = {"jira": jira_issues, "github": github_issues, "gitlab": gitlab_issues, "youtrack": youtrack_issues}


def issues(df: DataFrame, tracker: str, json: str = "json") -> DataFrame:
    """SC12: landed issues of a tracker by its type."""
    return TRACKERS[tracker](df, json)


def bulk_issues(pages: DataFrame, tracker: str, page: str = "page") -> DataFrame:
    """SC11: the issues of landed pages, one row a page: a list, or an object that holds it as issues. GitHub's pull requests are skipped, and
    GitHub and GitLab give no comments in bulk. A page that is no JSON has no issues; an issue on two pages comes once."""
    text = F.trim(page)
    items = F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.from_json(text, "issues array<string>")["issues"])
    d = pages.select(F.explode(items).alias("json")).distinct()
    out = issues(d, tracker)
    return out.withColumn("comments", F.lit("")) if tracker in ("github", "gitlab") else out


def pending_tasks(task: DataFrame) -> DataFrame:
    """SC13, P08: tasks that still lack details."""
    return task.where("name is not null and title is null")


def commit_table(spark: SparkSession, database: str | None = None) -> str | None:
    """SC15: the name of the table of commits: commits if there is one, else rawdata, else none."""
    for t in ("commits", "rawdata"):
        if spark.catalog.tableExists(f"{database}.{t}" if database else t):
            return t
    return None


def jdbc_table(spark: SparkSession, url: str, table: str, columns: list[str], key: str, bounds: tuple[int, int], parts: int = 16, **options: str) -> DataFrame:
    """SC14, SC16: columns of a database's table by ranges of a numeric key; the projection reaches the database."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts, **options}.items():
        r = r.option(k, v)
    return r.load().select(*columns)


def csv_results(spark: SparkSession, path: str) -> DataFrame:
    """SC17: a result file with a header, types inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def globbed_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """SC18: <root>/<project>/<task_unit>/... files with project and task_unit from their paths."""
    d = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/([^/]+)/[^/]+$", 2)
    return d.select("*", at[0].alias("project"), at[1].alias("task_unit"))


def run_log(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """SC19: (name, run, value, number, is_true) of 'name_NNN' keys; number by way of integer, then real, as far as the text is one."""
    name, run = F.regexp_extract(key, r"^(.*)_(\d+)$", 1), F.regexp_extract(key, r"^(.*)_(\d+)$", 2)
    d = df.where(F.col(key).rlike(r"_\d+$"))
    return d.select(name.alias("name"), run.cast("int").alias("run"), F.col(value).alias("value"), F.expr(f"try_cast({value} as double)").alias("number"), F.lower(value).isin("true", "yes", "1").alias("is_true"))


def checkpoint_counts(spark: SparkSession, path: str) -> DataFrame:
    """SC20: numbers of done and failed steps of each checkpoint document."""
    s = "created_at string, last_updated string, completed_etl array<string>, completed_experiments array<string>, failed_etl array<string>, failed_experiments array<string>, current_model string, current_strategy string"
    d = spark.read.schema(s).option("multiLine", True).json(path)
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0)).alias(c)
    return d.select(F.col("_metadata.file_path").alias("file"), *[n(c) for c in ("completed_etl", "completed_experiments", "failed_etl", "failed_experiments")])


def glove_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """SC21: (word, v) of lines of a word and dim numbers; other lines are skipped."""
    p = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("p"))
    v = F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("double"))
    return p.where(F.size("p") == dim + 1).select(F.col("p")[0].alias("word"), v.alias("v")).where(F.forall("v", lambda x: x.isNotNull()))


def file_contents(spark: SparkSession, root: str) -> DataFrame:
    """SC22: (path, text, bytes, lines) of the files below root."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.decode("content", "UTF-8")
    return d.select(F.regexp_replace(F.col("path"), "^file:/*", "/").alias("path"), text.alias("text"), F.col("length").alias("bytes"), (F.regexp_count(text, F.lit("\n")) + 1).alias("lines"))
