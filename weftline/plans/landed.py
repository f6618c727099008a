"""Queries of landed tracker documents, writing rules and the remaining rows of the inventory, as round trips over whole tables."""

import uuid

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import agent, matching
from weftline.operators import search as S
from weftline.operators import serving as R
from weftline.operators import splits as P
from weftline.operators import terms as O
from weftline.operators.embed import VECTORIZERS, embed, word_mean, word2vec
from weftline.operators.hierarchy import resolve_hierarchy
from weftline.plans.base import changes, ctes, task_files, tickets, title_words
from weftline.plans.registry import core
from weftline.plans.retrieval import _dual_base, dual_sides, search_sides
from weftline.runtime import shared_dir, stage, table
from weftline.sources import readers, sinks

Q = core.query


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/weftline-tables/{name}-{uuid.uuid4().hex[:10]}"


def _json(spark, d, **fields):
    """Tickets as documents of a tracker, one JSON text each."""
    return tickets(spark, d).where("name is not null").select("name", F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("json"))


_NN = "SELECT name, title, description, comments FROM t WHERE name IS NOT NULL"
_one = lambda c, f: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias(f))))


@Q("SC03_jira_issues", ctes("t") + "SELECT name, title, description, CASE WHEN comments IS NULL THEN 0 ELSE 1 END AS n FROM t WHERE name IS NOT NULL")
def _(spark, d):
    f = F.struct(F.col("title").alias("summary"), "description", F.struct(_one("comments", "body").alias("comments")).alias("comment"))
    j = readers.jira_issues(_json(spark, d, key=F.col("name"), fields=f))
    return j.select("name", "title", "description", F.size(F.from_json("comments", "array<string>")).alias("n"))


@Q("SC04_jira_html", ctes("t") + "SELECT name FROM t WHERE name IS NOT NULL")
def _(spark, d):
    h = F.concat(F.lit('<h1 id="summary-val">'), F.coalesce("title", F.lit("")), F.lit('</h1><div id="description-val">'), F.coalesce("description", F.lit("")), F.lit("</div>"))
    return readers.jira_html(tickets(spark, d).where("name is not null").select("name", h.alias("html"))).select("name")


@Q("SC06_github_issues", ctes("t") + "SELECT '#' || CAST(id AS VARCHAR) AS name, coalesce(title, '') AS title, coalesce(description, '') AS description, coalesce(comments, '') AS comments FROM t WHERE id % 3 <> 0 AND name IS NOT NULL")
def _(spark, d):
    pull = F.when(F.col("id") % 3 == 0, F.lit("u"))
    j = tickets(spark, d).where("name is not null").select(F.to_json(F.struct(F.col("id").alias("number"), "title", F.col("description").alias("body"), pull.alias("pull_request"), _one("comments", "body").alias("comments_list"))).alias("json"))
    return readers.github_issues(j)


@Q("SC08_gitlab_issues", ctes("t") + "SELECT '#' || CAST(id AS VARCHAR) AS name, title, description, coalesce(comments, '') AS comments FROM t")
def _(spark, d):
    note = lambda c, s: F.struct(c.alias("body"), F.lit(s).alias("system"))
    notes = F.filter(F.array(note(F.lit("moved"), True), note(F.col("comments"), False)), lambda n: n["body"].isNotNull())
    j = tickets(spark, d).select(F.to_json(F.struct(F.col("id").alias("iid"), "title", "description", notes.alias("notes"))).alias("json"))
    return readers.gitlab_issues(j)


@Q("SC09_gitlab_merge_links", "SELECT id AS issue, o_orderkey AS mr FROM (SELECT o_orderkey, o_orderkey % 97 AS id FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    o = table(spark, d, "orders")
    j = o.select(F.to_json(F.struct(F.col("o_orderkey").alias("iid"), F.when(F.col("o_orderstatus") == "F", "merged").otherwise("opened").alias("state"), F.array(F.struct((F.col("o_orderkey") % 97).alias("iid"))).alias("closes"))).alias("json"))
    return readers.gitlab_merge_links(j).select("issue", "mr")


@Q("SC10_youtrack_issues")
def _(spark, d):
    j = tickets(spark, d).select(F.to_json(F.struct(F.col("name").alias("idReadable"), F.col("title").alias("summary"), "description", _one("comments", "text").alias("comments"))).alias("json"))
    return readers.youtrack_issues(j)


@Q("SC12_connector_dispatch", ctes("t") + "SELECT s.source AS tracker, count(*) AS n FROM t JOIN task_split s ON s.task_id = t.id WHERE s.source IS NOT NULL GROUP BY 1")
def _(spark, d):
    t = tickets(spark, d).join(table(spark, d, "task_split").select(F.col("task_id").alias("id"), "source"), "id").where("source is not null")
    docs = {
        "jira": F.struct(F.col("name").alias("key")), "github": F.struct(F.col("id").alias("number")), "gitlab": F.struct(F.col("id").alias("iid")), "youtrack": F.struct(F.col("name").alias("idReadable")),
    }
    out = None
    for k, s in docs.items():
        r = readers.issues(t.where(F.col("source") == k).select(F.to_json(s).alias("json")), k).select(F.lit(k).alias("tracker"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("tracker").agg(F.count("*").alias("n"))


@Q("SC13_pending_tasks", ctes("t") + "SELECT name FROM t WHERE name IS NOT NULL AND title IS NULL")
def _(spark, d):
    return readers.pending_tasks(tickets(spark, d)).select("name")


@Q("SC14_projected_scan", "SELECT id, sha, task_name FROM rawdata")
def _(spark, d):
    return table(spark, d, "rawdata").select("id", "sha", "task_name")


@Q("SC15_commit_table", "SELECT 'rawdata' AS found")
def _(spark, d):
    name = f"w{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        sinks.create_collection(table(spark, d, "rawdata").select("id", "sha"), f"{name}.rawdata")
        return spark.createDataFrame([(readers.commit_table(spark, name),)], "found string")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


@Q("SK07_collections", "SELECT type, count(*) AS n FROM vec_collection WHERE vector IS NOT NULL GROUP BY type")
def _(spark, d):
    name = f"weft_{uuid.uuid4().hex[:8]}"
    v = table(spark, d, "vec_collection").where("vector is not null")
    for _ in range(2):  # recreated, so the second writing changes nothing
        sinks.create_collection(v, name)
    out = stage(spark.table(name).groupBy("type").agg(F.count("*").alias("n")), "collection")
    sinks.drop_collections(spark, name)
    return out


@Q("SK14_partitioned_results", "SELECT event_id, value, event_type FROM events")
def _(spark, d):
    at = _folder(spark, "results")
    sinks.write_results(table(spark, d, "events").select("event_id", "value", "event_type"), at, "event_type", "json")
    return spark.read.schema("event_id long, value double, event_type string").json(at)


@Q("P18_argument_caps", "SELECT path, count(*) AS n FROM rawdata WHERE path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, d):
    g = table(spark, d, "rawdata").where("path is not null").groupBy("path").agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "path").limit(R.cap(5000, "files"))


@Q("J08_unordered_self_join", ctes("tm") + "SELECT a.module AS l, b.module AS r, count(*) AS cnt FROM tm a JOIN tm b ON a.task_name = b.task_name AND a.module < b.module GROUP BY ALL")
def _(spark, d):
    from weftline.plans.base import task_modules

    return O.unordered_links(task_modules(spark, d), "task_name", "module")


@Q("J12_parent_walk", "WITH RECURSIVE n AS (SELECT DISTINCT id, parent_id, name FROM module_tree WHERE id IS NOT NULL), w(id, path) AS (SELECT id, name FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.path || '/' || n.name FROM n JOIN w ON n.parent_id = w.id) SELECT id, path FROM w")
def _(spark, d):
    return resolve_hierarchy(table(spark, d, "module_tree")).where("kind = 'tree'").select("id", "path")


@Q("A28_joined_diffs", "SELECT sha, substring(string_agg(substring(coalesce(diff, ''), 1, 4000), chr(10) ORDER BY id), 1, 4000) AS diff FROM rawdata WHERE sha IN (SELECT sha FROM rawdata WHERE sha <> '' GROUP BY sha HAVING count(DISTINCT path) <= 50 AND length(trim(split_part(arg_min(message, id) FILTER (message IS NOT NULL), chr(10), 1))) >= 8 AND NOT starts_with(lower(split_part(arg_min(message, id) FILTER (message IS NOT NULL), chr(10), 1)), 'merge ')) GROUP BY sha")
def _(spark, d):
    return P.commit_tasks(table(spark, d, "rawdata")).select("sha", "diff")


@Q("W01_ordinals", ctes("t") + "SELECT id, row_number() OVER (ORDER BY id) AS rn FROM t")
def _(spark, d):
    return P.ordinal(tickets(spark, d).select("id"), "id").withColumn("rn", F.col("rn").cast("long"))


@Q("W06_lagged_tokens", ctes("t", more="k AS (SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+'), lambda x: x <> '') AS ts FROM t), e AS (SELECT id, ts, unnest(range(1, len(ts) + 1)) AS i FROM k)") + "SELECT CASE WHEN i > 1 THEN ts[i - 1] END AS prev, ts[i] AS cur, count(*) AS cnt FROM e GROUP BY ALL")
def _(spark, d):
    t = tickets(spark, d).select("id", X.title_terms(F.col("title")).alias("ts"))
    return O.bigrams(t, "id", "ts").groupBy("prev", "cur").agg(F.count("*").alias("cnt"))


@Q("T02_topk_payload", _dual_base() + "SELECT query_id, path, round(score, 6) AS score, rank, 'task' AS type FROM b")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    return S.top_k(q, w, 5).select("query_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), F.lit("task").alias("type"))


@Q("T09_full_scan", "SELECT count(*) AS n, count(task_name) AS named FROM rawdata")
def _(spark, d):
    return table(spark, d, "rawdata").agg(F.count("*").alias("n"), F.count("task_name").alias("named"))


@Q("S02_difference", "SELECT DISTINCT name FROM task WHERE name IS NOT NULL EXCEPT SELECT task_name FROM rawdata")
def _(spark, d):
    return tickets(spark, d).where("name is not null").select("name").distinct().join(table(spark, d, "rawdata").select(F.col("task_name").alias("name")), "name", "left_anti")


@Q("S05_axes_product", "SELECT s AS source, t AS target, w AS win, p AS split FROM (SELECT unnest(['title', 'desc', 'comments']) AS s), (SELECT unnest(['file', 'module']) AS t), (SELECT unnest(['w100', 'w1000', 'all']) AS w), (SELECT unnest(['recent', 'modn']) AS p)")
def _(spark, d):
    axes = {"source": ["title", "desc", "comments"], "target": ["file", "module"], "win": ["w100", "w1000", "all"], "split": ["recent", "modn"]}
    return sinks.missing_variants(axes, spark.createDataFrame([], "source string, target string, win string, split string"))


@Q("F02_link_masks", "SELECT id, nullif(regexp_extract(message, '#([0-9]+)', 1), '') AS broad, nullif(regexp_extract(message, '[Ff]ixed\\s+#([0-9]+)', 1), '') AS fixed FROM rawdata")
def _(spark, d):
    m = F.col("message")
    return table(spark, d, "rawdata").select("id", X.extract_task_name(m, "broad").alias("broad"), X.extract_task_name(m, "fixed").alias("fixed"))


@Q("F04_token_sort_ratio")
def _(spark, d):
    def run(batches):
        for b in batches:
            yield b.assign(ratio=[matching.token_sort_ratio(x or "", y or "") for x, y in zip(b.a, b.b)], blocks=[matching.sequence_ratio(x or "", y or "") for x, y in zip(b.a, b.b)])

    # each change's message against its task's title
    n = lambda c: X.normalize_commit(F.col(c))
    j = changes(spark, d).join(tickets(spark, d).select("name", "title"), F.col("task_name") == F.col("name")).select(n("message").alias("a"), n("title").alias("b")).distinct()
    return j.mapInPandas(run, "a string, b string, ratio double, blocks double")


@Q("F09_title_terms", ctes("t") + "SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+'), lambda x: x <> '') AS terms FROM t")
def _(spark, d):
    return tickets(spark, d).select("id", X.title_terms(F.col("title")).alias("terms"))


@Q("F27_numbered_names", ctes("t") + "SELECT id, regexp_extract_all('1. **' || name || '** (similarity: 0.9)', '[0-9]+\\.\\s+\\*\\*([^*]+)\\*\\*', 1) AS names FROM t WHERE name IS NOT NULL")
def _(spark, d):
    line = F.concat(F.lit("1. **"), F.col("name"), F.lit("** (similarity: 0.9)"))
    return tickets(spark, d).where("name is not null").select("id", X.numbered_names(line).alias("names"))


@Q("F26_json_lists", "SELECT event_id, [event_type, CAST(user_id AS VARCHAR)] AS files FROM events")
def _(spark, d):
    text = F.concat(F.lit("Here: "), F.to_json(F.struct(F.array("event_type", F.col("user_id").cast("string")).alias("selected_files"))), F.lit(" end"))
    return table(spark, d, "events").select("event_id", X.json_list(text).alias("files"))


@Q("F30_confidence", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE 50.0 END AS confidence FROM events")
def _(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so\nConfidence: "), F.col("user_id").cast("string"), F.lit("%"))).otherwise("none")
    return table(spark, d, "events").select("event_id", X.confidence(text).alias("confidence"))


@Q("F29_lengths", "SELECT id, CAST(length(message) AS INTEGER) AS n, substring(message, 1, 10) AS head FROM rawdata")
def _(spark, d):
    return table(spark, d, "rawdata").select("id", F.length("message").alias("n"), F.left("message", F.lit(10)).alias("head"))


@Q("U03_word_vector_mean")
def _(spark, d):
    t = tickets(spark, d).select("id", X.title_terms(F.coalesce("title", F.lit(""))).alias("ts"))
    return word_mean(title_words(spark, d), word2vec(t, "ts", 16), "id", "term", 16)


@Q("U07_vectorizer_factory")
def _(spark, d):
    out = None
    for name in sorted(VECTORIZERS):
        v = embed(tickets(spark, d), "id", X.combine_fields(F.col("title")), name, 32).withColumn("model", F.lit(name))
        out = v if out is None else out.unionByName(v)
    return out


@Q("Q02_similar_tasks", _dual_base() + "SELECT query_id, path, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS relevance FROM b")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    return S.top_k(q, w, R.cap(5, "tasks")).select("query_id", "path", F.round("score", 6).alias("score"), X.relevance(F.col("score")).alias("relevance"))


@Q("Q04_list_tasks", core.sql["A39_list_tasks"])
def _(spark, d):
    return R.list_tasks(table(spark, d, "rawdata"), 100)


@Q("Q08_task_summary", core.sql["A40_task_summary"])
def _(spark, d):
    return R.task_summary(table(spark, d, "rawdata"))


@Q("Q07_file_content", core.sql["SC22_file_contents"])
def _(spark, d):
    return core.queries["SC22_file_contents"](spark, d)


@Q("Q21_batch_search", _dual_base() + "SELECT query_id, path, round(score, 6) AS score FROM b WHERE rank = 1")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    return S.top_k(q, w, 1).select("query_id", "path", F.round("score", 6).alias("score"))
