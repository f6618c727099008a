"""Queries of look-ups, analysis, text functions, matching, sources and sinks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.functions.names import commit_time
from weftline.operators import analysis as A
from weftline.operators import embed as E
from weftline.operators import matching as G
from weftline.operators import search as S
from weftline.operators import serving as R
from weftline.plans.base import changes, ctes, tickets, title_words
from weftline.plans.registry import core
from weftline.plans.retrieval import _MOD, dual_sides, joined_vectors, module_changes, centroids, search_sides
from weftline.runtime import shared_dir, stage, table
from weftline.sources import readers, sinks

Q = core.query
HOT = "LUMO-1"


def raw(spark, d):
    return table(spark, d, "rawdata")


# ---- look-ups
@Q("A39_list_tasks", "SELECT task_name, changes, files, CASE WHEN length(message) > 200 THEN substring(message, 1, 200) || '...' ELSE message END AS message FROM (SELECT task_name, count(*) AS changes, count(DISTINCT path) AS files, max(message) AS message FROM rawdata WHERE task_name IS NOT NULL AND task_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)")
def _(spark, d):
    return R.list_tasks(raw(spark, d), 100)


@Q("A40_task_summary", "SELECT task_name, count(*) AS changes, count(DISTINCT path) AS files, CAST(coalesce(sum(length(diff)), 0) AS BIGINT) AS diff_chars, coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (path IS NOT NULL))[1:10], '|'), '') AS paths FROM rawdata WHERE task_name IS NOT NULL AND task_name <> '' GROUP BY task_name")
def _(spark, d):
    return R.task_summary(raw(spark, d))


@Q("A41_migration_stats", "SELECT count(*) AS total, count(DISTINCT task_name) AS tasks, count(DISTINCT path) AS files, round(count(*) / count(DISTINCT task_name), 4) AS per_task FROM rawdata WHERE task_name IS NOT NULL AND path IS NOT NULL")
def _(spark, d):
    return sinks.serving_rows(raw(spark, d)).agg(F.count("*").alias("total"), F.countDistinct("task_name").alias("tasks"), F.countDistinct("path").alias("files"), F.round(F.count("*") / F.countDistinct("task_name"), 4).alias("per_task"))


@Q("A42_file_summary", "SELECT task_name, max(id) AS last_id, count(*) AS changes FROM rawdata WHERE path = 'api/query/NodeFormatterHelper.ts' AND task_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def _(spark, d):
    return R.file_summary(raw(spark, d), "api/query/NodeFormatterHelper.ts")


@Q("T08_top_files", "SELECT path, count(*) AS changes FROM rawdata WHERE path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return raw(spark, d).where("path is not null").groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.col("changes").desc(), "path").limit(10)


@Q("Q05_task_files", f"SELECT id, path, CAST(length(diff) AS INTEGER) AS diff_length FROM rawdata WHERE task_name = '{HOT}'")
def _(spark, d):
    return R.task_files(raw(spark, d), HOT)


@Q("Q06_file_diff", f"SELECT id, task_name, path, message, diff FROM rawdata WHERE task_name = '{HOT}' AND path = 'api/query/NodeFormatterHelper.ts' ORDER BY id LIMIT 1")
def _(spark, d):
    return R.file_diff(raw(spark, d), HOT, "api/query/NodeFormatterHelper.ts")


@Q("Q10_module_info", "SELECT id, path, type, CAST(len(vector) AS INTEGER) AS dim FROM vec_collection WHERE path = 'core' ORDER BY id LIMIT 1")
def _(spark, d):
    return R.module_info(table(spark, d, "vec_collection"), "core")


@Q("Q11_module_fingerprints", ctes("r", more=_MOD + ", dm AS (SELECT DISTINCT module, task_name FROM m)") + "SELECT module, count(*) AS num_tasks, array_to_string(list_sort(list(task_name))[1:20], '|') AS task_ids FROM dm GROUP BY module")
def _(spark, d):
    return R.module_fingerprints(module_changes(spark, d))


@Q("Q13_module_evolution", ctes("r", more=_MOD) + "SELECT module, strftime(date_trunc('month', x.created_at AT TIME ZONE 'UTC'), '%Y-%m') AS month, count(*) AS changes, count(DISTINCT m.task_name) AS tasks FROM m JOIN rawdata x USING (id) GROUP BY ALL")
def _(spark, d):
    at = raw(spark, d).select("id", "created_at")
    return R.module_evolution(module_changes(spark, d).join(at, "id"), F.col("created_at"))


@Q("Q14_ui_changes", f"SELECT id, path, CASE WHEN length(diff) > 200 THEN substring(diff, 1, 200) || '...' ELSE diff END AS diff FROM rawdata WHERE task_name = '{HOT}' ORDER BY id LIMIT 50")
def _(spark, d):
    return R.ui_changes(raw(spark, d), HOT)


@Q("Q09_collection_info", "SELECT type, count(*) AS n, count(vector) AS vectors, CAST(min(len(vector)) AS INTEGER) AS least_dim, CAST(max(len(vector)) AS INTEGER) AS most_dim FROM vec_collection GROUP BY type")
def _(spark, d):
    return sinks.collection_info(table(spark, d, "vec_collection"))


@Q("Q17_task_enrichment")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    return R.enrich(S.top_k(q, w, 10), tickets(spark, d), raw(spark, d))


@Q("A38_project_stats", "WITH r AS (SELECT count(*) AS rows, count(DISTINCT sha) AS commits, count(DISTINCT sha) FILTER (task_name IS NOT NULL AND task_name <> '') AS linked_commits, count(DISTINCT task_name) FILTER (task_name <> '') AS linked_tasks, min(cmt_date) AS first_date, max(cmt_date) AS last_date FROM rawdata), t AS (SELECT count(*) AS tasks, count(*) FILTER (coalesce(description, '') <> '') AS with_description, count(*) FILTER (coalesce(comments, '') <> '') AS with_comments FROM (SELECT DISTINCT id, name, title, description, comments FROM task)) SELECT *, round(rows / greatest(commits, 1), 2) AS files_per_commit, round(100 * linked_commits / greatest(commits, 1), 2) AS linkage_pct, linked_tasks >= 600 AS tickets_usable, commits >= 600 AS commits_usable FROM r, t")
def _(spark, d):
    return A.project_stats(raw(spark, d), tickets(spark, d))


@Q("X16_unit_auto_mode", "SELECT CASE WHEN avg(CASE WHEN task_name IS NOT NULL AND task_name <> '' THEN 1 ELSE 0 END) > 0.5 THEN 'tasks' ELSE 'commits' END AS mode FROM rawdata")
def _(spark, d):
    share = F.avg(F.coalesce(F.col("task_name") != "", F.lit(False)).cast("int"))
    return raw(spark, d).agg(F.when(share > 0.5, "tasks").otherwise("commits").alias("mode"))


# ---- analysis; runs stand in events: type = model, users give the axes, every tenth failed
_RUN = "run AS (SELECT event_id AS id, event_type AS model, CASE user_id % 3 WHEN 0 THEN 'w100' WHEN 1 THEN 'w1000' ELSE 'all' END AS win, CASE WHEN user_id % 2 = 0 THEN 'recent' ELSE 'modn' END AS split, 'p' || CAST(user_id % 5 AS VARCHAR) AS project, value, event_id % 10 <> 0 AS ok, event_id % 3 = 0 AS reused, value / 3 AS part FROM events)"


def runs(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.when(u % 3 == 0, "w100").when(u % 3 == 1, "w1000").otherwise("all").alias("win"), F.when(u % 2 == 0, "recent").otherwise("modn").alias("split"),
        F.concat(F.lit("p"), (u % 5).cast("string")).alias("project"), "value", (F.col("event_id") % 10 != 0).alias("ok"), (F.col("event_id") % 3 == 0).alias("reused"), (F.col("value") / 3).alias("part"),
    )


_STATS = "count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max, round(median(value), 6) AS median"


def _rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@Q("A32_run_metrics", f"WITH {_RUN} SELECT win, {_STATS} FROM run GROUP BY win")
def _(spark, d):
    return _rounded(A.describe(runs(spark, d), "win", "value"), "mean", "std", "median")


@Q("A33_model_comparison", f"WITH {_RUN} SELECT model, {_STATS} FROM run WHERE ok GROUP BY model")
def _(spark, d):
    return _rounded(A.describe(runs(spark, d).where("ok"), "model", "value"), "mean", "std", "median")


@Q("A34_parameter_impact", f"WITH {_RUN}, u AS (SELECT 'model' AS param, model AS setting, value FROM run UNION ALL SELECT 'win', win, value FROM run UNION ALL SELECT 'split', split, value FROM run) SELECT param, setting, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM u GROUP BY ALL")
def _(spark, d):
    return _rounded(A.parameter_impact(runs(spark, d), ["model", "win", "split"], "value"), "mean", "std")


@Q("A35_success_shares", f"WITH {_RUN} SELECT model, count(*) AS runs, round(100 * avg(CAST(ok AS INTEGER)), 6) AS success_pct, round(100 * avg(CAST(reused AS INTEGER)) FILTER (ok), 6) AS reuse_pct, round(100 * sum(part) FILTER (ok) / sum(value) FILTER (ok), 6) AS part_pct FROM run GROUP BY model")
def _(spark, d):
    return _rounded(A.success_shares(runs(spark, d), "model", F.col("ok"), F.col("reused"), "part", "value"), "success_pct", "reuse_pct", "part_pct")


@Q("A36_pivot_means", f"WITH {_RUN} SELECT model, round(avg(value) FILTER (split = 'modn'), 6) AS modn, round(avg(value) FILTER (split = 'recent'), 6) AS recent FROM run GROUP BY model")
def _(spark, d):
    return _rounded(A.pivot_means(runs(spark, d), "model", "split", ["modn", "recent"], "value"), "modn", "recent")


@Q("A37_dashboard", f"WITH {_RUN} SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(win) = 0 THEN 'win' WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS axis, coalesce(model, win, split) AS setting, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS best FROM run GROUP BY GROUPING SETS ((model), (win), (split), ())")
def _(spark, d):
    return _rounded(A.dashboard(runs(spark, d), ["model", "win", "split"], "value"), "mean")


@Q("A43_group_rows", f"WITH {_RUN} SELECT project, split, count(*) AS n FROM run GROUP BY ALL")
def _(spark, d):
    return runs(spark, d).groupBy("project", "split").agg(F.count("*").alias("n"))


_PM = "pm AS (SELECT project, model, win, round(avg(value), 6) AS v FROM run GROUP BY ALL)"


def project_means(spark, d):
    return runs(spark, d).groupBy("project", "model", "win").agg(F.round(F.avg("value"), 6).alias("v"))


@Q("A44_wins", f"WITH {_RUN}, {_PM}, k AS (SELECT *, rank() OVER (PARTITION BY project ORDER BY v DESC) AS r FROM pm) SELECT model, win, count(*) FILTER (r = 1) AS wins, round(avg(v), 5) AS pooled FROM k GROUP BY ALL")
def _(spark, d):
    return _rounded(A.wins(project_means(spark, d), "project", ["model", "win"], "v"), "pooled", n=5)


@Q("A45_paired_models", f"WITH {_RUN}, {_PM}, x AS (SELECT b.v - a.v AS dv FROM pm a JOIN pm b USING (project, win) WHERE a.model = 'click' AND b.model = 'view') SELECT count(*) AS pairs, round(avg(dv), 5) AS mean_diff, round(median(dv), 5) AS median_diff, round(avg(CASE WHEN dv > 0 THEN 1 ELSE 0 END), 6) AS win_share FROM x")
def _(spark, d):
    r = A.paired(project_means(spark, d), ["project", "win"], "model", "click", "view", "v")
    return _rounded(_rounded(r, "mean_diff", "median_diff", n=5), "win_share")


@Q("T05_top_configurations", f"WITH {_RUN} SELECT id, model, value FROM run WHERE ok ORDER BY value DESC, id LIMIT 10")
def _(spark, d):
    return A.leaderboard(runs(spark, d).where("ok").select("id", "model", "value"), "value", 10, False)


@Q("T06_leaderboard", f"WITH {_RUN} SELECT id, model, value FROM run ORDER BY value, id LIMIT 5")
def _(spark, d):
    return A.leaderboard(runs(spark, d).select("id", "model", "value"), "value", 5)


@Q("T07_compare_runs", f"WITH {_RUN}, {_PM}, p AS (SELECT project || '/' || win AS key, avg(v) FILTER (model = 'click') AS click, avg(v) FILTER (model = 'view') AS view FROM pm GROUP BY 1) SELECT key, round(click, 6) AS click, round(view, 6) AS view, round(least(click, view), 6) AS least FROM p WHERE click IS NOT NULL AND view IS NOT NULL")
def _(spark, d):
    p = project_means(spark, d).withColumn("key", F.concat_ws("/", "project", "win"))
    return _rounded(A.compare_runs(p, ["click", "view"], "model", "key", "v"), "click", "view", "least")


@Q("P16_success_filter", f"WITH {_RUN} SELECT id FROM run WHERE ok")
def _(spark, d):
    return runs(spark, d).where("ok").select("id")


@Q("S01_union_results", f"WITH {_RUN} SELECT id, model, NULL AS win FROM run WHERE ok UNION ALL SELECT id, model, win FROM run WHERE NOT ok")
def _(spark, d):
    r = runs(spark, d)
    return r.where("ok").select("id", "model").unionByName(r.where("not ok").select("id", "model", "win"), allowMissingColumns=True)


@Q("S03_intersection", ctes("t") + "SELECT DISTINCT name FROM t INTERSECT SELECT DISTINCT task_name FROM rawdata")
def _(spark, d):
    return tickets(spark, d).select("name").intersect(raw(spark, d).select(F.col("task_name").alias("name")))


@Q("S04_distinct_paths", "SELECT DISTINCT path FROM rawdata")
def _(spark, d):
    return raw(spark, d).select("path").distinct()


_AX = {"model": ["click", "view", "signup", "error", "purchase", "other"], "win": ["w100", "w1000", "all"], "split": ["recent", "modn"]}


@Q("SK13_missing_variants", f"WITH {_RUN}, x AS (SELECT m AS model, w AS win, s AS split FROM (SELECT unnest(['click', 'view', 'signup', 'error', 'purchase', 'other']) AS m), (SELECT unnest(['w100', 'w1000', 'all']) AS w), (SELECT unnest(['recent', 'modn']) AS s)) SELECT * FROM x EXCEPT SELECT model, win, split FROM run WHERE value > 60")
def _(spark, d):
    return sinks.missing_variants(_AX, runs(spark, d).where("value > 60").select("model", "win", "split").distinct())


# ---- text functions
@Q("F01_extract_task_id", "SELECT id, nullif(regexp_extract(message, '\\[([A-Z]+-[0-9]+)\\]', 1), '') AS bracketed, nullif(regexp_extract(message, '^[A-Z]+-[0-9]+', 0), '') AS simple FROM rawdata")
def _(spark, d):
    return raw(spark, d).select("id", X.extract_task_name(F.col("message")).alias("bracketed"), X.extract_task_name(F.col("message"), "simple").alias("simple"))


# words are bounded by characters of no word, so neighbouring ones are found in two passes
@Q("F03_normalize_commit_all", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(coalesce(message, ''), chr(10), 1)), '[\[\](){}<>]', ' ', 'g'), '(^|[^\p{L}\p{N}_])(fix(es|ed)?|close[sd]?|resolve[sd]?|revert|merge|update|refactor|add(s|ed)?|remove[sd]?|bump|wip|nit|minor|style|cleanup|typo|test[s]?)($|[^\p{L}\p{N}_])', '\1 \5', 'g'), '(^|[^\p{L}\p{N}_])(fix(es|ed)?|close[sd]?|resolve[sd]?|revert|merge|update|refactor|add(s|ed)?|remove[sd]?|bump|wip|nit|minor|style|cleanup|typo|test[s]?)($|[^\p{L}\p{N}_])', '\1 \5', 'g'), '[^\p{L}\p{N}_\s\x0b\x85\p{Z}]', ' ', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g')) AS text FROM rawdata")
def _(spark, d):
    return raw(spark, d).select("id", X.normalize_commit(F.col("message")).alias("text"))


@Q("F12_html_clean", r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.html_clean(F.col("text")).alias("text"))


@Q("F13_file_path", "SELECT id, CASE WHEN path IS NULL OR path = '' THEN 'unknown' ELSE regexp_replace(replace(path, '\\', '/'), '^\\s+|\\s+$', '', 'g') END AS file FROM rawdata")
def _(spark, d):
    return raw(spark, d).select("id", X.file_path(F.col("path")).alias("file"))


@Q("F14_module_path", ctes("r", more=_MOD) + "SELECT id, module FROM m")
def _(spark, d):
    return module_changes(spark, d).select("id", "module")


@Q("F16_root_module", "SELECT id, CASE WHEN contains(s, '.') THEN '' ELSE s END AS module FROM (SELECT id, split_part(regexp_replace(coalesce(path, ''), '^/+|/+$', '', 'g'), '/', 1) AS s FROM rawdata)")
def _(spark, d):
    return raw(spark, d).select("id", X.root_module(F.col("path")).alias("module"))


@Q("F17_path_prefixes", "SELECT id, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS parts FROM rawdata WHERE path IS NOT NULL")
def _(spark, d):
    return raw(spark, d).where("path is not null").select("id", F.size(X.path_prefixes(F.col("path"))).alias("parts"))


@Q("F18_common_prefix", ctes("f", more="x AS (SELECT task_name, min(file) AS a, max(file) AS b FROM f GROUP BY 1)") + "SELECT task_name, CAST(len(list_filter(range(1, least(len(string_split(a, '/')), len(string_split(b, '/'))) + 1), lambda k: string_split(a, '/')[1:k] = string_split(b, '/')[1:k])) AS INTEGER) AS shared FROM x")
def _(spark, d):
    from weftline.plans.base import task_files

    x = task_files(spark, d).groupBy("task_name").agg(F.min("file").alias("a"), F.max("file").alias("b"))
    return x.select("task_name", X.common_prefix_length(F.split("a", "/"), F.split("b", "/")).alias("shared"))


@Q("F23_short_names", "SELECT DISTINCT path, CASE WHEN length(path) > 52 THEN substring(path, 1, 43) || '_' || substring(md5(path), 1, 8) ELSE path END AS short FROM rawdata WHERE path IS NOT NULL")
def _(spark, d):
    return raw(spark, d).where("path is not null").select("path", X.short_name(F.col("path")).alias("short")).distinct()


@Q("F24_commit_dates")
def _(spark, d):
    return raw(spark, d).select("id", commit_time(F.col("cmt_date"), F.col("created_at")).alias("ts"))


@Q("F25_previews", ctes("t") + "SELECT id, CASE WHEN length(description) > 200 THEN substring(description, 1, 200) || '...' ELSE description END AS preview FROM t")
def _(spark, d):
    return tickets(spark, d).select("id", X.preview(F.col("description")).alias("preview"))


@Q("F31_head_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS head FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.head_lines(F.col("text"), 3).alias("head"))


@Q("P01_concat_fields", ctes("t") + "SELECT id, concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(comments, '')) AS text FROM t")
def _(spark, d):
    return tickets(spark, d).select("id", X.concat_fields(F.col("title"), F.col("description"), F.col("comments")).alias("text"))


@Q("P02_combine_fields", ctes("t") + "SELECT id, coalesce(nullif(array_to_string(list_filter([regexp_replace(coalesce(title, ''), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), regexp_replace(coalesce(description, ''), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')], lambda x: x <> ''), ' '), ''), 'empty_task') AS text FROM t")
def _(spark, d):
    return tickets(spark, d).select("id", X.combine_fields(F.col("title"), F.col("description")).alias("text"))


@Q("P03_null_guards", ctes("r") + "SELECT id FROM r")
def _(spark, d):
    return changes(spark, d).select("id")


@Q("P04_any_text", ctes("t") + "SELECT id FROM t WHERE title IS NOT NULL OR description IS NOT NULL OR comments IS NOT NULL")
def _(spark, d):
    return tickets(spark, d).where("title is not null or description is not null or comments is not null").select("id")


@Q("P05_threshold_filter", "SELECT term FROM term_rank WHERE task_cnt > 5 AND file_cnt > 20")
def _(spark, d):
    return table(spark, d, "term_rank").where("task_cnt > 5 and file_cnt > 20").select("term")


@Q("P06_in_list", ctes("t") + "SELECT id, name FROM t WHERE id IN (SELECT task_id FROM task_split WHERE split = 'test')")
def _(spark, d):
    ids = table(spark, d, "task_split").where("split = 'test'").select(F.col("task_id").alias("id"))
    return tickets(spark, d).select("id", "name").join(ids, "id", "left_semi")


@Q("P07_unmatched_commits", "SELECT DISTINCT sha, message FROM rawdata WHERE task_name IS NULL AND message IS NOT NULL AND message <> ''")
def _(spark, d):
    return raw(spark, d).where("task_name is null and message is not null and message <> ''").select("sha", "message").distinct()


@Q("P08_pending_tasks", ctes("t") + "SELECT id, name FROM t WHERE name IS NOT NULL AND title IS NULL")
def _(spark, d):
    return readers.pending_tasks(tickets(spark, d)).select("id", "name")


@Q("P09_titled_tasks", ctes("t") + "SELECT id, title FROM t WHERE title IS NOT NULL AND title <> ''")
def _(spark, d):
    return tickets(spark, d).where("title is not null and title <> ''").select("id", "title")


@Q("P11_like", "SELECT DISTINCT path FROM vec_collection WHERE path LIKE 'core/%' AND (type = 'file' OR type = 'module')")
def _(spark, d):
    return table(spark, d, "vec_collection").where("path like 'core/%' and (type = 'file' or type = 'module')").select("path").distinct()


@Q("P12_exists", "SELECT path FROM (SELECT DISTINCT path FROM rawdata WHERE path IS NOT NULL) p WHERE EXISTS (SELECT 1 FROM vec_collection v WHERE v.type = 'file' AND v.path = p.path)")
def _(spark, d):
    v = table(spark, d, "vec_collection").where("type = 'file'").select("path")
    return raw(spark, d).select("path").where("path is not null").distinct().join(v, "path", "left_semi")


@Q("P14_late_rows", "SELECT event_id FROM events WHERE TIMESTAMP '2024-01-02 00:00:00' - ts > INTERVAL 5 HOUR")
def _(spark, d):
    return table(spark, d, "events").where("timestamp_ntz'2024-01-02 00:00:00' - ts > interval '5' hour").select("event_id")


@Q("P15_relevance", "SELECT event_id, CASE WHEN value / 50 >= 0.7 THEN 'High' WHEN value / 50 >= 0.5 THEN 'Medium' ELSE 'Low' END AS bucket FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.relevance(F.col("value") / 50).alias("bucket"))


# ---- vectors
_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)"


@Q("F20_distances", f"WITH {_E} SELECT vec_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 8) AS cosine, round(list_distance(v, q), 8) AS euclidean, round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 8) AS manhattan FROM e, q")
def _(spark, d):
    e = table(spark, d, "embeddings")
    # one row of 64 numbers
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first().embedding])
    v = F.col("embedding")
    return e.select("vec_id", F.round(V.cosine(v, q), 8).alias("cosine"), F.round(V.euclidean(v, q), 8).alias("euclidean"), F.round(V.manhattan(v, q), 8).alias("manhattan"))


@Q("F19_normalized", f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 8) AS total FROM e")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.total(V.normalize(F.col("embedding"))), 8).alias("total"))


@Q("F21_resized", f"WITH {_E} SELECT vec_id, round(list_sum(v[1:10]), 8) AS short FROM e")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.total(V.resize(F.col("embedding"), 10)), 8).alias("short"))


@Q("F22_json_vectors", f"WITH {_E} SELECT vec_id, round(list_sum(v), 6) AS total FROM e")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.to_json(F.struct(F.col("embedding").cast("array<double>").alias("v"))).alias("j"))
    return e.select("vec_id", F.round(V.total(F.from_json("j", "struct<v:array<double>>")["v"]), 6).alias("total"))


@Q("X20_quantized_cosine")
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first().embedding])
    return e.select("vec_id", F.round(V.cosine(V.quantize(F.col("embedding")), V.quantize(q)), 6).alias("similarity"))


@Q("X22_noise_by_centroid", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), x AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL), c AS (SELECT label, list(c ORDER BY i) AS c FROM x GROUP BY label) SELECT vec_id, round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 6) AS similarity FROM e JOIN c USING (label)")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    c = e.groupBy("label").agg(*V.mean_columns("v", 64)).select("label", V.pack(64).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(V.cosine(F.col("v"), F.col("c")), 6).alias("similarity"))


@Q("X34_composed_vectors", f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2])), 8) AS hadamard, round(list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 64, 8) AS mse FROM e, q")
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first().embedding])
    v = F.col("embedding")
    eu = V.euclidean(v, q)
    return e.select("vec_id", F.round(V.dot(v, q), 8).alias("hadamard"), F.round(eu * eu / 64, 8).alias("mse"))


# ---- embedding and matching
@Q("U01_hash_embed")
def _(spark, d):
    return E.embed(tickets(spark, d), "id", X.combine_fields(F.col("title"), F.col("description")))


@Q("U02_word2vec")
def _(spark, d):
    t = tickets(spark, d).select("id", X.title_terms(F.coalesce("title", F.lit(""))).alias("ts"))
    v = E.word2vec(t, "ts")
    return E.word_mean(title_words(spark, d), v, "id", "term", 32)


@Q("U10_projection")
def _(spark, d):
    return E.projection(table(spark, d, "embeddings"), "vec_id", "embedding")


def _sides(spark, d):
    n = lambda c: X.normalize_commit(F.col(c))
    m = raw(spark, d).where("task_name is null and message is not null").select(n("message").alias("message")).distinct()
    return m, tickets(spark, d).select(F.col("id").alias("title_id"), n("title").alias("title"))


@Q("J10_fuzzy_match")
def _(spark, d):
    return G.best_titles(*_sides(spark, d), "token_sort", 75.0)


@Q("J10_sequence_match")
def _(spark, d):
    return G.best_titles(*_sides(spark, d), "sequence", 80.0)


# ---- sources and sinks: round trips through the shared folder
def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/weftline-tables/{name}-{uuid.uuid4().hex[:10]}"


@Q("SC17_csv_results", f"WITH {_RUN} SELECT id, model, win, value FROM run")
def _(spark, d):
    at = _folder(spark, "csv")
    sinks.write_results(runs(spark, d).select("id", "model", "win", "value"), at)
    return readers.csv_results(spark, at).select(F.col("id").cast("long").alias("id"), "model", "win", "value")


@Q("SC18_globbed_results", f"WITH {_RUN} SELECT id, value, project, split AS task_unit FROM run")
def _(spark, d):
    at = _folder(spark, "glob")
    r = runs(spark, d).select("id", "value", "project", "split")
    for p in [f"p{i}" for i in range(5)]:
        for u in ("recent", "modn"):
            r.where((F.col("project") == p) & (F.col("split") == u)).select("id", "value").coalesce(1).write.option("header", True).csv(f"{at}/{p}/{u}")
    return readers.globbed_results(spark, at, "id long, value double")


@Q("SC19_run_log", "SELECT 'value' AS name, CAST(event_id AS INTEGER) AS run, value AS number FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("value_"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("key"), F.col("value").cast("string").alias("value"))
    return readers.run_log(e).select("name", "run", "number")


@Q("SC21_glove_scan", "SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def _(spark, d):
    at = _folder(spark, "glove")
    e = table(spark, d, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")).alias("value"))
    e.unionByName(spark.createDataFrame([("broken 1 2",)], "value string")).write.text(at)
    return readers.glove_vectors(spark, at, 64).select("word", F.round(V.total(F.col("v")), 6).alias("total"))


@Q("SC16_serving_copy", "SELECT id, task_name, path, message, diff FROM rawdata WHERE task_name IS NOT NULL AND path IS NOT NULL")
def _(spark, d):
    return stage(sinks.serving_rows(raw(spark, d)), "serving")


@Q("SK01_insert_or_ignore", "SELECT id, name, title FROM task QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1")
def _(spark, d):
    return sinks.insert_or_ignore(table(spark, d, "task").select("id", "name", "title"), ["name"], "id")


@Q("SK03_upsert", ctes("t", more="n AS (SELECT id, name, 'new ' || coalesce(title, '') AS title FROM t WHERE id % 3 = 0)") + "SELECT id, name, title FROM t WHERE name NOT IN (SELECT name FROM n WHERE name IS NOT NULL) UNION ALL SELECT * FROM n")
def _(spark, d):
    t = tickets(spark, d).select("id", "name", "title")
    n = t.where("id % 3 = 0").withColumn("title", F.concat(F.lit("new "), F.coalesce("title", F.lit(""))))
    return sinks.upsert(t, n, "name", "id")


@Q("SK04_fill_task_names", "WITH f AS (SELECT sha, min(task_name) AS n FROM rawdata WHERE task_name IS NOT NULL GROUP BY sha) SELECT id, coalesce(task_name, n) AS task_name FROM rawdata LEFT JOIN f USING (sha)")
def _(spark, d):
    r = raw(spark, d)
    return sinks.fill_task_names(r.select("id", "sha", "task_name"), r.where("task_name is not null").select("sha", "task_name")).select("id", "task_name")


@Q("SK05_new_task_names", "SELECT DISTINCT task_name AS name FROM rawdata WHERE task_name <> '' AND task_name NOT IN (SELECT name FROM task WHERE name IS NOT NULL)")
def _(spark, d):
    return sinks.new_task_names(raw(spark, d), table(spark, d, "task"))


@Q("SK06_match_log", "SELECT sha, task_name, min(id) AS id FROM rawdata WHERE task_name IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return sinks.insert_or_ignore(raw(spark, d).where("task_name is not null").select("sha", "task_name", "id"), ["sha", "task_name"], "id")


@Q("SK09_task_collection", ctes("t") + "SELECT id, name AS path, 'task' AS type, substring(coalesce(title, ''), 1, 500) AS title, substring(coalesce(description, ''), 1, 500) AS description, coalesce(comments, '') <> '' AS has_comments FROM t")
def _(spark, d):
    return sinks.task_collection(tickets(spark, d)).select("id", "path", "type", "metadata.title", "metadata.description", "metadata.has_comments")


@Q("SK11_backup_restore", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    at = _folder(spark, "backup")
    sinks.backup(table(spark, d, "events").select("event_id", "event_type", "value"), at, "event_type")
    return sinks.restore(spark, at, "event_id long, value double, event_type string")
