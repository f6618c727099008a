"""Queries of joins, splits, centroids, search and metrics."""

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.operators import metrics as M
from weftline.operators import search as S
from weftline.operators import splits as P
from weftline.plans.base import DIM, changes, ctes, task_files, task_vectors, tickets
from weftline.plans.registry import core
from weftline.runtime import stage, table

Q = core.query

# ---- joins
_MOD = "m AS (SELECT id, sha, task_name, path, CASE WHEN contains(replace(path, '\\', '/'), '/') THEN split_part(regexp_replace(replace(path, '\\', '/'), '^\\s+|\\s+$', '', 'g'), '/', 1) ELSE 'root' END AS module FROM r)"


def module_changes(spark, d):
    return changes(spark, d).select("id", "sha", "task_name", "path", X.module_path(F.col("path")).alias("module"))


@Q("J01_task_change_join", ctes("t", "r") + "SELECT t.id AS task_id, r.id AS change_id, r.path FROM t JOIN r ON t.name = r.task_name")
def _(spark, d):
    t = tickets(spark, d).select(F.col("id").alias("task_id"), "name")
    return t.join(changes(spark, d).select(F.col("id").alias("change_id"), "path", "task_name"), F.col("name") == F.col("task_name")).select("task_id", "change_id", "path")


@Q("J02_module_file_task_join", ctes("t", "r", more=_MOD) + "SELECT m.module, t.id AS task_id, count(*) AS changes, count(DISTINCT m.path) AS files FROM m JOIN t ON t.name = m.task_name JOIN task_split s ON s.task_id = t.id WHERE s.split = 'train' GROUP BY ALL")
def _(spark, d):
    s = table(spark, d, "task_split").where("split = 'train'").select(F.col("task_id").alias("sid"))
    t = tickets(spark, d).select(F.col("id").alias("task_id"), "name").join(s, F.col("task_id") == F.col("sid"))
    # changes are counted by module, task and path before the joins
    m = module_changes(spark, d).groupBy("module", "task_name", "path").agg(F.count("*").alias("c"))
    return m.join(t, m.task_name == t.name).groupBy("module", "task_id").agg(F.sum("c").alias("changes"), F.count("*").alias("files"))


@Q("J03_token_module_join", ctes("tt", "tm") + "SELECT module, term, CAST(sum(cnt) AS BIGINT) AS cnt FROM tt JOIN tm ON tt.name = tm.task_name GROUP BY ALL")
def _(spark, d):
    from weftline.plans.base import task_modules, title_term_counts

    t = title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term", "cnt")
    return t.join(task_modules(spark, d), "task_name").groupBy("module", "term").agg(F.sum("cnt").alias("cnt"))


@Q("J04_diff_left_join", ctes("t", more="x AS (SELECT task_name, sum(length(diff)) AS n FROM rawdata WHERE diff IS NOT NULL GROUP BY 1)") + "SELECT t.id, CAST(x.n AS BIGINT) AS diff_chars FROM t LEFT JOIN x ON x.task_name = t.name")
def _(spark, d):
    x = table(spark, d, "rawdata").where("diff is not null").groupBy("task_name").agg(F.sum(F.length("diff")).alias("diff_chars"))
    t = tickets(spark, d).select("id", "name")
    return t.join(x, t.name == x.task_name, "left").select("id", "diff_chars")


@Q("J05_semi_train", ctes("r") + "SELECT r.id FROM r SEMI JOIN (SELECT t.name FROM task t JOIN task_split s ON s.task_id = t.id WHERE split = 'train') x ON x.name = r.task_name")
def _(spark, d):
    s = table(spark, d, "task_split").where("split = 'train'").select("task_id")
    t = tickets(spark, d)
    return changes(spark, d).join(t.join(s, t.id == s.task_id).select("name"), F.col("task_name") == F.col("name"), "left_semi").select("id")


@Q("J06_anti_train", ctes("t") + "SELECT id FROM t WHERE id NOT IN (SELECT task_id FROM task_split WHERE split IN ('validation', 'test'))")
def _(spark, d):
    s = table(spark, d, "task_split").where("split in ('validation', 'test')").select(F.col("task_id").alias("id"))
    return tickets(spark, d).select("id").join(s, "id", "left_anti")


@Q("J07_vector_lookup_join", ctes("r", "v") + "SELECT r.id, r.task_name, round(list_sum(v.v), 6) AS total FROM r JOIN v ON v.name = r.task_name")
def _(spark, d):
    v = task_vectors(spark, d).select("name", F.round(V.total(F.col("v")), 6).alias("total"))
    return changes(spark, d).join(v, F.col("task_name") == F.col("name")).select("id", "task_name", "total")


@Q("J13_path_ground_truth", ctes("t", "f") + "SELECT t.id AS task_id, f.file FROM t JOIN f ON f.task_name = t.name WHERE f.file <> 'unknown'")
def _(spark, d):
    t = tickets(spark, d).select(F.col("id").alias("task_id"), "name")
    return t.join(task_files(spark, d).where("file <> 'unknown'"), F.col("name") == F.col("task_name")).select("task_id", "file")


@Q("A29_relevant_files", ctes("f") + "SELECT task_name, file, count(*) OVER (PARTITION BY task_name) AS n FROM f WHERE file <> 'unknown'")
def _(spark, d):
    # a row for each file of the set: a task with a third of all rows is never gathered
    f = task_files(spark, d).where("file <> 'unknown'")
    n = f.groupBy("task_name").agg(F.count("*").alias("n"))
    return f.join(n, "task_name").select("task_name", "file", "n")


# ---- splits
_O = "o AS (SELECT id, name, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM t SEMI JOIN r ON r.task_name = t.name)"


def eligible(spark, d):
    """Tasks with changes."""
    t = tickets(spark, d).select("id", "name")
    return t.join(changes(spark, d).select("task_name"), F.col("name") == F.col("task_name"), "left_semi")


@Q("T15_eligible_tasks", ctes("t", "r") + "SELECT id, name FROM t SEMI JOIN r ON r.task_name = t.name")
def _(spark, d):
    return eligible(spark, d)


_RULES = {
    "recent": "rn > n - 200",
    "lastn": "rn > n - 200",
    "firstn": "rn <= 200",
    "middlen": "rn > (n - 200) // 2 AND rn <= (n - 200) // 2 + 200",
    "modn": "(rn - 1) % greatest(n // 200, 1) = 0 AND (rn - 1) // greatest(n // 200, 1) < 200",
}
for _id, _s in (("T11", "recent"), ("T12", "modn"), ("T13", "lastn"), ("T13", "firstn"), ("T13", "middlen")):

    def _make(s):
        def run(spark, d):
            return P.split(eligible(spark, d), "id", s, 200).select("id", "is_test")

        return run

    Q(f"{_id}_split_{_s}", ctes("t", "r", more=_O) + f"SELECT id, ({_RULES[_s]}) OR n <= 200 AS is_test FROM o")(_make(_s))


@Q(
    "T14_split_by_id",
    ctes("t", "r", more="e AS (SELECT id FROM t SEMI JOIN r ON r.task_name = t.name), n AS (SELECT count(*) AS n FROM e), h AS (SELECT id, id % greatest(n // 200, 1) = 0 AS hit FROM e, n), c AS (SELECT count(*) FILTER (hit) AS hits FROM h), k AS (SELECT id, hit, row_number() OVER (ORDER BY NOT hit, md5(CAST(id AS VARCHAR))) AS rk FROM h)")
    + "SELECT id, rk <= 200 AND (hit OR hits < 160) AS is_test FROM k, c",
)
def _(spark, d):
    return P.split_by_id(eligible(spark, d).select("id"), "id", 200)


@Q("T16_window_last_n", ctes("t") + "SELECT id FROM t ORDER BY id DESC LIMIT 100")
def _(spark, d):
    return P.last_n(tickets(spark, d).select("id"), "id", 100)


@Q("T17_last_tasks", ctes("t") + "SELECT id, name, substring(title, 1, 500) AS title FROM t ORDER BY id DESC LIMIT 100")
def _(spark, d):
    return tickets(spark, d).select("id", "name", F.substring("title", 1, 500).alias("title")).orderBy(F.col("id").desc()).limit(100)


@Q("T10_random_sample", ctes("t") + "SELECT id FROM t ORDER BY md5(CAST(id AS VARCHAR) || '7') LIMIT 50")
def _(spark, d):
    # hash order stands in for a seeded random order
    return tickets(spark, d).select("id").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("7")))).limit(50)


_CT = "r0 AS (SELECT * FROM rawdata WHERE sha IS NOT NULL AND sha <> ''), p AS (SELECT sha, count(DISTINCT path) AS files, arg_min(message, id) FILTER (message IS NOT NULL) AS description FROM r0 GROUP BY sha), k AS (SELECT *, split_part(description, chr(10), 1) AS title FROM p), ok AS (SELECT * FROM k WHERE files <= 50 AND NOT starts_with(lower(title), 'merge ') AND length(trim(title)) >= 8), dd AS (SELECT sha, substring(string_agg(substring(coalesce(diff, ''), 1, 4000), chr(10) ORDER BY id), 1, 4000) AS diff FROM r0 GROUP BY sha)"


@Q("P10_commit_tasks", "WITH " + _CT + " SELECT sha, title, description, dd.diff, files FROM ok JOIN dd USING (sha)")
def _(spark, d):
    return P.commit_tasks(table(spark, d, "rawdata")).drop("ts")


@Q("W07_commit_order", "WITH " + _CT + ", o AS (SELECT sha, (SELECT min(id) FROM r0 WHERE r0.sha = ok.sha) AS first_id FROM ok) SELECT sha, row_number() OVER (ORDER BY first_id, sha) AS rn FROM o")
def _(spark, d):
    raw = table(spark, d, "rawdata")
    c = P.commit_tasks(raw).select("sha").join(raw.groupBy("sha").agg(F.min("id").alias("first_id")), "sha")
    key = F.concat(F.lpad(F.col("first_id").cast("string"), 20, "0"), F.col("sha"))
    return P.ordinal(c.withColumn("key", key), "key").select("sha", "rn")


@Q("A26_paths_per_commit", "SELECT sha, count(DISTINCT path) AS paths FROM rawdata GROUP BY sha")
def _(spark, d):
    return table(spark, d, "rawdata").groupBy("sha").agg(F.countDistinct("path").alias("paths"))


@Q("A27_first_of_commit", "SELECT sha, arg_min(author_name, id) FILTER (author_name IS NOT NULL) AS author_name, arg_min(author_email, id) FILTER (author_email IS NOT NULL) AS author_email, arg_min(message, id) FILTER (message IS NOT NULL) AS message FROM rawdata GROUP BY sha")
def _(spark, d):
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return table(spark, d, "rawdata").groupBy("sha").agg(first("author_name"), first("author_email"), first("message"))


# ---- centroids
_SPL = "s AS (SELECT name, is_test FROM (SELECT id, name, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM t SEMI JOIN r ON r.task_name = t.name) x, LATERAL (SELECT rn > n - 200 OR n <= 200 AS is_test) y)"
_JV = "jv AS (SELECT m.module, m.task_name, v.v FROM m JOIN v ON v.name = m.task_name), ex AS (SELECT module, task_name, unnest(v) AS x, unnest(range(1, 65)) AS i FROM jv)"


def joined_vectors(spark, d, key="module"):
    c = module_changes(spark, d) if key == "module" else changes(spark, d).select("task_name", X.file_path(F.col("path")).alias("file"))
    return c.join(task_vectors(spark, d), F.col("task_name") == F.col("name")).select(key, "task_name", "v")


def centroids(df, key, how="avg", weight=None):
    return df.groupBy(key).agg(*V.mean_columns("v", DIM, how, weight)).select(key, V.pack(DIM).alias("v"))


def _long(df, key):
    return df.select(key, F.posexplode("v").alias("i", "x")).select(key, (F.col("i") + 1).cast("long").alias("i"), F.round("x", 12).alias("x"))


for _h, _f in (("avg", "avg"), ("sum", "sum"), ("median", "median")):

    def _make(h):
        def run(spark, d):
            return _long(centroids(joined_vectors(spark, d), "module", h), "module")

        return run

    Q(f"A22_centroid_{_h}", ctes("r", "v", more=_MOD + ", " + _JV) + f"SELECT module, i, round({_f}(x), 12) AS x FROM ex GROUP BY ALL")(_make(_h))

_W = "wt AS (SELECT module, task_name, count(*) AS w FROM m GROUP BY ALL), jw AS (SELECT module, w, unnest(v.v) AS x, unnest(range(1, 65)) AS i FROM wt JOIN v ON v.name = wt.task_name)"


def _weighted(spark, d):
    w = module_changes(spark, d).groupBy("module", "task_name").agg(F.count("*").alias("w"))
    return w.join(task_vectors(spark, d), F.col("task_name") == F.col("name"))


@Q("A21_task_module_weight", ctes("r", more=_MOD) + "SELECT module, task_name, count(*) AS w FROM m GROUP BY ALL")
def _(spark, d):
    return module_changes(spark, d).groupBy("module", "task_name").agg(F.count("*").alias("w"))


@Q("A23_centroid_weighted", ctes("r", "v", more=_MOD + ", " + _W) + "SELECT module, i, round(sum(x * w) / sum(w), 12) AS x FROM jw GROUP BY ALL")
def _(spark, d):
    return _long(centroids(_weighted(spark, d), "module", weight="w"), "module")


@Q("A24_centroid_cluster", ctes("r", "v", more=_MOD + ", " + _W) + "SELECT module, i, round(avg(x), 12) AS x FROM jw GROUP BY ALL")
def _(spark, d):
    # one cluster's centre is the mean, here of each task once
    return _long(centroids(_weighted(spark, d), "module"), "module")


@Q("A25_file_centroid", ctes("r", "v", more="m AS (SELECT task_name, regexp_replace(replace(path, '\\', '/'), '^\\s+|\\s+$', '', 'g') AS module FROM r), " + _JV) + "SELECT module AS file, i, round(avg(x), 12) AS x FROM ex GROUP BY ALL")
def _(spark, d):
    return _long(centroids(joined_vectors(spark, d, "file"), "file"), "file")


# ---- search: the last tasks against the modules of the others
_TRAIN = "tr AS (SELECT m.module, v.v FROM m JOIN v ON v.name = m.task_name JOIN s ON s.name = m.task_name WHERE NOT s.is_test), te AS (SELECT module, unnest(v) AS x, unnest(range(1, 65)) AS i FROM tr), ce AS (SELECT module AS path, list(x ORDER BY i) AS v FROM (SELECT module, i, avg(x) AS x FROM te GROUP BY ALL) GROUP BY module), q AS (SELECT v.name AS query_id, v.v FROM v JOIN s ON s.name = v.name WHERE s.is_test)"
_SIM = {
    "cosine": "round(list_dot_product(q.v, ce.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(ce.v, ce.v))), 12)",
    "euclidean": "-round(list_distance(q.v, ce.v), 12)",
    "manhattan": "-round(list_sum(list_transform(list_zip(q.v, ce.v), lambda z: abs(z[1] - z[2]))), 12)",
}


def _rank_sql(metric="cosine", k=10):
    sign = "" if metric == "cosine" else "-"
    return f"rk AS (SELECT query_id, path, {sign}sim AS score, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, path) AS rank FROM (SELECT query_id, path, {_SIM[metric]} AS sim FROM q, ce)), top AS (SELECT * FROM rk WHERE rank <= {k})"


def _base(k=10, metric="cosine"):
    return ctes("t", "r", "v", more=", ".join([_MOD, _SPL, _TRAIN, _rank_sql(metric, k)]))


def search_sides(spark, d):
    """(queries, module centroids of the training tasks, split) - the last 200 tasks are queries."""
    s = P.split(eligible(spark, d), "id", "recent", 200)
    q = task_vectors(spark, d).join(s.where("is_test").select(F.col("name").alias("n")), F.col("name") == F.col("n"), "left_semi").select(F.col("name").alias("query_id"), "v")
    tr = joined_vectors(spark, d).join(s.where("not is_test").select(F.col("name").alias("n")), F.col("task_name") == F.col("n"), "left_semi")
    return q, centroids(tr, "module").withColumnRenamed("module", "path"), s


for _m, _id in (("cosine", "T01_topk_cosine"), ("euclidean", "T03_topk_euclidean"), ("manhattan", "T03_topk_manhattan")):

    def _make(m):
        def run(spark, d):
            q, c, _ = search_sides(spark, d)
            return S.top_k(q, c, 10, m).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))

        return run

    Q(_id, _base(10, _m) + "SELECT query_id, path, round(score, 6) AS score, rank FROM top")(_make(_m))


@Q("J11_query_vector_cross", _base(1000) + "SELECT query_id, path, round(score, 6) AS score, rank FROM top")
def _(spark, d):
    q, c, _ = search_sides(spark, d)
    return S.top_k(q, c, 1000).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@Q("P13_filtered_search", _base(1000) + "SELECT query_id, path, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS place FROM top WHERE path LIKE 'c%' QUALIFY place <= 3")
def _(spark, d):
    q, c, _ = search_sides(spark, d)
    return S.top_k(q, c.where("path like 'c%'"), 3).select("query_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("place"))


_REL = "rel AS (SELECT DISTINCT m.task_name AS query_id, m.module AS path FROM m)"


def relevant_modules(spark, d):
    return module_changes(spark, d).select(F.col("task_name").alias("query_id"), F.col("module").alias("path")).distinct()


_MET = "h AS (SELECT top.query_id, rank, row_number() OVER (PARTITION BY top.query_id ORDER BY rank) AS nth FROM top JOIN rel USING (query_id, path)), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), a AS (SELECT query_id, sum(nth / rank) AS s, min(rank) AS f, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM h GROUP BY 1), pq AS (SELECT q.query_id, coalesce(s / n, 0) AS ap, coalesce(1 / f, 0) AS rr, " + ", ".join(f"coalesce(h{k}, 0) / {k} AS p_{k}, coalesce(h{k} / n, 0) AS r_{k}" for k in (1, 3, 5, 10)) + " FROM q LEFT JOIN nr USING (query_id) LEFT JOIN a USING (query_id))"
_COLS = ["ap", "rr"] + [f"{x}_{k}" for k in (1, 3, 5, 10) for x in "pr"]


def per_query(spark, d, depth=10):
    q, c, _ = search_sides(spark, d)
    q = stage(q, "queries")
    return M.per_query(q, S.top_k(q, c, depth), relevant_modules(spark, d))


@Q("W04_metrics_per_query", _base(10).rstrip() + f", {_REL}, {_MET} SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COLS) + " FROM pq")
def _(spark, d):
    return per_query(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in _COLS])


@Q("A30_metrics_mean", _base(10).rstrip() + f", {_REL}, {_MET} SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLS[2:]) + " FROM pq")
def eval_slice(spark, d):
    m = M.mean_metrics(per_query(spark, d))
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns if c != "queries"])


@Q("A31_metric_summary", _base(10).rstrip() + f", {_REL}, {_MET}, so AS (SELECT list_sort(list(round(ap, 6))) AS l, count(*) AS n, round(avg(round(ap, 6)), 5) AS mean, round(median(round(ap, 6)), 6) AS median, round(stddev_samp(round(ap, 6)), 5) AS std FROM pq) SELECT n, l[1] AS min, l[n] AS max, mean, median, l[n // 4 + 1] AS q1, l[3 * n // 4 + 1] AS q3, std FROM so")
def _(spark, d):
    p = per_query(spark, d).select(F.round("ap", 6).alias("ap"))
    s = M.summary(p, "ap")
    return s.withColumns({"mean": F.round("mean", 5), "std": F.round("std", 5), "median": F.round("median", 6)})


@Q("W04_metrics_full_ranking", _base(1000).rstrip() + f", {_REL}, h AS (SELECT top.query_id, rank, row_number() OVER (PARTITION BY top.query_id ORDER BY rank) AS nth FROM top JOIN rel USING (query_id, path)), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), a AS (SELECT query_id, sum(nth / rank) AS s, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 50) AS h50 FROM h GROUP BY 1) SELECT q.query_id, round(coalesce(s / n, 0), 6) AS ap, round(coalesce(h5, 0) / 5, 6) AS p_5, round(coalesce(h50 / n, 0), 6) AS r_50 FROM q JOIN nr USING (query_id) LEFT JOIN a USING (query_id)")
def _(spark, d):
    q, c, _ = search_sides(spark, d)
    q = stage(q, "queries")
    m = M.per_query(q, S.top_k(q, c, 1000), relevant_modules(spark, d), (5, 10, 20, 50), None, True)
    return m.select("query_id", *[F.round(x, 6).alias(x) for x in ("ap", "p_5", "r_50")])


@Q("X28_ndcg", _base(10).rstrip() + f", {_REL}, dc AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM top JOIN rel USING (query_id, path) GROUP BY 1), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) SELECT q.query_id, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM q LEFT JOIN nr USING (query_id) LEFT JOIN dc USING (query_id)")
def _(spark, d):
    q, c, _ = search_sides(spark, d)
    q = stage(q, "queries")
    return M.ndcg(q, S.top_k(q, c, 10), relevant_modules(spark, d)).withColumn("ndcg", F.round("ndcg", 6))


# ---- two collections: tasks of the last window, and all
_DUAL = "vt AS (SELECT v.name AS path, v.v FROM v JOIN s ON s.name = v.name WHERE NOT s.is_test), rc AS (SELECT vt.* FROM vt SEMI JOIN (SELECT name FROM s JOIN t USING (name) WHERE NOT is_test ORDER BY id DESC LIMIT 100) w ON w.name = vt.path), q AS (SELECT v.name AS query_id, v.v FROM v JOIN s ON s.name = v.name WHERE s.is_test)"


def _top_of(src, k):
    return f"(SELECT query_id, path, score, rank FROM (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (SELECT query_id, path, {_SIM['cosine'].replace('ce.', 'c.')} AS score FROM q, {src} c)) WHERE rank <= {k})"


def _dual_base():
    return ctes("t", "r", "v", more=", ".join([_SPL, _DUAL, f"a AS {_top_of('rc', 3)}", f"b AS {_top_of('vt', 5)}"]))


def dual_sides(spark, d):
    s = stage(P.split(eligible(spark, d), "id", "recent", 200), "split")
    v = stage(task_vectors(spark, d), "vectors")
    q = v.join(s.where("is_test").select("name"), "name", "left_semi").select(F.col("name").alias("query_id"), "v")
    train = s.where("not is_test")
    whole = v.join(train.select("name"), "name", "left_semi").select(F.col("name").alias("path"), "v")
    recent = whole.join(P.last_n(train, "id", 100).select(F.col("name").alias("path")), "path", "left_semi")
    return q, recent, whole


@Q("T04_dual_search", _dual_base() + "SELECT *, 'recent' AS collection FROM (SELECT query_id, path, round(score, 6) AS score, rank FROM a) UNION ALL SELECT *, 'all' FROM (SELECT query_id, path, round(score, 6) AS score, rank FROM b)")
def _(spark, d):
    q, r, w = dual_sides(spark, d)
    return S.dual_search(q, r, w, 3, 5).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@Q("X25_rank_fusion", _dual_base() + "SELECT query_id, path, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def _(spark, d):
    q, r, w = dual_sides(spark, d)
    return S.rrf([S.top_k(q, r, 3), S.top_k(q, w, 5)]).withColumn("score", F.round("score", 8))


@Q("X26_weighted_fusion", _dual_base() + "SELECT query_id, path, round(0.6 * coalesce(a.score, 0) + (1 - 0.6) * coalesce(b.score, 0), 6) AS score, CASE WHEN a.path IS NULL THEN 'historical' WHEN b.path IS NULL THEN 'recent' ELSE 'both' END AS source FROM a FULL JOIN b USING (query_id, path)")
def _(spark, d):
    q, r, w = dual_sides(spark, d)
    return S.weighted_fusion(S.top_k(q, r, 3), S.top_k(q, w, 5), 0.6).withColumn("score", F.round("score", 6))


@Q("X27_diverse_fusion")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    return S.mmr(S.top_k(q, w, 20).join(w, "path"), 5)


@Q("X02_top3_task_score", _dual_base().rstrip() + ", x AS (SELECT b.query_id, m.module, b.score, row_number() OVER (PARTITION BY b.query_id, m.module ORDER BY b.score DESC, b.path) AS k FROM b JOIN (SELECT DISTINCT task_name, module FROM (SELECT task_name, CASE WHEN contains(replace(path, '\\', '/'), '/') THEN split_part(regexp_replace(replace(path, '\\', '/'), '^\\s+|\\s+$', '', 'g'), '/', 1) ELSE 'root' END AS module FROM r)) m ON m.task_name = b.path) SELECT query_id, module, round(sum(score), 6) AS score FROM x WHERE k <= 3 GROUP BY ALL")
def _(spark, d):
    from pyspark.sql import Window

    q, _, w = dual_sides(spark, d)
    m = relevant_modules(spark, d).select(F.col("query_id").alias("path"), F.col("path").alias("module"))
    x = S.top_k(q, w, 5).join(m, "path")
    k = F.row_number().over(Window.partitionBy("query_id", "module").orderBy(F.col("score").desc(), "path"))
    return x.withColumn("k", k).where("k <= 3").groupBy("query_id", "module").agg(F.round(F.sum("score"), 6).alias("score"))


_BF = "bf AS (SELECT b.query_id, f.file, b.score FROM b JOIN (SELECT DISTINCT task_name, regexp_replace(replace(path, '\\', '/'), '^\\s+|\\s+$', '', 'g') AS file FROM r) f ON f.task_name = b.path)"


def _unit_files(spark, d):
    q, _, w = dual_sides(spark, d)
    return S.top_k(q, w, 5).join(task_files(spark, d).withColumnRenamed("task_name", "path"), "path")


@Q("X17_unit_file_scores", _dual_base().rstrip() + f", {_BF} SELECT query_id, file, round(max(score), 6) AS rank_score, count(*) AS freq FROM bf GROUP BY ALL")
def _(spark, d):
    return _unit_files(spark, d).groupBy("query_id", "file").agg(F.round(F.max("score"), 6).alias("rank_score"), F.count("*").alias("freq"))


@Q("X12_multi_hypothesis", _dual_base().rstrip() + f", {_BF} SELECT query_id, file, round(sum(score), 6) AS score FROM bf GROUP BY ALL")
def _(spark, d):
    return _unit_files(spark, d).groupBy("query_id", "file").agg(F.round(F.sum("score"), 6).alias("score"))


@Q("X21_score_blend", _dual_base().rstrip() + f", {_BF} SELECT query_id, file, round(0.7 * max(score) + 0.3 * avg(score), 6) AS score FROM bf GROUP BY ALL")
def _(spark, d):
    return _unit_files(spark, d).groupBy("query_id", "file").agg(F.round(0.7 * F.max("score") + 0.3 * F.avg("score"), 6).alias("score"))


@Q("X15_term_share", ctes("tt", "f", more="n AS (SELECT file, count(DISTINCT task_name) AS n FROM f GROUP BY 1)") + "SELECT file, term, count(*) AS tasks, round(count(*) / any_value(n), 6) AS share FROM f JOIN tt ON tt.name = f.task_name JOIN n USING (file) GROUP BY ALL")
def _(spark, d):
    from weftline.plans.base import title_term_counts

    f = task_files(spark, d)
    n = f.groupBy("file").agg(F.count("*").alias("n"))
    x = f.join(title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term"), "task_name").groupBy("file", "term").agg(F.count("*").alias("tasks"))
    return x.join(n, "file").select("file", "term", "tasks", F.round(F.col("tasks") / F.col("n"), 6).alias("share"))


@Q("X19_mode_union_intersection", _dual_base() + "SELECT query_id, path, round(max(score), 6) AS union_score, CASE WHEN count(*) = 2 THEN round(product(score), 6) END AS both_score FROM (SELECT query_id, path, score FROM a UNION ALL SELECT query_id, path, score FROM b) GROUP BY ALL")
def _(spark, d):
    q, r, w = dual_sides(spark, d)
    u = S.top_k(q, r, 3).select("query_id", "path", "score").unionByName(S.top_k(q, w, 5).select("query_id", "path", "score"))
    g = u.groupBy("query_id", "path").agg(F.round(F.max("score"), 6).alias("union_score"), F.count("*").alias("n"), F.round(F.product("score"), 6).alias("p"))
    return g.select("query_id", "path", "union_score", F.when(F.col("n") == 2, F.col("p")).alias("both_score"))
