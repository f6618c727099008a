"""Queries of extensions, the evaluation grid and streaming."""

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import extensions as O
from weftline.operators import grid
from weftline.operators import search as S
from weftline.operators.embed import embed
from weftline.plans.base import DIM, changes, ctes, task_files, task_vectors, tickets, title_term_counts, title_words
from weftline.plans.registry import core
from weftline.plans.retrieval import _dual_base, dual_sides, eligible, module_changes
from weftline.runtime import stage, table
from weftline.streaming.events import run_complete, windowed_counts

Q = core.query


@Q("X01_max_sim")
def _(spark, d):
    q, r, w = dual_sides(spark, d)
    top = S.top_k(q, w, 5)
    tok = stage(title_words(spark, d).select("name", "term").distinct(), "tokens")
    words = stage(embed(tok.select("term").distinct(), "term", F.col("term"), dim=32), "words")
    tv = tok.join(words, "term")
    qt = top.select("query_id", F.col("path").alias("doc_id")).join(tv.select(F.col("name").alias("query_id"), F.col("v").alias("q")), "query_id")
    return O.max_sim(qt, tv.select(F.col("name").alias("doc_id"), F.col("v").alias("d")).join(qt.select("doc_id").distinct(), "doc_id", "left_semi"))


_FI = "fi AS (SELECT file, term, sum(cnt) AS c FROM f JOIN tt ON tt.name = f.task_name GROUP BY ALL), n AS (SELECT count(DISTINCT file) AS n FROM fi), df AS (SELECT term, count(*) AS df FROM fi GROUP BY 1), sz AS (SELECT file, sum(c) AS s FROM fi GROUP BY 1), w AS (SELECT file, term, round(c / s * ln(n / df), 8) AS weight FROM fi JOIN df USING (term) JOIN sz USING (file), n)"


@Q("X03_file_identifiers", ctes("tt", "f", more=_FI.replace("w AS", "ww AS")) + "SELECT file, term, weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY weight DESC, term) AS INTEGER) AS rank FROM ww) WHERE rank <= 10")
def _(spark, d):
    t = title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term", "cnt")
    c = stage(task_files(spark, d).join(t, "task_name").groupBy("file", "term").agg(F.sum("cnt").alias("c")), "file-terms")
    n = c.agg(F.countDistinct("file").alias("n"))
    df = c.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    size = c.groupBy("file").agg(F.sum("c").alias("s"))
    w = c.join(df, "term").join(size, "file").select("file", "term", F.round(F.col("c") / F.col("s") * F.ln(F.col("n") / F.col("df")), 8).alias("weight"))
    return O.top_terms(w, "file", "term", "weight", 10)


@Q("X04_term_identifiers", ctes("tt", "f", more="c AS (SELECT term, regexp_extract(file, '([^/.]+)[.][^/.]*$', 1) AS ident, count(*) AS n FROM f JOIN tt ON tt.name = f.task_name GROUP BY ALL)") + "SELECT term, ident, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY n DESC, ident) AS INTEGER) AS rank FROM c WHERE ident <> '') WHERE rank <= 5")
def _(spark, d):
    t = title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term")
    ident = F.regexp_extract("file", r"([^/.]+)[.][^/.]*$", 1)
    c = task_files(spark, d).select("task_name", ident.alias("ident")).where("ident <> ''").join(t, "task_name").groupBy("term", "ident").agg(F.count("*").alias("n"))
    return O.top_terms(c, "term", "ident", "n", 5)


@Q("X05_confidence", "SELECT event_id, round(value / 50 + 0.5 * (user_id / 100.0) + 0.1 * (event_id % 4), 6) AS score FROM events")
def _(spark, d):
    s = O.confidence_score(F.col("value") / 50, F.col("user_id") / 100, F.col("event_id") % 4)
    return table(spark, d, "events").select("event_id", F.round(s, 6).alias("score"))


_LN = "ln AS (SELECT path AS file, CAST(regexp_extract(diff, '@@ -([0-9]+)', 1) AS BIGINT) AS line, id FROM rawdata WHERE path IS NOT NULL AND regexp_matches(diff, '@@ -[0-9]+'))"


def _lines(spark, d):
    r = table(spark, d, "rawdata").where(F.col("path").isNotNull() & F.col("diff").rlike("@@ -[0-9]+"))
    return r.select(F.col("path").alias("file"), F.regexp_extract("diff", "@@ -([0-9]+)", 1).cast("long").alias("line"), "id")


@Q("X06_line_windows", f"WITH {_LN}, x AS (SELECT DISTINCT file, line FROM ln), g AS (SELECT *, line - lag(line) OVER (PARTITION BY file ORDER BY line) AS gap FROM x), h AS (SELECT *, sum(CASE WHEN gap <= 31 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line) AS run FROM g) SELECT file, greatest(min(line) - 15, 1) AS lo, max(line) + 15 AS hi FROM h GROUP BY file, run")
def _(spark, d):
    return O.line_window(_lines(spark, d), "file", "line")


@Q("X06_line_accuracy", f"WITH {_LN}, a AS (SELECT DISTINCT file, line FROM ln WHERE id % 2 = 0), p AS (SELECT DISTINCT file, line FROM ln WHERE id % 2 = 1) SELECT file, line, EXISTS (SELECT 1 FROM p WHERE p.file = a.file AND abs(p.line - a.line) <= 20) AS hit FROM a")
def _(spark, d):
    # odd changes predict the lines of even ones
    x = _lines(spark, d)
    return O.line_accuracy(x.where("id % 2 = 1"), x.where("id % 2 = 0"))


@Q("X07_grounding_recall", _dual_base().rstrip() + ", rl AS (SELECT DISTINCT task_name, regexp_replace(replace(path, '\\', '/'), '^\\s+|\\s+$', '', 'g') AS file FROM r), ctx AS (SELECT DISTINCT b.query_id, rl.file FROM b JOIN rl ON rl.task_name = b.path) SELECT q.query_id, round(count(ctx.file) / count(*), 6) AS recall, count(ctx.file) = 0 AS missed FROM q JOIN rl ON rl.task_name = q.query_id LEFT JOIN ctx ON ctx.query_id = q.query_id AND ctx.file = rl.file GROUP BY q.query_id")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    f = task_files(spark, d)
    ctx = S.top_k(q, w, 5).join(f.withColumnRenamed("task_name", "path"), "path").select("query_id", "file").distinct().withColumn("h", F.lit(1))
    rel = q.select("query_id").join(f.withColumnRenamed("task_name", "query_id"), "query_id").select("query_id", "file")
    return rel.join(ctx, ["query_id", "file"], "left").groupBy("query_id").agg(F.round(F.count("h") / F.count("*"), 6).alias("recall"), (F.count("h") == 0).alias("missed"))


_TERMFILE = "dt AS (SELECT DISTINCT name, term FROM tt), ct AS (SELECT DISTINCT f.task_name AS name, unnest(regexp_split_to_array(lower(f.file), '[^a-z0-9]+')) AS term FROM f)"


def _code_terms(spark, d):
    return task_files(spark, d).select(F.col("task_name").alias("name"), F.explode(F.split(F.lower("file"), "[^a-z0-9]+")).alias("term")).distinct()


@Q("X08_asymmetry", ctes("tt", "f", more=_TERMFILE) + "SELECT dt.name, round(1 - count(ct.term) / count(*), 6) AS asymmetry FROM dt LEFT JOIN ct USING (name, term) GROUP BY dt.name")
def _(spark, d):
    return O.asymmetry(title_term_counts(spark, d), _code_terms(spark, d), "name", "term").withColumn("asymmetry", F.round("asymmetry", 6))


_LINKS = "lk AS (SELECT DISTINCT l_file AS l, r_file AS r FROM file_links WHERE l_file <> r_file)"


def _links(spark, d):
    return table(spark, d, "file_links").select(F.col("l_file").alias("l"), F.col("r_file").alias("r")).where("l <> r").distinct()


@Q("X09_harmony", f"WITH {_LINKS}, dg AS (SELECT node, count(*) AS degree FROM (SELECT l AS node FROM lk UNION ALL SELECT r FROM lk) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT round(avg(CASE WHEN node IN (SELECT id FROM module_tree WHERE cnt >= 20) THEN 1 ELSE 0 END), 6) AS harmony FROM dg")
def _(spark, d):
    m = table(spark, d, "module_tree").where("cnt >= 20").select(F.col("id").alias("node"))
    return O.harmony(_links(spark, d), m, 50).withColumn("harmony", F.round("harmony", 6))


@Q("X10_reach", f"WITH {_LINKS}, e AS (SELECT l, r FROM lk UNION SELECT r, l FROM lk), s AS (SELECT DISTINCT id AS node FROM module_tree WHERE id % 20 = 0), d1 AS (SELECT DISTINCT s.node AS seed, e.r AS node FROM s JOIN e ON e.l = s.node), d2 AS (SELECT DISTINCT d1.seed, e.r AS node FROM d1 JOIN e ON e.l = d1.node), u AS (SELECT node AS seed, node, 0 AS depth FROM s UNION ALL SELECT seed, node, 1 FROM d1 UNION ALL SELECT seed, node, 2 FROM d2) SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY seed, node")
def _(spark, d):
    # the stated query set of searches: ids divisible by 20, against all links
    s = table(spark, d, "module_tree").where("id % 20 = 0").select(F.col("id").alias("node"))
    return O.reach(_links(spark, d), s, 2)


@Q("X11_retrieval_symmetry")
def _(spark, d):
    _, _, w = dual_sides(spark, d)
    r = S.each_top_k(w, 6).where("query_id <> path").select("query_id", "path", "rank")
    return O.retrieval_symmetry(stage(r, "ranked"), 6)


@Q("X13_keyword_boost", _dual_base().rstrip() + ", tt2 AS (SELECT DISTINCT name, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM t), rare AS (SELECT term FROM tt2 GROUP BY term HAVING count(*) <= 20), h AS (SELECT DISTINCT b.query_id, b.path FROM b JOIN tt2 x ON x.name = b.query_id JOIN rare USING (term) JOIN tt2 y ON y.name = b.path AND y.term = x.term), hq AS (SELECT DISTINCT query_id FROM h) SELECT b.query_id, b.path, round(b.score + CASE WHEN h.path IS NOT NULL THEN 0.5 WHEN hq.query_id IS NOT NULL THEN -0.3 ELSE 0 END, 6) AS score FROM b LEFT JOIN h ON h.query_id = b.query_id AND h.path = b.path LEFT JOIN hq ON hq.query_id = b.query_id")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    top = stage(S.top_k(q, w, 5), "top")
    t = title_words(spark, d).select("name", "term").distinct()
    rare = t.join(t.groupBy("term").agg(F.count("*").alias("n")).where("n <= 20"), "term").select("name", "term")
    h = top.select("query_id", "path").join(rare.withColumnRenamed("name", "query_id"), "query_id").join(rare.withColumnRenamed("name", "path"), ["path", "term"]).select("query_id", "path")
    return O.keyword_boost(top, stage(h.distinct(), "hits")).withColumn("score", F.round("score", 6))


@Q("X14_embedding_match")
def _(spark, d):
    m = table(spark, d, "rawdata").where("task_name is null and message is not null").select(X.normalize_commit(F.col("message")).alias("m")).distinct().where("m <> ''")
    q = embed(m, "m", F.col("m")).withColumnRenamed("m", "query_id")
    t = tickets(spark, d).select("name", X.normalize_commit(F.col("title")).alias("title")).where("title <> ''")
    items = embed(t, "name", F.col("title")).withColumnRenamed("name", "path").where("path is not null")
    return S.top_k(q, items, 1).where("score >= 0.5")


@Q("X18_aggregated_mode")
def _(spark, d):
    from weftline.functions.vectors import mean_columns, pack
    from weftline.plans.retrieval import centroids, joined_vectors

    q, _, w = dual_sides(spark, d)
    m = S.top_k(q, w, 3).join(w, "path").groupBy("query_id").agg(*mean_columns("v", DIM)).select("query_id", pack(DIM).alias("v"))
    return S.top_k(m, centroids(joined_vectors(spark, d, "file"), "file").withColumnRenamed("file", "path"), 5)


@Q("X23_coverage_penalty", _dual_base().rstrip() + ", c AS (SELECT path, count(DISTINCT query_id) / (SELECT count(DISTINCT query_id) FROM b) AS coverage FROM b GROUP BY path) SELECT b.query_id, b.path, round(coverage, 6) AS coverage, round(score - 0.1 * coverage, 6) AS score FROM b JOIN c USING (path)")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    r = O.coverage_penalty(stage(S.top_k(q, w, 5), "top"))
    return r.withColumns({c: F.round(c, 6) for c in ("coverage", "score")})


@Q("X24_feedback_terms")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    t = title_words(spark, d).select(F.col("name").alias("path"), "term").distinct()
    return O.feedback_terms(S.top_k(q, w, 5), t)


@Q("X29_complementarity", _dual_base().rstrip() + ", u AS (SELECT query_id, count(DISTINCT path) AS u FROM (SELECT query_id, path FROM a UNION ALL SELECT query_id, path FROM b) GROUP BY 1), i AS (SELECT query_id, count(*) AS i FROM a JOIN b USING (query_id, path) GROUP BY 1) SELECT query_id, round(1 - coalesce(i, 0) / u, 6) AS complementarity FROM u LEFT JOIN i USING (query_id)")
def _(spark, d):
    q, r, w = dual_sides(spark, d)
    return O.fusion_report(S.top_k(q, r, 3), S.top_k(q, w, 5)).withColumn("complementarity", F.round("complementarity", 6))


_AB = "x AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^a-z0-9]+'), lambda x: x <> '') AS c FROM t)"


def _ab(spark, d):
    w = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    return tickets(spark, d).select("id", w("title").alias("a"), w("description").alias("c"))


@Q("X30_grounding", ctes("t", more=_AB) + "SELECT id, round(len(list_filter(list_distinct(a), lambda x: NOT list_contains(c, x))) / nullif(len(list_distinct(a)), 0), 6) AS novelty, round(len(list_filter(list_distinct(a), lambda x: list_contains(c, x))) / nullif(len(list_distinct(a)), 0), 6) AS grounding, round(nullif(len(list_distinct(a)), 0) / nullif(len(a), 0), 6) AS density FROM x")
def _(spark, d):
    r = _ab(spark, d).select("id", *O.grounding(F.col("a"), F.col("c")))
    return r.withColumns({c: F.round(c, 6) for c in ("novelty", "grounding", "density")})


@Q("X31_rouge_recall", ctes("t", more=_AB + ", y AS (SELECT id, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS a2, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) AS c2, list_distinct(a) AS a1, c AS c1 FROM x)") + "SELECT id, round(coalesce(len(list_filter(a1, lambda x: list_contains(c1, x))) / nullif(len(a1), 0), 0), 6) AS rouge_1, round(coalesce(len(list_filter(a2, lambda x: list_contains(c2, x))) / nullif(len(a2), 0), 0), 6) AS rouge_2 FROM y")
def _(spark, d):
    return _ab(spark, d).select("id", *[F.round(O.rouge_recall(F.col("a"), F.col("c"), n), 6).alias(f"rouge_{n}") for n in (1, 2)])


@Q("X32_turn_report")
def _(spark, d):
    # documents of a task are its turns, in order of their ids
    t = table(spark, d, "documents").where("task_name is not null").select("task_name", "doc_id", X.identifier_tokens(F.col("text")).alias("tokens"))
    return O.turn_report(t, "task_name", "doc_id", "tokens")


@Q("G01_evaluation_grid")
def _(spark, d):
    t = eligible(spark, d)
    v = stage(grid.variants(t, "id", "name", ["recent", "modn"], {"w100": 100, "w1000": 1000, "all": None}, 200), "variants")
    mod = module_changes(spark, d).select(F.col("task_name").alias("name"), F.lit("module").alias("target"), F.col("module").alias("path"))
    fil = changes(spark, d).select(F.col("task_name").alias("name"), F.lit("file").alias("target"), X.file_path(F.col("path")).alias("path"))
    return grid.evaluate(v, stage(task_vectors(spark, d), "vectors"), mod.unionByName(fil), "name", DIM)


@Q("STR01_windowed_events", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, d):
    from pyspark.sql import types as T

    # the whole table as a stream of files; all windows come out, as of a complete run
    src = table(spark, d, "events")
    e = spark.readStream.schema(src.schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast(T.TimestampType()).alias("ts"), "event_type", "value")
    out = run_complete(windowed_counts(e, "ts", "event_type"), "windows")
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))



@Q("X35_procrustes")
def _(spark, d):
    # the rotation that takes the tasks' vectors closest to the centroids of their modules, each task with each of its modules once
    from weftline.operators.embed import procrustes
    from weftline.plans.retrieval import centroids, joined_vectors

    j = stage(joined_vectors(spark, d), "joined")
    c = centroids(j, "module").withColumnRenamed("v", "c")
    p = j.groupBy("task_name", "module").agg(F.min("v").alias("v")).join(c, "module")
    w = procrustes(p, "v", "c", DIM)
    rows = [(i, [float(x) for x in w[i]]) for i in range(DIM)]
    return spark.createDataFrame(rows, "row int, v array<double>")


@Q("Q12_similar_tasks_of_project", _dual_base() + ", pj AS (SELECT q.query_id, w.path, round(list_dot_product(q.v, w.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(w.v, w.v))), 12) AS s FROM q JOIN vt w ON split_part(w.path, '-', 1) = 'BRIX') SELECT query_id, path, round(s, 6) AS score FROM pj QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) <= 5")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    return S.top_k(q, w.where("path like 'BRIX-%'"), 5).select("query_id", "path", F.round("score", 6).alias("score"))


@Q("J14_metadata_merge", ctes("t", "v") + "SELECT v.name, round(list_sum(v.v), 6) AS total, substring(coalesce(t.title, ''), 1, 500) AS title, coalesce(t.comments, '') <> '' AS has_comments FROM v JOIN t USING (name)")
def _(spark, d):
    from weftline.functions.vectors import total
    from weftline.sources.sinks import task_collection

    m = task_collection(tickets(spark, d)).select(F.col("path").alias("name"), "metadata.*")
    return task_vectors(spark, d).join(m, "name").select("name", F.round(total(F.col("v")), 6).alias("total"), "title", "has_comments")


@Q("W02_paths_beside_rows", "SELECT id, sha, paths FROM rawdata LEFT JOIN (SELECT sha, count(DISTINCT path) AS paths FROM rawdata GROUP BY sha) USING (sha) WHERE sha IS NOT NULL")
def _(spark, d):
    r = table(spark, d, "rawdata").where("sha is not null").select("id", "sha", "path")
    return r.join(r.groupBy("sha").agg(F.countDistinct("path").alias("paths")), "sha").select("id", "sha", "paths")


@Q("W08_last_changes_of_task", "SELECT task_name, id FROM rawdata WHERE task_name <> '' QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY id DESC) <= 3")
def _(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("task_name").orderBy(F.col("id").desc()))
    return table(spark, d, "rawdata").where("task_name <> ''").select("task_name", "id").withColumn("k", k).where("k <= 3").drop("k")


@Q("U04_glove_mean")
def _(spark, d):
    from weftline.operators.embed import word_mean

    w = title_words(spark, d)
    v = embed(w.select("term").distinct(), "term", F.col("term"), dim=16).withColumnRenamed("term", "word")
    return word_mean(w, v, "id", "term", 16)


@Q("SC22_file_contents", "SELECT event_type, count(*) AS n, CAST(sum(len) AS BIGINT) AS chars FROM (SELECT event_type, length(event_type || ':' || CAST(event_id AS VARCHAR)) AS len FROM events) GROUP BY 1")
def _(spark, d):
    import uuid

    from weftline.runtime import shared_dir
    from weftline.sources.readers import file_contents

    at = f"{shared_dir(spark).rstrip('/')}/weftline-tables/files-{uuid.uuid4().hex[:10]}"
    e = table(spark, d, "events").select("event_type", F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("line"))
    e.write.partitionBy("event_type").text(at)
    f = file_contents(spark, at).select(F.regexp_extract("path", r"event_type=([^/]+)/", 1).alias("event_type"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return f.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
