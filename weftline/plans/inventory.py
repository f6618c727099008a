"""Queries of vector stores, landed pages, agents and the measures that need several results together."""

import uuid

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import agent, grid
from weftline.operators import extensions as O
from weftline.operators import search as S
from weftline.operators import serving as R
from weftline.operators import terms as T
from weftline.operators.embed import embed
from weftline.operators.index import STORES, open_index
from weftline.plans.base import DIM, SQL, changes, ctes, task_files, task_modules, task_vectors, tickets, title_term_counts, title_words
from weftline.plans.extensions import _AB, _ab
from weftline.plans.registry import core
from weftline.plans.retrieval import _dual_base, centroids, dual_sides, eligible, joined_vectors, module_changes, search_sides
from weftline.runtime import shared_dir, stage, table
from weftline.sources import git, readers, sinks

Q = core.query


def _name(spark, store):
    n = f"weft_{uuid.uuid4().hex[:10]}"
    return n if store == "table" else f"{shared_dir(spark).rstrip('/')}/weftline-tables/{n}"


def _collection(spark, d):
    return table(spark, d, "vec_collection").where("vector is not null").select("id", "path", "type", "vector")


# ---- stores
@Q("U08_vector_backend", "WITH s AS (SELECT unnest(['files', 'table']) AS store) SELECT store, type, count(*) AS n, CAST(min(len(vector)) AS INTEGER) AS least_dim, CAST(max(len(vector)) AS INTEGER) AS most_dim FROM vec_collection, s WHERE vector IS NOT NULL GROUP BY ALL")
def _(spark, d):
    v, out = _collection(spark, d), None
    for store in sorted(STORES):
        ix = open_index(spark, store, _name(spark, store))
        ix.create(v.where("id % 2 = 0"))
        ix.insert(v)  # half of the ids are there already
        one = stage(ix.info().withColumn("store", F.lit(store)), "info")
        ix.drop()
        out = one if out is None else out.unionByName(one)
    return out


_NEAR = """WITH v AS (SELECT id, path, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM vec_collection WHERE type = 'module' AND vector IS NOT NULL AND path IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS query_id, b.path, b.id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) AS score FROM v a JOIN v b ON a.id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s), t AS (SELECT unnest(['files', 'table']) AS store) SELECT store, query_id, rank, round(score, 6) AS score FROM k, t WHERE rank <= 3"""


@Q("U08_backend_search", _NEAR)
def _(spark, d):
    from weftline.functions.vectors import usable

    v, out = _collection(spark, d).where("path is not null").where(usable(F.col("vector"), DIM)), None
    q = stage(v.where("type = 'module' and id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("v")), "queries")
    for store in sorted(STORES):
        ix = open_index(spark, store, _name(spark, store))
        ix.create(v)
        one = stage(ix.search(q, 3, where=F.col("type") == "module").select(F.lit(store).alias("store"), "query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")), "found")
        ix.drop()
        out = one if out is None else out.unionByName(one)
    return out


@Q("SK02_batch_insert", "SELECT id, name, title FROM task QUALIFY row_number() OVER (PARTITION BY id ORDER BY name) = 1")
def _(spark, d):
    t = table(spark, d, "task").select("id", "name", "title")
    have = sinks.insert_or_ignore(t.where("id % 3 = 0"), ["id"], "name")
    new = sinks.insert_or_ignore(t, ["id"], "name").join(have.select("id"), "id", "left_anti")
    return have.unionByName(new)


@Q("SK08_vector_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new ' || path ELSE path END AS path, type FROM vec_collection WHERE vector IS NOT NULL")
def _(spark, d):
    v = _collection(spark, d)
    ix = open_index(spark, "files", _name(spark, "files"))
    ix.create(v)
    ix.upsert(v.where("id % 3 = 0").withColumn("path", F.concat(F.lit("new "), "path")))
    return ix.rows().select("id", "path", "type")


@Q("SK10_collection_info", core.sql["Q09_collection_info"])
def _(spark, d):
    return sinks.collection_info(table(spark, d, "vec_collection"))


@Q("SK12_drop_all", "SELECT DISTINCT type AS dropped FROM vec_collection WHERE type IS NOT NULL")
def _(spark, d):
    v, pre = _collection(spark, d), f"wdrop{uuid.uuid4().hex[:8]}"
    for r in v.where("type is not null").select("type").distinct().collect():  # a table for each kind of vector
        sinks.create_collection(v.where(F.col("type") == r.type), f"{pre}_{r.type}")
    gone = sinks.drop_collections(spark, f"{pre}%")
    if sinks.drop_collections(spark, f"{pre}%"):
        raise RuntimeError("tables were left")
    return spark.createDataFrame([(n.removeprefix(f"{pre}_"),) for n in gone], "dropped string")


_SEARCHED = core.sql["T01_topk_cosine"]


@Q("Q20_variant_search", _SEARCHED)
def _(spark, d):
    # centroids of all variants are stored once; a search names the one it wants, and only that is read
    t = eligible(spark, d)
    v = stage(grid.variants(t, "id", "name", ["recent", "modn"], {"w100": 100, "all": None}, 200), "variants")
    j = joined_vectors(spark, d).withColumnRenamed("task_name", "name").join(v.where("side = 'train'").select("name", "split", "win"), "name")
    c = centroids(j.withColumn("key", F.concat_ws("\x1f", "split", "win", "module")), "key")
    p = F.split("key", "\x1f")
    ix = open_index(spark, "files", _name(spark, "files"), ("split", "win", "target"))
    ix.create(c.select(F.xxhash64("key").alias("id"), p[2].alias("path"), F.col("v").alias("vector"), p[0].alias("split"), p[1].alias("win"), F.lit("module").alias("target")))
    q, _, _ = search_sides(spark, d)
    r = ix.search(q, R.cap(10, "modules"), where=(F.col("split") == "recent") & (F.col("win") == "all") & (F.col("target") == "module"))
    return r.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


# ---- landed pages and repositories
@Q("SC11_bulk_pages", ctes("t") + "SELECT '#' || id AS name, coalesce(title, '') AS title, coalesce(description, '') AS description, '' AS comments FROM t WHERE id % 7 <> 0")
def _(spark, d):
    pull = F.when(F.col("id") % 7 == 0, "u")
    one = F.to_json(F.struct(F.col("id").alias("number"), "title", F.col("description").alias("body"), pull.alias("pull_request")))
    pages = tickets(spark, d).groupBy(F.floor(F.col("id") / 100).alias("p")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(one)), F.lit("]")).alias("page"))
    return readers.bulk_issues(pages, "github").select("name", "title", "description", "comments")


@Q("SC02_test_cap", "SELECT id FROM rawdata WHERE (SELECT count(*) FROM rawdata) <= 100000")
def _(spark, d):
    return git.capped(table(spark, d, "rawdata").select("id"))


@Q("SC20_checkpoint_counts", "SELECT r_name AS project, CAST(count(n_name) FILTER (n_nationkey % 2 = 0) AS INTEGER) AS completed_etl, CAST(count(n_name) FILTER (n_nationkey % 2 = 1) AS INTEGER) AS failed_etl FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    at = _name(spark, "files")
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    some = lambda k: F.collect_list(F.when(F.col("n_nationkey") % 2 == k, F.col("n_name")))
    c = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(some(0).alias("completed_etl"), some(1).alias("failed_etl"))
    c.withColumn("p", F.col("r_name")).drop("r_name").write.partitionBy("p").json(at)
    return readers.checkpoint_counts(spark, at).select(F.url_decode(F.regexp_extract("file", "p=([^/]+)/", 1)).alias("project"), "completed_etl", "failed_etl")


@Q("F28_rounding", "SELECT event_id, round(value, 4) AS similarity, round(value / 1024, 2) AS mb FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round("value", 4).alias("similarity"), F.round(F.col("value") / 1024, 2).alias("mb"))


# ---- agents over real contents: what a file last came to hold, from the landed diffs
def file_texts(spark, d):
    """(path, text): the last diff of each file that has one."""
    r = changes(spark, d).where("diff is not null")
    return r.groupBy(X.file_path(F.col("path")).alias("path")).agg(F.max_by("diff", "id").alias("text"))


def _context(spark, d, n_modules, n_files, n_tasks):
    q, _, w = dual_sides(spark, d)
    _, c, _ = search_sides(spark, d)
    q = stage(q, "queries")
    t = tickets(spark, d).select(F.col("name").alias("path"), "title", "description")
    arr = lambda df, name, *cols: df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias(name))
    files = stage(S.top_k(q, centroids(joined_vectors(spark, d, "file"), "file").withColumnRenamed("file", "path"), n_files), "files")
    shown = files.where("rank <= 3").join(file_texts(spark, d), "path").select("query_id", "rank", "path", F.col("text").alias("content"), "score")
    text = t.select(F.col("path").alias("query_id"), X.combine_fields(F.col("title"), F.col("description")).alias("text"))
    j = q.select("query_id").join(text, "query_id")
    for x in (
        arr(S.top_k(q, c, n_modules), "mods", "path", "score"), arr(files, "files", "path", "score"), arr(S.top_k(q, w, n_tasks).join(t, "path", "left"), "tasks", "path", "title", "description", "score"), arr(shown, "snips", "path", "content", "score"),
    ):
        j = j.join(x, "query_id", "left")
    none = F.array().cast("array<struct<rank:int,path:string,content:string,score:double>>")
    return j.select("query_id", R.prompt(F.col("text"), F.col("mods"), F.col("files"), F.col("tasks"), F.coalesce("snips", none)).alias("prompt"))


@Q("Q15_rag_prompts")
def _(spark, d):
    return _context(spark, d, 5, 10, 5)


@Q("Q16_two_phase")
def _(spark, d):
    picked = agent.select_files(agent.answer(_context(spark, d, 5, 10, 5), agent.Echo()))
    return agent.read_files(picked, file_texts(spark, d))


@Q("Q18_simple_agent")
def _(spark, d):
    return agent.simple_agent(_context(spark, d, 5, 10, 3), agent.Echo())


@Q("Q19_multi_agent")
def _(spark, d):
    return agent.multi_agent(_context(spark, d, 5, 10, 3), agent.Echo(), agent.Echo())


# ---- measures
_TM = f"tmx AS ({SQL['tm']}), ff AS ({SQL['f']})"


@Q("X07_memoization", ctes("tt", more="k AS (SELECT DISTINCT id, term FROM tt), l AS (SELECT a.term AS x, b.term AS y FROM k a JOIN k b ON a.id = b.id AND a.term < b.term GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT x AS term FROM l UNION SELECT y FROM l)") + "SELECT k.id, round(count(h.term) / count(*), 6) AS mhr FROM k LEFT JOIN h USING (term) GROUP BY k.id")
def _(spark, d):
    k = title_term_counts(spark, d).select("id", "term").distinct()
    return O.memoization(k, T.unordered_links(k, "id", "term")).withColumn("mhr", F.round("mhr", 6))


@Q(
    "X07_noise_reduction",
    _dual_base().rstrip() + f", {_TM}, c AS (SELECT DISTINCT b.query_id, ff.file FROM b JOIN ff ON ff.task_name = b.path), rl AS (SELECT q.query_id, ff.file FROM q JOIN ff ON ff.task_name = q.query_id), ft AS (SELECT DISTINCT file, unnest(regexp_split_to_array(lower(file), '[^a-z0-9]+')) AS term FROM c), qt AS (SELECT DISTINCT name AS query_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+'), lambda x: x <> '')) AS term FROM t), k AS (SELECT DISTINCT c.query_id, c.file FROM c JOIN ft USING (file) JOIN qt ON qt.query_id = c.query_id AND qt.term = ft.term) SELECT c.query_id, count(*) AS noise, round(1 - count(k.file) / count(*), 6) AS removed FROM c ANTI JOIN rl ON rl.query_id = c.query_id AND rl.file = c.file LEFT JOIN k ON k.query_id = c.query_id AND k.file = c.file GROUP BY 1",
)
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    f = task_files(spark, d)
    c = stage(S.top_k(q, w, 5).join(f.withColumnRenamed("task_name", "path"), "path").select("query_id", "file").distinct(), "candidates")
    rel = q.select("query_id").join(f.withColumnRenamed("task_name", "query_id"), "query_id").select("query_id", "file")
    terms = c.select("query_id", "file", F.explode(F.array_distinct(F.split(F.lower("file"), "[^a-z0-9]+"))).alias("term"))
    own = title_words(spark, d).select(F.col("name").alias("query_id"), "term").distinct()
    kept = terms.join(own, ["query_id", "term"]).select("query_id", "file").distinct()
    return O.noise_reduction(c, rel, kept).withColumn("removed", F.round("removed", 6))


@Q("X23_specificity", ctes("v", more="e AS (SELECT unnest(v) AS x, unnest(range(1, 65)) AS i FROM v), a AS (SELECT i, avg(x) AS x FROM e GROUP BY i), c AS (SELECT list(x ORDER BY i) AS c FROM a)") + "SELECT name, round(1 - list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 6) AS specificity FROM v, c")
def _(spark, d):
    return O.specificity(task_vectors(spark, d), "name", "v", DIM).withColumn("specificity", F.round("specificity", 6))


@Q("X24_refined_queries")
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    t = title_words(spark, d).select(F.col("name").alias("path"), "term").distinct()
    text = tickets(spark, d).select(F.col("name").alias("query_id"), F.col("title").alias("text")).join(q.select("query_id"), "query_id", "left_semi")
    x = stage(O.expand_queries(text, S.top_k(q, w, 5), t), "expanded")
    return O.accept_expansion(x, embed)


@Q(
    "X29_time_and_diversity",
    _dual_base().rstrip() + f", {_TM}, dt AS (SELECT task_name AS path, epoch(min(created_at)) AS e FROM rawdata WHERE task_name <> '' GROUP BY 1), zz AS (SELECT min(e) AS lo, max(e) AS hi FROM dt), sp AS (SELECT query_id, round((max(e) - min(e)) / (any_value(hi) - any_value(lo)), 6) AS temporal_coverage, round(avg((e - lo) / (hi - lo)), 6) AS recency FROM b JOIN dt USING (path), zz GROUP BY 1), dy AS (SELECT query_id, round(count(DISTINCT module) / count(*), 6) AS diversity FROM b JOIN tmx ON tmx.task_name = b.path GROUP BY 1) SELECT query_id, temporal_coverage, recency, diversity FROM sp JOIN dy USING (query_id)",
)
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    top = stage(S.top_k(q, w, 5), "top")
    dates = table(spark, d, "rawdata").where("task_name <> ''").groupBy(F.col("task_name").alias("path")).agg((F.unix_micros(F.min("created_at").cast("timestamp")) / 1e6).alias("at"))
    r = O.time_spread(top, dates).join(O.diversity(top, task_modules(spark, d).withColumnRenamed("task_name", "path")), "query_id")
    return r.select("query_id", *[F.round(c, 6).alias(c) for c in ("temporal_coverage", "recency", "diversity")])


@Q("X30_efficiency", ctes("t", more=_AB) + "SELECT id, round(len(list_filter(list_distinct(a), lambda x: NOT list_contains(c, x))) / nullif(len(a), 0), 6) AS efficiency FROM x")
def _(spark, d):
    return _ab(spark, d).select("id", F.round(O.efficiency(F.col("a"), F.col("c")), 6).alias("efficiency"))


@Q("X31_keyword_coverage", ctes("t", more=_AB + ", n AS (SELECT count(*) AS n FROM x), k AS (SELECT id, c, unnest(list_distinct(a)) AS w FROM x), d AS (SELECT w FROM k, n GROUP BY w HAVING ln(any_value(n) / count(*)) > 3)") + "SELECT id, round(avg(CASE WHEN list_contains(c, w) THEN 1 ELSE 0 END), 6) AS coverage FROM k SEMI JOIN d USING (w) GROUP BY id")
def _(spark, d):
    return O.keyword_coverage(_ab(spark, d), "id", "a", "c", 3.0).withColumn("coverage", F.round("coverage", 6))


@Q(
    "X33_novelty_structure",
    _dual_base().rstrip() + f", {_TM}, rk AS (SELECT DISTINCT b.query_id, ff.file FROM b JOIN ff ON ff.task_name = b.path), kn AS (SELECT q.query_id, ff.file FROM q JOIN ff ON ff.task_name = q.query_id), st AS (SELECT rk.query_id, CASE WHEN contains(rk.file, '/') THEN split_part(rk.file, '/', 1) ELSE 'root' END AS m, count(*) AS c, count(kn.file) AS known FROM rk LEFT JOIN kn ON kn.query_id = rk.query_id AND kn.file = rk.file GROUP BY ALL), z AS (SELECT query_id, 1 - sum(known) / sum(c) AS n, max(c) / sum(c) AS s FROM st GROUP BY 1) SELECT query_id, round(n, 6) AS novelty, round(s, 6) AS structure, round(sqrt(n * s), 6) AS ses, round(coalesce(2 * n * s / nullif(n + s, 0), 0), 6) AS hes FROM z",
)
def _(spark, d):
    q, _, w = dual_sides(spark, d)
    f = task_files(spark, d)
    ranked = S.top_k(q, w, 5).join(f.select(F.col("task_name").alias("path"), "file"), "path").select("query_id", F.col("file").alias("path")).distinct()
    known = q.select("query_id").join(f.select(F.col("task_name").alias("query_id"), F.col("file").alias("path")), "query_id")
    r = O.novelty_structure(ranked, known, X.module_path(F.col("path")))
    return r.select("query_id", *[F.round(c, 6).alias(c) for c in ("novelty", "structure", "ses", "hes")])


@Q("Q01_module_search", _SEARCHED)
def _(spark, d):
    q, c, _ = search_sides(spark, d)
    return S.top_k(q, c, R.cap(10, "modules")).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@Q("A10_greedy_word_pairs")
def _(spark, d):
    # over the words of descriptions, where pairs of places are more frequent than descriptions with their words
    w = tickets(spark, d).select("id", F.explode(X.identifier_tokens(F.col("description"), 3)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("cnt"))
    c = stage(w, "words")
    return T.greedy_pairs(T.token_pairs(c, "id", "term", "cnt"), c.groupBy(F.col("term").alias("token")).agg(F.count("*").alias("df")))
