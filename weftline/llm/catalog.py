"""Queries of the training-data operators with their SQL."""

from pyspark.sql import functions as F

from weftline.functions.names import path_text, task_key
from weftline.llm import bpe, encodings, neighbours, overlap, packing, pairs, splits, terms
from weftline.operators.hierarchy import resolve_hierarchy
from weftline.plans.registry import Registry
from weftline.runtime import table

llm = Registry()

_TERMS = """WITH one AS (SELECT name, min(title) AS title FROM task WHERE name IS NOT NULL GROUP BY name UNION ALL SELECT name, title FROM task WHERE name IS NULL),
w AS (SELECT row_number() OVER () AS rec, list_filter(regexp_split_to_array(lower(regexp_replace(title, '[^a-zA-Z0-9\\s\\x1c-\\x1f\\x85\\p{Z}-]', '', 'g')), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '') AS ts FROM one),
o AS (SELECT rec, unnest(ts) AS term FROM w),
c AS (SELECT term, count(*) AS total_count, count(DISTINCT rec) AS task_cnt FROM o GROUP BY term),
n AS (SELECT count(*) AS n FROM w WHERE len(ts) > 0)"""

_WS = "[ \\t\\n\\r\\f\\x0b]"
_TASK_KEY = f"""CASE WHEN regexp_matches(regexp_replace(trim(task_name, E' \\t\\n\\r'), '^[A-Za-z]+://.*/', ''), '[A-Za-z][A-Za-z0-9]*?[ _#:.–-]*0*[0-9]+') THEN
 upper(regexp_extract(regexp_replace(trim(task_name, E' \\t\\n\\r'), '^[A-Za-z]+://.*/', ''), '^[^A-Za-z0-9]*([A-Za-z][A-Za-z0-9]*?)[ _#:.–-]*0*([0-9]+)([^A-Za-z0-9].*)?$', 1)) || '-' ||
 regexp_extract(regexp_replace(trim(task_name, E' \\t\\n\\r'), '^[A-Za-z]+://.*/', ''), '^[^A-Za-z0-9]*([A-Za-z][A-Za-z0-9]*?)[ _#:.–-]*0*([0-9]+)([^A-Za-z0-9].*)?$', 2) END"""
_UP = "regexp_replace({}, '(^|/)[^/]+/[.][.](/|$)', '\\1')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace('/' || replace(regexp_replace(path, '^{_WS}+|{_WS}+$', '', 'g'), '\\', '/') || '/', '/([.]?/)+', '/', 'g'), '/([.]/)+', '/', 'g'), '^/|/$', '', 'g')"
_PATH = f"nullif({_UP.format(_UP.format(_CLEAN))}, '')"

_TIED = f"""WITH RECURSIVE x AS (SELECT nullif({_TASK_KEY}, '-') AS task, lower(trim(sha, E' \\t\\n\\r')) AS s FROM rawdata),
h AS (SELECT DISTINCT s FROM x WHERE regexp_full_match(s, '[0-9a-f]{{4,40}}') AND s <> repeat('0', 40)),
ful AS (SELECT s FROM h WHERE length(s) = 40), ab AS (SELECT h.s, min(ful.s) AS f FROM h JOIN ful ON starts_with(ful.s, h.s) WHERE length(h.s) < 40 GROUP BY h.s HAVING count(*) = 1),
res AS (SELECT s, s AS f FROM ful UNION ALL SELECT s, f FROM ab),
e AS (SELECT DISTINCT x.task, res.f FROM x JOIN res USING (s) WHERE x.task IS NOT NULL),
l AS (SELECT DISTINCT a.task AS a, b.task AS b FROM e a JOIN e b ON a.f = b.f AND a.task <> b.task),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS task_name, least(a, min(b)) AS group_name FROM r GROUP BY a"""

_PAIRS = f"""WITH i AS (SELECT DISTINCT nullif({_TASK_KEY}, '-') AS task, {_PATH} AS path FROM rawdata), j AS (SELECT * FROM i WHERE task IS NOT NULL AND path IS NOT NULL),
n AS (SELECT count(DISTINCT task) AS n FROM j), d AS (SELECT path, count(*) AS d FROM j GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT j.*, d FROM j JOIN d USING (path)),
p AS (SELECT a.path AS l_path, b.path AS r_path, any_value(a.d) AS da, any_value(b.d) AS db, count(*) AS c FROM k a JOIN k b ON a.task = b.task AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT l_path, r_path FROM p, n WHERE c * n >= 5 * da * db"""

_CLOSE = """WITH v AS (SELECT id, coalesce(path, chr(1)) AS path, coalesce(type, chr(1)) AS type, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM vec_collection WHERE vector IS NOT NULL AND id IS NOT NULL),
u AS (SELECT *, len(v) AS dim, sqrt(list_dot_product(v, v)) AS n FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS s FROM u a JOIN u b ON a.type = b.type AND a.dim = b.dim AND a.path <> b.path),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS l_id, greatest(a, b) AS r_id FROM t WHERE s >= 0.9 - 1e-7"""


@llm.query("p1_found", _TIED)
def p1_found(spark, d):
    return splits.tied_tasks(splits.split_records(table(spark, d, "rawdata"), table(spark, d, "split_plan")))


@llm.query("p1_splits")
def p1_splits(spark, d):
    return splits.split_records(table(spark, d, "rawdata"), table(spark, d, "split_plan"))


@llm.query("p1_report")
def p1_report(spark, d):
    plan = table(spark, d, "split_plan")
    return splits.split_report(splits.split_records(table(spark, d, "rawdata"), plan), plan)


@llm.query("p2_found", _TERMS + " SELECT term, CASE WHEN task_cnt < 3 THEN 'rare' ELSE 'common' END AS mark FROM c, n WHERE task_cnt < 3 OR task_cnt * 20 > n.n")
def p2_found(spark, d):
    return terms.marked_terms(table(spark, d, "task"))


@llm.query(
    "p2_terms",
    _TERMS
    + """, s AS (SELECT lower(trim(term)) AS st, max(total_count) AS stored_total_count, max(task_cnt) AS stored_task_cnt, count(*) AS n_stored FROM term_rank WHERE term IS NOT NULL GROUP BY 1)
SELECT coalesce(term, st) AS term, coalesce(c.total_count, 0) AS total_count, coalesce(c.task_cnt, 0) AS task_cnt, stored_total_count, stored_task_cnt, coalesce(n_stored, 0) AS n_stored,
 coalesce(c.total_count, 0) IS NOT DISTINCT FROM stored_total_count AND coalesce(c.task_cnt, 0) IS NOT DISTINCT FROM stored_task_cnt AS agrees,
 CASE WHEN c.task_cnt < 3 THEN 'rare' WHEN c.task_cnt * 20 > n.n THEN 'common' END AS mark
FROM c FULL JOIN s ON c.term = s.st, n""",
)
def p2_terms(spark, d):
    return terms.term_report(table(spark, d, "task"), table(spark, d, "term_rank"))


@llm.query("p7_ids")
def p7_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"))


def _packed(spark, d):
    return packing.pack(bpe.token_counts(table(spark, d, "documents")), "doc_id", "n_tokens")


@llm.query("p8_containers")
def p8_containers(spark, d):
    return _packed(spark, d)


@llm.query("p8_report")
def p8_report(spark, d):
    return packing.packing_report(_packed(spark, d))


def _task_paths(spark, d):
    r = table(spark, d, "rawdata")
    return r.select(task_key(F.col("task_name")).alias("task"), path_text(F.col("path")).alias("path"))


def _stored_links(links, left, right, names):
    """(sl, sr, stored_cnt): rows stored twice once, sides in the order of names, null counts as none, batches added up."""
    a = names.select(F.col("nid").alias(left), F.col("nm").alias("a"))
    b = names.select(F.col("nid").alias(right), F.col("nm").alias("b"))
    j = links.distinct().join(a, left).join(b, right).where("a <> b")
    j = j.select("batch_no", F.least("a", "b").alias("sl"), F.greatest("a", "b").alias("sr"), F.coalesce("cnt", F.lit(0)).alias("cnt")).groupBy("batch_no", "sl", "sr").agg(F.max("cnt").alias("cnt"))
    return j.groupBy("sl", "sr").agg(F.sum("cnt").alias("stored_cnt"))


def _beside_stored(inc, item, basket, stored, least=2):
    """Every pair that meets (with least 2: but in one heavy basket only) or is stored, with its surprise and the stored count (null for none)."""
    s = pairs.stage(stored.select(F.col("sl").alias("l"), F.col("sr").alias("r"), F.col("stored_cnt").alias("note")), "stored")
    return pairs.cooccurrence(inc, item, basket, least, also=s).withColumnRenamed("note", "stored_cnt")


@llm.query("p4_found", _PAIRS)
def p4_found(spark, d):
    p = pairs.cooccurrence(_task_paths(spark, d), "path", "task", 5, 0.2)
    # surprise orders the pairs, the stated bound on the lift decides
    p = p.where("log10_q <= 0 and common * n_baskets >= 5 * n_l * n_r")
    return p.select(F.col("l").alias("l_path"), F.col("r").alias("r_path"))


def _files(spark, d, least):
    tree = resolve_hierarchy(table(spark, d, "module_tree")).select(F.col("id").alias("nid"), F.col("path").alias("nm")).where("nm is not null")
    s = _stored_links(table(spark, d, "file_links"), "l_file", "r_file", tree)
    return _beside_stored(_task_paths(spark, d), "path", "task", s, least).withColumnsRenamed({"l": "l_path", "r": "r_path"})


@llm.query("p4_files")
def p4_files(spark, d):
    return _files(spark, d, 2)


@llm.query("p4_files_all")
def p4_files_all(spark, d):
    """p4_files and the pairs that meet in one heavy task only, listed one by one."""
    return _files(spark, d, 1)


@llm.query("p4_file_groups")
def p4_file_groups(spark, d):
    """Paths of heavy tasks: two of a task that p4_files does not list meet in this task only."""
    return pairs.study(_task_paths(spark, d), "path", "task").members.withColumnsRenamed({"basket": "task_name", "item": "path"})


@llm.query("p4_files_once")
def p4_files_once(spark, d):
    """Pairs of paths that meet in one heavy task only, by their numbers of tasks, with lift and surprise."""
    return pairs.study(_task_paths(spark, d), "path", "task").once


def _title_terms(spark, d):
    t = terms.one_per_record(table(spark, d, "task"), "name", "title").select(F.monotonically_increasing_id().alias("task"), terms.title_terms(F.col("v")).alias("ts"))
    return pairs.stage(t.select("task", F.explode("ts").alias("term")), "title-terms")


def _terms(spark, d, least):
    names = table(spark, d, "term_rank").select(F.col("term_id").alias("nid"), F.lower(F.trim("term")).alias("nm"))
    s = _stored_links(table(spark, d, "term_links"), "l_term", "r_term", names)
    return _beside_stored(_title_terms(spark, d), "term", "task", s, least).withColumnsRenamed({"l": "l_term", "r": "r_term"})


@llm.query("p4_terms")
def p4_terms(spark, d):
    return _terms(spark, d, 2)


@llm.query("p4_terms_all")
def p4_terms_all(spark, d):
    """p4_terms and the pairs that meet in one long title only, listed one by one."""
    return _terms(spark, d, 1)


@llm.query("p9_found")
def p9_found(spark, d):
    return encodings.repair(table(spark, d, "documents")).where("damaged").select("doc_id")


@llm.query("p9_texts")
def p9_texts(spark, d):
    return encodings.repair(table(spark, d, "documents"))


def _overlaps(spark, d):
    return overlap.split_overlaps(table(spark, d, "task"), table(spark, d, "task_split"))


@llm.query("p5_found")
def p5_found(spark, d):
    return _overlaps(spark, d).select(F.least("train_id", "eval_id").alias("l_id"), F.greatest("train_id", "eval_id").alias("r_id"))


@llm.query("p5_pairs")
def p5_pairs(spark, d):
    return _overlaps(spark, d)


@llm.query("p5_report")
def p5_report(spark, d):
    return overlap.overlap_report(_overlaps(spark, d), table(spark, d, "task_split"))


@llm.query("p3_found", _CLOSE)
def p3_found(spark, d):
    return neighbours.close_pairs(table(spark, d, "vec_collection"))


@llm.query("p3_pairs")
def p3_pairs(spark, d):
    return neighbours.most_similar(table(spark, d, "vec_collection"))


@llm.query("p3_search")
def p3_search(spark, d):
    return neighbours.search_rows(table(spark, d, "vec_collection"))
