"""Queries of term statistics, tokens and links."""

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import terms as O
from weftline.plans.base import changes, ctes, task_files, task_modules, tickets, title_term_counts, title_words
from weftline.plans.registry import core
from weftline.runtime import table

Q = core.query
_TOK_ALL_LIST = "SELECT id, regexp_split_to_array(upper(replace(concat_ws(' ', coalesce(title,''), coalesce(description,''), coalesce(comments,'')), 'ß', 'ss')), '[^\\p{L}\\p{N}_]+') AS ts FROM t"
_TOK_ALL = f"SELECT id, unnest(ts) AS token FROM ({_TOK_ALL_LIST})"


def _tokens(spark, d):
    return tickets(spark, d).select("id", X.upper_split(X.concat_fields(F.col("title"), F.col("description"), F.col("comments"))).alias("ts"))


@Q("A01_token_dictionary_all", ctes("t", more=f"k AS ({_TOK_ALL})") + "SELECT DISTINCT token FROM k")
def _(spark, d):
    return _tokens(spark, d).select(F.explode("ts").alias("token")).distinct()


@Q("A02_token_bigrams_all", ctes("t", more=f"k AS ({_TOK_ALL_LIST}), e AS (SELECT id, ts, unnest(range(1, len(ts) + 1)) AS i FROM k)") + "SELECT CASE WHEN i > 1 THEN ts[i - 1] END AS prev, ts[i] AS cur, count(*) AS cnt FROM e GROUP BY ALL")
def _(spark, d):
    return O.bigrams(_tokens(spark, d), "id", "ts").groupBy("prev", "cur").agg(F.count("*").alias("cnt"))


@Q("A03_frequent_tokens_all", ctes("t", more=f"k AS ({_TOK_ALL})") + "SELECT token, count(*) AS cnt FROM k GROUP BY token HAVING count(*) > 100")
def _(spark, d):
    return _tokens(spark, d).select(F.explode("ts").alias("token")).groupBy("token").agg(F.count("*").alias("cnt")).where("cnt > 100")


@Q("A08_token_document_frequency_all", ctes("t", more=f"k AS ({_TOK_ALL})") + "SELECT token, count(DISTINCT id) AS df FROM k GROUP BY token")
def _(spark, d):
    return _tokens(spark, d).select(F.explode(F.array_distinct("ts")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


@Q("A09_tokens_of_task_all", ctes("t", more=f"k AS ({_TOK_ALL})") + "SELECT id, string_agg(token, ',' ORDER BY token) AS tokens FROM k GROUP BY id")
def _(spark, d):
    return _tokens(spark, d).select("id", F.array_join(F.sort_array("ts"), ",").alias("tokens"))


@Q(
    "A04_module_tfidf",
    ctes("tt", "tm", more="j AS (SELECT module, term, sum(cnt) AS c FROM tt JOIN tm ON tt.name = tm.task_name GROUP BY ALL), m AS (SELECT count(DISTINCT module) AS m FROM tm), s AS (SELECT module, sum(c) AS size FROM j GROUP BY 1), f AS (SELECT term, count(*) AS df FROM j GROUP BY 1)")
    + "SELECT module, term, round(c / size, 8) AS tf, round(CASE WHEN m > df THEN ln(m / df) ELSE 0 END, 8) AS idf, round(c / size * CASE WHEN m > df THEN ln(m / df) ELSE 0 END, 8) AS tfidf FROM j JOIN s USING (module) JOIN f USING (term), m",
)
def _(spark, d):
    tm = task_modules(spark, d)
    m = tm.select("module").distinct().count()
    r = O.module_tfidf(title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term", "cnt"), tm, m)
    return r.select("module", "term", *[F.round(c, 8).alias(c) for c in ("tf", "idf", "tfidf")])


@Q(
    "A05_corpus_tfidf",
    ctes("tt", more="n AS (SELECT count(DISTINCT id) AS n FROM tt), f AS (SELECT term, count(*) AS df FROM tt GROUP BY 1), x AS (SELECT id, term, cnt * (ln((1 + n) / (1 + df)) + 1) AS w FROM tt JOIN f USING (term), n)")
    + "SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x",
)
def _(spark, d):
    return O.corpus_tfidf(title_term_counts(spark, d), "id", "term", "cnt").withColumn("weight", F.round("weight", 6))


@Q(
    "A06_tf_df_idf",
    ctes("w", more="n AS (SELECT count(DISTINCT id) AS n FROM w)") + "SELECT term, count(*) AS tf, count(DISTINCT id) AS df, round(ln(any_value(n) / (count(DISTINCT id) + 1)), 8) AS idf FROM w, n GROUP BY term",
)
def _(spark, d):
    return O.tf_df_idf(title_words(spark, d), "id", "term").withColumn("idf", F.round("idf", 8))


@Q(
    "A07_mean_tfidf",
    ctes("tt", more="n AS (SELECT count(DISTINCT id) AS n FROM tt), f AS (SELECT term, count(*) AS df FROM tt GROUP BY 1), x AS (SELECT id, term, cnt * (ln((1 + n) / (1 + df)) + 1) AS w FROM tt JOIN f USING (term), n), y AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM x)")
    + "SELECT term, round(avg(weight), 6) AS mean_weight FROM y GROUP BY term",
)
def _(spark, d):
    return O.corpus_tfidf(title_term_counts(spark, d), "id", "term", "cnt").groupBy("term").agg(F.round(F.avg("weight"), 6).alias("mean_weight"))


@Q("A10_greedy_pairs")
def _(spark, d):
    c = title_term_counts(spark, d)
    pairs = O.token_pairs(c, "id", "term", "cnt")
    return O.greedy_pairs(pairs, c.groupBy(F.col("term").alias("token")).agg(F.count("*").alias("df")))


@Q("A11_title_term_counts", ctes("tt") + "SELECT * FROM tt")
def _(spark, d):
    return title_term_counts(spark, d)


_PREF = "p AS (SELECT id, task_name, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM r), e AS (SELECT id, task_name, ps, unnest(range(1, len(ps) + 1)) AS k FROM p), n AS (SELECT id, task_name, array_to_string(ps[1:k], '/') AS node, k - 1 AS lvl, k = len(ps) AS is_file, ps[1] AS root FROM e)"


def _nodes(spark, d):
    r = changes(spark, d).select("id", "task_name", X.path_parts(F.col("path")).alias("ps"), X.path_prefixes(F.col("path")).alias("pre"))
    e = r.select("id", "task_name", "ps", F.posexplode("pre").alias("lvl", "node"))
    return e.select("id", "task_name", "node", "lvl", (F.col("lvl") == F.size("ps") - 1).alias("is_file"), F.col("ps")[0].alias("root"))


@Q("A12_module_trie", ctes("r", more=_PREF) + "SELECT node, arg_min(lvl, id) AS lvl, CAST(arg_min(is_file, id) AS INTEGER) AS file, count(*) AS cnt FROM n GROUP BY node")
def _(spark, d):
    # a node's level and kind are those of the first row that made it
    return _nodes(spark, d).groupBy("node").agg(F.min_by("lvl", "id").cast("long").alias("lvl"), F.min_by(F.col("is_file").cast("int"), "id").alias("file"), F.count("*").alias("cnt"))


@Q("A12_module_task", ctes("r", more=_PREF) + "SELECT task_name, node, count(*) AS cnt FROM n GROUP BY ALL")
def _(spark, d):
    return _nodes(spark, d).groupBy("task_name", "node").agg(F.count("*").alias("cnt"))


_TN = _PREF + ", tn AS (SELECT DISTINCT task_name, node, lvl, root FROM n), fl AS (SELECT node, arg_min(is_file, id) AS is_file FROM n GROUP BY node), x AS (SELECT term, node, root, lvl, is_file, sum(cnt) AS c FROM tt JOIN tn ON tt.name = tn.task_name JOIN fl USING (node) GROUP BY ALL), tot AS (SELECT term, sum(c) AS t, sum(CASE WHEN is_file THEN c * c END) AS f2, count(*) FILTER (is_file) AS file_cnt, max(lvl) AS max_lvl FROM x GROUP BY term), rr AS (SELECT term, sum(rc * rc) AS r2, count(*) AS root_cnt FROM (SELECT term, root, sum(c) AS rc FROM x GROUP BY ALL) GROUP BY term)"


def _concentration(spark, d):
    n = _nodes(spark, d)
    kind = n.groupBy("node").agg(F.min_by("is_file", "id").alias("is_file"))
    tn = n.select("task_name", "node", "lvl", "root").distinct()
    x = title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term", "cnt").join(tn, "task_name")
    # add up by node before its kind is joined: nodes are far fewer than rows
    x = x.groupBy("term", "node", "root", "lvl").agg(F.sum("cnt").alias("cnt"))
    return O.concentration(x.join(kind, "node"))


@Q(
    "A13_term_concentration",
    ctes("r", "tt", more=_TN)
    + "SELECT term, file_cnt, root_cnt, round(coalesce(f2, 0) / (t * t), 8) AS hhi_file, round(r2 / (t * t), 8) AS hhi_root, round(coalesce(f2, 0) / (t * t) * (r2 / (t * t)), 8) AS composite, CAST(max_lvl + CASE WHEN root_cnt > 1 THEN 1 ELSE 0 END AS INTEGER) AS rank FROM tot JOIN rr USING (term)",
)
def _(spark, d):
    r = _concentration(spark, d)
    return r.select("term", "file_cnt", "root_cnt", *[F.round(c, 8).alias(c) for c in ("hhi_file", "hhi_root", "composite")], F.col("rank").cast("int").alias("rank"))


@Q("A13_term_rank_table", ctes("r", "tt", more=_TN + ", a AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS total_count, count(*) AS task_cnt FROM tt GROUP BY term)") + "SELECT a.term, a.total_count, a.task_cnt, coalesce(file_cnt, 0) AS file_cnt, coalesce(root_cnt, 0) AS root_cnt FROM a LEFT JOIN tot USING (term) LEFT JOIN rr USING (term)")
def _(spark, d):
    a = title_term_counts(spark, d).groupBy("term").agg(F.sum("cnt").alias("total_count"), F.count("*").alias("task_cnt"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return a.join(_concentration(spark, d), "term", "left").select("term", "total_count", "task_cnt", zero("file_cnt"), zero("root_cnt"))


@Q("A14_term_links", ctes("tt") + "SELECT a.term AS l, b.term AS r, count(*) AS cnt FROM tt a JOIN tt b ON a.id = b.id AND a.term < b.term GROUP BY ALL")
def _(spark, d):
    return O.unordered_links(title_term_counts(spark, d), "id", "term")


@Q("A14_file_links", ctes("f") + "SELECT a.file AS l, b.file AS r, count(*) AS cnt FROM f a JOIN f b ON a.task_name = b.task_name AND a.file < b.file GROUP BY ALL")
def _(spark, d):
    return O.unordered_links(task_files(spark, d), "task_name", "file")


@Q("A20_module_cooccurrence", ctes("tm", more="g AS (SELECT * FROM tm WHERE module <> '')") + "SELECT a.module AS l, b.module AS r, count(*) AS cnt FROM g a JOIN g b ON a.task_name = b.task_name AND a.module < b.module GROUP BY ALL")
def _(spark, d):
    return O.unordered_links(task_modules(spark, d).where("module <> ''"), "task_name", "module")


@Q("J09_token_pairs", ctes("tt") + "SELECT a.term AS a, b.term AS b, CAST(sum(CASE WHEN a.term = b.term THEN a.cnt * (a.cnt - 1) // 2 ELSE a.cnt * b.cnt END) AS BIGINT) AS cnt FROM tt a JOIN tt b ON a.id = b.id AND a.term <= b.term WHERE a.term < b.term OR a.cnt > 1 GROUP BY ALL")
def _(spark, d):
    return O.token_pairs(title_term_counts(spark, d), "id", "term", "cnt")


@Q("A15_term_totals", ctes("tt") + "SELECT term, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS tasks FROM tt GROUP BY term")
def _(spark, d):
    return title_term_counts(spark, d).groupBy("term").agg(F.sum("cnt").alias("total"), F.count("*").alias("tasks"))


@Q("A16_term_file_counts", ctes("tt", "f") + "SELECT term, file, CAST(sum(cnt) AS BIGINT) AS cnt FROM tt JOIN f ON tt.name = f.task_name GROUP BY ALL")
def _(spark, d):
    t = title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term", "cnt")
    return t.join(task_files(spark, d), "task_name").groupBy("term", "file").agg(F.sum("cnt").alias("cnt"))


_TMOD = "g AS (SELECT task_name, CASE WHEN contains(m, '.') THEN '' ELSE m END AS module, file FROM (SELECT task_name, file, split_part(regexp_replace(file, '^/+|/+$', '', 'g'), '/', 1) AS m FROM f))"


@Q("A16_term_module_counts", ctes("tt", "f", more=_TMOD) + "SELECT term, module, CAST(sum(cnt) AS BIGINT) AS cnt FROM tt JOIN g ON tt.name = g.task_name GROUP BY ALL")
def _(spark, d):
    # once for each file of the module: files are counted by task first, so rows are multiplied by modules, not by files
    m = task_files(spark, d).groupBy("task_name", X.root_module(F.col("file")).alias("module")).agg(F.count("*").alias("files"))
    t = title_term_counts(spark, d).select(F.col("name").alias("task_name"), "term", "cnt")
    return t.join(m, "task_name").groupBy("term", "module").agg(F.sum(F.col("cnt") * F.col("files")).alias("cnt"))


@Q("A17_hhi_terms", ctes("tt", "f", more="x AS (SELECT term, file, sum(cnt) AS c FROM tt JOIN f ON tt.name = f.task_name GROUP BY ALL)") + "SELECT term, round(sum(c * c) / (sum(c) * sum(c)), 8) AS hhi FROM x GROUP BY term")
def _(spark, d):
    x = core.queries["A16_term_file_counts"](spark, d)
    return O.hhi(x, "term", "cnt").withColumn("hhi", F.round("hhi", 8))


@Q(
    "A18_bradford_zones",
    ctes("tt", more="a AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS total FROM tt GROUP BY term), o AS (SELECT *, row_number() OVER w AS rn, sum(total) OVER w AS cum FROM a WINDOW w AS (ORDER BY total DESC, term)), g AS (SELECT sum(total) / 4.0 AS t FROM a), b1 AS (SELECT min(rn) AS rn, min(cum) AS cum FROM o, g WHERE cum >= t), b2 AS (SELECT min(o.rn) AS rn, min(o.cum) AS cum FROM o, g, b1 WHERE o.rn > b1.rn AND o.cum - b1.cum >= t), b3 AS (SELECT min(o.rn) AS rn FROM o, g, b2 WHERE o.rn > b2.rn AND o.cum - b2.cum >= t)")
    + "SELECT term, total, CAST(CASE WHEN o.rn <= b1.rn OR b1.rn IS NULL THEN 1 WHEN o.rn <= b2.rn OR b2.rn IS NULL THEN 2 WHEN o.rn <= b3.rn OR b3.rn IS NULL THEN 3 ELSE 4 END AS INTEGER) AS zone FROM o, b1, b2, b3",
)
def _(spark, d):
    return O.bradford_zones(core.queries["A15_term_totals"](spark, d).select("term", "total"), "term", "total")


@Q(
    "A19_term_rank_assembly",
    core.sql["A18_bradford_zones"].replace("SELECT term, total, CAST(CASE", "SELECT o.term, o.total, coalesce(h.hhi, 0) AS hhi, CAST(CASE").replace("FROM o, b1, b2, b3", "FROM o LEFT JOIN h USING (term), b1, b2, b3").replace("a AS (SELECT term, CAST", "r AS (SELECT id, sha, cmt_date, message, path, diff, task_name FROM rawdata WHERE task_name IS NOT NULL AND task_name <> '' AND path IS NOT NULL AND path <> ''), f AS (SELECT DISTINCT task_name, regexp_replace(replace(path, '\\', '/'), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS file FROM r), h AS (SELECT term, round(sum(c * c) / (sum(c) * sum(c)), 8) AS hhi FROM (SELECT term, file, sum(cnt) AS c FROM tt JOIN f ON tt.name = f.task_name GROUP BY ALL) GROUP BY term), a AS (SELECT term, CAST"),
)
def _(spark, d):
    z, h = core.queries["A18_bradford_zones"](spark, d), core.queries["A17_hhi_terms"](spark, d)
    return z.join(h, "term", "left").select("term", "total", F.coalesce("hhi", F.lit(0.0)).alias("hhi"), F.coalesce("zone", F.lit(4)).alias("zone"))


@Q("F10_identifier_tokens_all")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.identifier_tokens(F.col("text")).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@Q("F07_tfidf_tokens_all", ctes("t") + f"SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(description, '')), '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x85\\p{{Z}}]|\\p{{Nd}}|_', ' ', 'g'), '[\\s\\x0b\\x85\\p{{Z}}]+'), lambda x: len(x) > 1 AND NOT list_contains([{_STOP}], x)) AS tokens FROM t")
def _(spark, d):
    return tickets(spark, d).select("id", X.tfidf_tokens(F.col("description")).alias("tokens"))


@Q("F11_vocabulary_filter", ctes("w", more="v AS (SELECT term FROM w GROUP BY term HAVING count(DISTINCT id) >= 3)") + "SELECT id, term, count(*) AS cnt FROM w SEMI JOIN v USING (term) GROUP BY ALL")
def _(spark, d):
    w = title_words(spark, d)
    v = w.groupBy("term", "id").agg(F.count("*").alias("c")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 3")
    return w.join(v, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("cnt"))
