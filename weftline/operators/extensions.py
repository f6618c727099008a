"""Scores that the reference's documents specify without code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import cosine


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) = sum over query tokens of the greatest similarity to a token of the document, for stated
    candidates: query_tokens (query_id, doc_id, q), doc_tokens (doc_id, d), vectors of length 1 or not.

    Tokens meet by document, so no pair outside the candidates is made; a document's token vectors come as one array.
    """
    docs = doc_tokens.groupBy("doc_id").agg(F.collect_list("d").alias("ds"))
    j = query_tokens.join(docs, "doc_id")
    best = F.array_max(F.transform("ds", lambda d: cosine(F.col("q"), d)))
    return j.groupBy("query_id", "doc_id").agg(F.sum(best).alias("score"))


def top_terms(weights: DataFrame, group: str, term: str, weight: str, k: int = 10) -> DataFrame:
    """The k heaviest terms of each group, ties by term."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.col(weight).desc(), term))
    return weights.withColumn("rank", r).where(F.col("rank") <= k).select(group, term, weight, "rank")


def confidence_score(sims: Column, tfidf: Column, matches: Column, alpha: float = 0.5, beta: float = 0.1) -> Column:
    """X05"""
    return sims + alpha * tfidf + beta * matches


def line_window(df: DataFrame, file: str, line: str, width: int = 15) -> DataFrame:
    """(file, lo, hi) windows around lines, overlapping ones merged, by two windows over a file's lines."""
    w = Window.partitionBy(file).orderBy(line)
    x = df.select(file, line).distinct().withColumn("gap", F.col(line) - F.lag(line).over(w))
    x = x.withColumn("run", F.sum(F.when(F.col("gap") <= 2 * width + 1, 0).otherwise(1)).over(w))
    return x.groupBy(file, "run").agg(F.greatest(F.min(line) - width, F.lit(1)).alias("lo"), (F.max(line) + width).alias("hi")).drop("run")


def line_accuracy(predicted: DataFrame, actual: DataFrame, width: int = 20) -> DataFrame:
    """(file, line, hit) of each actual line (file, line): whether a predicted line of its file is within width.

    A range join by bins of the width: each predicted line goes to its bin and the two beside it, so lines meet by equality.
    """
    b = F.floor(F.col("line") / width)
    p = predicted.select("file", F.col("line").alias("p"), F.explode(F.array(b - 1, b, b + 1)).alias("bin"))
    a = actual.select("file", "line", b.alias("bin"))
    near = a.join(p, ["file", "bin"]).where(F.abs(F.col("line") - F.col("p")) <= width).select("file", "line").distinct().withColumn("hit", F.lit(True))
    return actual.select("file", "line").distinct().join(near, ["file", "line"], "left").select("file", "line", F.coalesce("hit", F.lit(False)).alias("hit"))


def asymmetry(docs: DataFrame, code: DataFrame, key: str, item: str) -> DataFrame:
    """(key, asymmetry) = share of a key's items in docs that code lacks."""
    c = code.select(key, item).distinct().withColumn("_c", F.lit(1))
    return docs.select(key, item).distinct().join(c, [key, item], "left").groupBy(key).agg((1 - F.count("_c") / F.count("*")).alias("asymmetry"))


def harmony(edges: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """One row, the share of marked nodes among the k nodes of highest degree, ties by node. edges (l, r), marked (node)."""
    d = edges.select(F.explode(F.array("l", "r")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    top = d.orderBy(F.col("degree").desc(), "node").limit(k)
    return top.join(marked.select("node").distinct().withColumn("_m", F.lit(1)), "node", "left").agg(F.avg(F.coalesce("_m", F.lit(0))).alias("harmony"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth) of nodes within depth steps of each seed over undirected edges (l, r), by one join for each step; only new
    nodes go on, so a step never repeats what is known."""
    both = edges.select("l", "r").union(edges.select(F.col("r"), F.col("l"))).distinct()
    known = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0))
    front = known
    for i in range(1, depth + 1):
        step = front.join(both, F.col("node") == F.col("l")).select("seed", F.col("r").alias("node")).distinct()
        front = step.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(i))
        known = known.unionByName(front)
    return known


def retrieval_symmetry(ranked: DataFrame, k: int) -> DataFrame:
    """X11: (query_id, symmetry) = share of a query's k neighbours that have it among their own k."""
    r = ranked.where(F.col("rank") <= k).select("query_id", "path")
    back = r.select(F.col("path").alias("query_id"), F.col("query_id").alias("path")).withColumn("_b", F.lit(1))
    return r.join(back, ["query_id", "path"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_b", F.lit(0))).alias("symmetry"))


def keyword_boost(ranked: DataFrame, hits: DataFrame, boost: float = 0.5, penalty: float = 0.3) -> DataFrame:
    """Scores raised for paths that hold one of the query's keywords, lowered for the others of a query that has keywords; hits (query_id, path)."""
    h = hits.select("query_id", "path").distinct().withColumn("_h", F.lit(1))
    has = hits.select("query_id").distinct().withColumn("_q", F.lit(1))
    j = ranked.join(h, ["query_id", "path"], "left").join(has, "query_id", "left")
    return j.select("query_id", "path", (F.col("score") + F.when(F.col("_h") == 1, boost).when(F.col("_q") == 1, -penalty).otherwise(0.0)).alias("score"))


def coverage_penalty(ranked: DataFrame, weight: float = 0.1) -> DataFrame:
    """Score less weight times the share of queries whose results hold the path."""
    n = ranked.agg(F.countDistinct("query_id").alias("n"))
    c = ranked.groupBy("path").agg(F.countDistinct("query_id").alias("c")).join(F.broadcast(n)).select("path", (F.col("c") / F.col("n")).alias("coverage"))
    return ranked.join(c, "path").select("query_id", "path", "coverage", (F.col("score") - weight * F.col("coverage")).alias("score"))


def feedback_terms(ranked: DataFrame, terms: DataFrame, k: int = 5, n: int = 10) -> DataFrame:
    """The n terms that most of a query's k best documents share; terms (path, term) distinct."""
    c = ranked.where(F.col("rank") <= k).select("query_id", "path").join(terms, "path").groupBy("query_id", "term").agg(F.count("*").alias("docs"))
    return top_terms(c, "query_id", "term", "docs", n)


def fusion_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, complementarity) = 1 less the Jaccard share of two result lists."""
    x = a.groupBy("query_id").agg(F.collect_set("path").alias("x"))
    y = b.groupBy("query_id").agg(F.collect_set("path").alias("y"))
    none = F.array().cast("array<string>")
    j = x.join(y, "query_id", "full").select("query_id", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    return j.select("query_id", (1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("complementarity"))


def grounding(answer: Column, context: Column) -> list[Column]:
    """Novelty, grounding and density of an answer's terms against its context's (arrays of terms); null for an answer without terms."""
    a, c = F.array_distinct(answer), F.array_distinct(context)
    n = F.nullif(F.size(a), F.lit(0))
    return [(F.size(F.array_except(a, c)) / n).alias("novelty"), (F.size(F.array_intersect(a, c)) / n).alias("grounding"), (n / F.nullif(F.size(answer), F.lit(0))).alias("density")]


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks."""
    k = F.size(tokens) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_recall(reference: Column, candidate: Column, n: int) -> Column:
    """Distinct n-grams of the reference that the candidate has, by their number; 0 for none."""
    r = F.array_distinct(ngrams(reference, n))
    return F.coalesce(F.size(F.array_intersect(r, ngrams(candidate, n))) / F.nullif(F.size(r), F.lit(0)), F.lit(0.0))


def turn_report(turns: DataFrame, conv: str, turn: str, tokens: str, budget: int = 4096) -> DataFrame:
    """(conv, turn, gain, drift, entropy, used, within) of each turn: new terms, share of terms unlike the turn before, entropy of its
    words in bits, tokens used so far and whether they fit the budget."""
    w = Window.partitionBy("_c").orderBy("_k")
    t = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_k"), F.col(tokens).alias("_t"), F.array_distinct(tokens).alias("_d"))
    t = t.withColumn("_p", F.lag("_d").over(w)).withColumn("used", F.sum(F.size("_t")).over(w))
    first = t.select("_c", "_k", F.explode("_d").alias("_x")).groupBy("_c", "_x").agg(F.min("_k").alias("_k")).groupBy("_c", "_k").agg(F.count("*").alias("_g"))
    n = F.size("_t")
    count = lambda x: F.size(F.filter("_t", lambda y: y == x))
    ent = F.aggregate(F.transform("_d", lambda x: -(count(x) / n) * F.log2(count(x) / n)), F.lit(0.0), lambda a, x: a + x)
    drift = F.when(F.col("_p").isNull(), 0.0).otherwise(1 - F.size(F.array_intersect("_d", "_p")) / F.nullif(F.size(F.array_union("_d", "_p")), F.lit(0)))
    return t.join(first, ["_c", "_k"], "left").select(
        F.col("_c").alias(conv), F.col("_k").alias(turn), F.coalesce("_g", F.lit(0)).alias("gain"), drift.alias("drift"), ent.alias("entropy"), "used", (F.col("used") <= budget).alias("within")
    )


def novelty_structure(ranked: DataFrame, known: DataFrame, module: Column) -> DataFrame:
    """(query_id, novelty, structure, ses, hes): share of results the query doesn't know yet, share in its most frequent module, the
    root of their product and their harmonic mean (0 if both are 0)."""
    k = known.select("query_id", "path").distinct().withColumn("_k", F.lit(1))
    x = ranked.join(k, ["query_id", "path"], "left").withColumn("m", module)
    a = x.groupBy("query_id").agg((1 - F.count("_k") / F.count("*")).alias("novelty"), F.count("*").alias("n"))
    m = x.groupBy("query_id", "m").agg(F.count("*").alias("c")).groupBy("query_id").agg(F.max("c").alias("c"))
    s = F.col("c") / F.col("n")
    return a.join(m, "query_id").select("query_id", "novelty", s.alias("structure"), F.sqrt(F.col("novelty") * s).alias("ses"), F.coalesce(2 * F.col("novelty") * s / F.nullif(F.col("novelty") + s, F.lit(0.0)), F.lit(0.0)).alias("hes"))


def memoization(key_terms: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """(id, mhr): share of a task's distinct terms (id, term) that stand in a link (l, r, cnt) of `least` tasks or more."""
    k = links.where(F.col("cnt") >= least)
    known = k.select(F.col("l").alias("term")).union(k.select("r")).distinct().withColumn("_k", F.lit(1))
    return key_terms.join(known, "term", "left").groupBy("id").agg((F.count("_k") / F.count("*")).alias("mhr"))


def noise_reduction(candidates: DataFrame, relevant: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, noise, removed): of a query's candidates (query_id, file) that aren't relevant, their number and the share that isn't kept.
    All three sides are distinct; queries without such candidates have no row."""
    n = candidates.join(relevant, ["query_id", "file"], "left_anti").join(kept.withColumn("_k", F.lit(1)), ["query_id", "file"], "left")
    return n.groupBy("query_id").agg(F.count("*").alias("noise"), (1 - F.count("_k") / F.count("*")).alias("removed"))


def specificity(vectors: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """(id, specificity) = 1 less the cosine to the mean of all units' vectors; null for a vector without direction."""
    from weftline.functions.vectors import cosine, mean_columns, pack

    c = vectors.agg(*mean_columns(vector, dim)).select(pack(dim).alias("_c"))
    return vectors.join(F.broadcast(c)).select(id, (1 - cosine(F.col(vector), F.col("_c"))).alias("specificity"))


def expand_queries(queries: DataFrame, ranked: DataFrame, terms: DataFrame, k: int = 5, n: int = 10) -> DataFrame:
    """(query_id, text, expanded): the text (null as empty) and, behind it, the n terms that most of its k best documents share and it hasn't itself,
    most shared first, ties by term. queries (query_id, text), terms (path, term) distinct."""
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    own = q.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9-]+"))).alias("term"))
    c = ranked.where(F.col("rank") <= k).select("query_id", "path").join(terms, "path").groupBy("query_id", "term").agg(F.count("*").alias("docs")).join(own, ["query_id", "term"], "left_anti")
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("docs").desc(), "term"))
    t = c.withColumn("_r", top).where(F.col("_r") <= n).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_r", "term"))).alias("a"))
    return q.join(t, "query_id", "left").select("query_id", "text", F.concat_ws(" ", "text", F.array_join(F.transform("a", lambda x: x["term"]), " ")).alias("expanded"))


def accept_expansion(expanded: DataFrame, embedded, least: float = 0.6) -> DataFrame:
    """Adds cos, that of the text's and the expanded text's vector, and used: the expanded text, or the text where cos is below `least` (or unknown).
    embedded(df, id, column) gives (id, v) of texts."""
    from weftline.functions.vectors import cosine

    a, b = embedded(expanded, "query_id", F.col("text")).withColumnRenamed("v", "_a"), embedded(expanded, "query_id", F.col("expanded")).withColumnRenamed("v", "_b")
    c = a.join(b, "query_id").select("query_id", cosine(F.col("_a"), F.col("_b")).alias("cos"))
    return expanded.join(c, "query_id").withColumn("used", F.when(F.col("cos") >= least, F.col("expanded")).otherwise(F.col("text")))


def time_spread(ranked: DataFrame, dates: DataFrame) -> DataFrame:
    """(query_id, temporal_coverage, recency) of results (query_id, path) by dates (path, at: seconds): their span by that of all dates, and how late
    in it they lie on average. Null where all dates are one."""
    z = dates.agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    d = ranked.join(dates, "path").join(F.broadcast(z))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0).cast(dates.schema["at"].dataType))
    return d.groupBy("query_id").agg(F.max((F.col("at") - F.col("_lo")) / span).alias("_a"), F.min((F.col("at") - F.col("_lo")) / span).alias("_b"), F.avg((F.col("at") - F.col("_lo")) / span).alias("recency")).select("query_id", (F.col("_a") - F.col("_b")).alias("temporal_coverage"), "recency")


def diversity(ranked: DataFrame, modules: DataFrame) -> DataFrame:
    """(query_id, diversity): different modules by retrieved pairs of path and module; modules (path, module) distinct."""
    return ranked.select("query_id", "path").join(modules, "path").groupBy("query_id").agg((F.countDistinct("module") / F.count("*")).alias("diversity"))


def efficiency(answer: Column, context: Column) -> Column:
    """Terms of the answer that are new to the context, by the answer's tokens; null for an answer without tokens."""
    return F.size(F.array_except(F.array_distinct(answer), context)) / F.nullif(F.size(answer), F.lit(0))


def keyword_coverage(texts: DataFrame, id: str, reference: str, candidate: str, least_idf: float) -> DataFrame:
    """(id, coverage): share of the reference's terms with idf = ln(n / df) above least_idf that the candidate has; rows without such terms are left out."""
    n = texts.agg(F.count("*").alias("_n"))
    t = texts.select(id, F.explode(F.array_distinct(reference)).alias("_t"))
    df = t.groupBy("_t").agg(F.count("*").alias("_d")).join(F.broadcast(n)).where(F.ln(F.col("_n") / F.col("_d")) > least_idf).select("_t")
    key = t.join(df, "_t")
    c = texts.select(id, F.explode(F.array_distinct(candidate)).alias("_t")).withColumn("_k", F.lit(1))
    return key.join(c, [id, "_t"], "left").groupBy(id).agg((F.count("_k") / F.count("*")).alias("coverage"))
