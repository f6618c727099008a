import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import analysis, components, extensions, hierarchy, matching, metrics, ranking, search, splits, terms
from weftline.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def kinds_by_walk(tree):
    out = {}
    for i, (p, lvl) in tree.items():
        seen, x, k = [i], p, None
        while k is None:
            if x is None:
                k = "tree"
            elif x not in tree:
                k = "orphan"
            elif x == i:
                k = "cycle"
            elif x in seen:
                k = "below_cycle"
            else:
                seen.append(x)
                x = tree[x][0]
        if k != "tree" or lvl != len(seen) - 1:
            out[i] = "lvl" if k == "tree" else k
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_faults(spark, seed):
    rng = random.Random(seed)
    n = 150
    tree = {}
    for i in range(n):
        p = rng.choice([None, *range(max(0, i - 4), i)]) if rng.random() < 0.9 else rng.randrange(n + 5)
        tree[i] = (p, rng.choice([None, 0, 1, 2]))
    for i in range(40, 110):  # a deep chain, and a long cycle
        tree[i] = (i - 1 if i > 40 else None, i - 40)
    for i in range(110, 140):
        tree[i] = (i + 1 if i < 139 else 110, 1)
    data = [(i, p, f"n{i}", lvl, "x") for i, (p, lvl) in tree.items()]
    df = spark.createDataFrame(data + data[:9] + [(None, 3, "no", 1, "x")], "id long, parent_id long, name string, lvl int, root_id string")
    got = {r.id: r.kind for r in hierarchy.hierarchy_faults(df).collect()}
    assert got == kinds_by_walk(tree)
    if seed == 0:
        r = {x.id: x for x in hierarchy.with_descendants(hierarchy.resolve_hierarchy(df)).collect()}
        assert r[109].depth == 69 and r[109].path == "/".join(f"n{i}" for i in range(40, 110)) and r[109].root_id == 40
        assert r[110].path is None and r[110].descendants is None


def test_hierarchy_of_nothing(spark):
    df = spark.createDataFrame([], "id long, parent_id long, name string, lvl int")
    assert hierarchy.hierarchy_faults(df).collect() == [] and hierarchy.descendants(hierarchy.resolve_hierarchy(df)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 380)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_exact_rank(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, F.lit("a")).alias("g"))
    r = ranking.exact_rank(df, ["g"], F.col("id"), "rk", 8).collect()
    assert sorted(x.rk for x in r if x.g == "a") == list(range(1500)) and sorted(x.rk for x in r if x.g is None) == list(range(500))


def test_bradford(spark):
    t = [("a", 10), ("b", 2)] + [(c, 1) for c in "cdefghij"]
    z = {r.term: r.zone for r in terms.bradford_zones(spark.createDataFrame(t, "term string, total long"), "term", "total").collect()}
    assert z["a"] == 1 and [z[c] for c in "bcde"] == [2] * 4 and [z[c] for c in "fghij"] == [3] * 5


@pytest.mark.parametrize("seed", range(4))
def test_bradford_like_the_sequence(spark, seed):
    rng = random.Random(seed)
    t = [(f"t{i:03d}", rng.choice([1, 1, 1, 2, 3, 7, 20])) for i in range(rng.randrange(1, 60))]
    target, zone, have, want = sum(x for _, x in t) / 4, 1, 0, {}
    for term, x in sorted(t, key=lambda p: (-p[1], p[0])):
        want[term] = zone
        have += x
        if have >= target and zone < 4:
            zone, have = zone + 1, 0
    assert {r.term: r.zone for r in terms.bradford_zones(spark.createDataFrame(t, "term string, total long"), "term", "total").collect()} == want


def test_hhi_pairs_and_bigrams(spark):
    h = terms.hhi(spark.createDataFrame([("x", 3), ("x", 1), ("y", 0)], "k string, c long"), "k", "c")
    assert rows(h) == [("x", 0.625), ("y", 0.0)]
    c = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "d int, t string, c long")
    assert rows(terms.token_pairs(c, "d", "t", "c")) == [("a", "a", 1), ("a", "b", 2)]
    b = terms.bigrams(spark.createDataFrame([(1, ["x", "y"])], "d int, ts array<string>"), "d", "ts")
    assert [(r.prev, r.cur) for r in b.orderBy("pos").collect()] == [(None, "x"), ("x", "y")]
    p = spark.createDataFrame([("a", "b", 9), ("a", "c", 8), ("d", "e", 8), ("f", "g", 1)], "a string, b string, cnt long")
    df = spark.createDataFrame([(x, 5) for x in "abcdefg"], "token string, df long")
    assert rows(terms.greedy_pairs(p, df)) == [("a", "b", 9), ("d", "e", 8)]


def test_links_of_hot_groups(spark):
    d = [("h", i) for i in range(60)] + [("s", 1), ("s", 2), ("s", None), (None, 4), ("s", 2)]
    df = spark.createDataFrame(d, "g string, i int")
    got = {(r.l, r.r): r.cnt for r in terms.unordered_links(df, "g", "i", hot=7).collect()}
    want = {p: 1 for p in itertools.combinations(range(60), 2)}
    want[1, 2] = 2
    assert got == want


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    ranked = spark.createDataFrame([(1, "A", 1), (1, "x", 2), (1, "B", 3), (2, "A", 1), (3, "A", 1)], "query_id int, path string, rank int")
    rel = spark.createDataFrame([(1, "A"), (1, "B"), (3, "A")], "query_id int, path string")
    r = {x.query_id: x for x in metrics.per_query(q, ranked, rel, (1, 3)).collect()}
    assert abs(r[1].ap - 5 / 6) < 1e-12 and r[1].rr == 1 and r[1].p_1 == 1 and r[1].r_1 == 0.5 and abs(r[1].p_3 - 2 / 3) < 1e-12 and r[1].r_3 == 1
    assert (r[2].ap, r[2].rr, r[2].p_1, r[2].r_3) == (0, 0, 0, 0) and abs(r[3].p_3 - 1 / 3) < 1e-12
    assert len(metrics.per_query(q, ranked, rel, (1,), skip_empty=True).collect()) == 2
    s = metrics.summary(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double"), "v").first()
    assert (s.q1, s.q3, s.median, s.min, s.max) == (2, 4, 2.5, 1, 4)
    s = metrics.summary(spark.createDataFrame([(7.0,)], "v double"), "v").first()
    assert (s["std"], s.q1, s.median) == (0, 7, 7)


def test_splits(spark):
    t = spark.range(10).withColumnRenamed("id", "k")
    test = lambda s, n: sorted(r.k for r in splits.split(t, "k", s, n).where("is_test").collect())
    assert test("modn", 3) == [0, 3, 6] and test("middlen", 4) == [3, 4, 5, 6] and test("recent", 2) == [8, 9] and test("firstn", 2) == [0, 1]
    assert test("modn", 20) == list(range(10))
    assert len(splits.split_by_id(spark.range(1000), "id", 100).where("is_test").collect()) == 100
    raw = [(i, "a" * 40, "Merge x and more", f"p{i}", "d", "2020-01-01") for i in range(2)] + [(9, "b" * 40, "fix it", "p", "d", None)]
    raw += [(100 + i, "c" * 40, "A subject long enough\nbody", f"p{i}", "d", None) for i in range(51)]
    raw += [(300, "d" * 40, None, "p", "one", None), (301, "d" * 40, "A subject long enough\nbody", "q", None, None), (302, "d" * 40, "Other", "q", "two", None)]
    c = splits.commit_tasks(spark.createDataFrame(raw, "id long, sha string, message string, path string, diff string, cmt_date string")).collect()
    assert [(r.sha[0], r.title, r.diff, r.files) for r in c] == [("d", "A subject long enough", "one\n\ntwo", 2)]


def test_search_and_fusion(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("w", [1.0])], "path string, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.1])], "query_id int, v array<double>")
    got = search.top_k(q, items, 3).orderBy("rank").collect()
    assert [r.path for r in got] == ["a", "c", "b"]
    assert [r.path for r in search.search_one(items, [2.0, 0.1], 3).collect()] == ["a", "c", "b"]
    assert [r.path for r in search.top_k(q, items, 2, "manhattan").orderBy("rank").collect()] == ["a", "c"]
    a = spark.createDataFrame([(1, "x", 0.5, 1)], "query_id int, path string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 0.4, 1), (1, "x", 0.3, 2)], "query_id int, path string, score double, rank int")
    f = {r.path: (round(r.score, 6), r.source) for r in search.weighted_fusion(a, b, 0.5).collect()}
    assert f == {"x": (0.4, "both"), "y": (0.2, "historical")}
    cand = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.89, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0])], "query_id int, path string, score double, v array<double>")
    assert [r.path for r in search.mmr(cand, 2, 0.5).orderBy("rank").collect()] == ["a", "c"]
    assert search.top_k(q, items.limit(0), 3).collect() == []


def test_each_item_as_query(spark, monkeypatch):
    # the blocks' results without their exchanges: ties, equal vectors, other lengths, fewer items than k
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in rng.integers(-2, 3, (300, 3)).astype(float) if x.any()]
    v += [[1.0, 2.0, 3.0]] * 60 + [[0.5, 1.0, 1.5]] * 3 + [[1.0, 0.0], [0.9, 0.1], [0.0, 0.0, 0.0]]
    items = spark.createDataFrame([(f"é{i % 7}{i}", x) for i, x in enumerate(v)], "path string, v array<double>")
    want = search.top_k(items.withColumnRenamed("path", "query_id"), items, 6)
    got = search.each_top_k(items, 6)
    assert rows(got.select("query_id", "path", "score", "rank")) == rows(want.select("query_id", "path", "score", "rank"))
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    assert search.each_top_k(items.limit(0), 6).collect() == []
    b, near = search._Best(rng.standard_normal((700, 8)), 5), rng.standard_normal((2500, 8))
    monkeypatch.setattr(search, "TILE", 100)
    for z in range(0, 2500, 400):
        b.see(near[z : z + 400], np.arange(z, min(2500, z + 400)), np.arange(z, min(2500, z + 400)).astype(object))
    s = np.round(b.q @ near.T / np.outer(np.linalg.norm(b.q, axis=1), np.linalg.norm(near, axis=1)), 12)
    assert (b.item == np.argsort(-s, 1, kind="stable")[:, :5]).all() and (b.name == b.item).all()


def test_matching(spark):
    assert matching.indel_ratio("abcd", "abxd") == 75.0 and matching.token_sort_ratio("b a", "a b") == 100
    m = ["race condition in cache writer", "unrelated words entirely different", "short"]
    t = [(1, "cache writer race condition"), (2, "writer of caches"), (3, None)]
    got = matching.best_titles(spark.createDataFrame([(x,) for x in m], "message string"), spark.createDataFrame(t, "title_id long, title string")).collect()
    assert [(r.message, r.title_id) for r in got] == [(m[0], 1)]
    rng = random.Random(2)
    words = ["cache", "writer", "reader", "fails", "index", "slow", "start", "broken", "link"]
    M = list({" ".join(rng.choices(words, k=4)) for _ in range(40)})
    T = [(i, " ".join(rng.choices(words, k=4))) for i in range(60)]
    for method, f in (("token_sort", matching.token_sort_ratio), ("sequence", matching.sequence_ratio)):
        got = {r.message: (r.title_id, r.score) for r in matching.best_titles(spark.createDataFrame([(x,) for x in M], "message string"), spark.createDataFrame(T, "title_id long, title string"), method, 70.0).collect()}
        want = {}
        for x in M:
            s, i = max((round(f(x, t), 6), -i) for i, t in T)
            if s >= 70:
                want[x] = (-i, s)
        assert got == want


def _odd_texts(seed, n):
    """Changed copies of texts of one to four words of bits, with characters beyond the counted classes and long runs."""
    rng = random.Random(seed)
    alphabet = "abcde é中\U0001f600" + "".join(chr(0x400 + k) for k in range(60))
    base = ["".join(rng.choice(alphabet[: rng.choice([3, 9, 69])]) for _ in range(k)) for k in (1, 8, 20, 63, 64, 65, 128, 130, 200)]

    def changed(x):
        x = list(x)
        for _ in range(rng.randrange(12)):
            x.insert(rng.randrange(len(x) + 1), rng.choice(alphabet))
            if rng.random() < 0.6:
                del x[rng.randrange(len(x))]
        return "".join(x)

    return [changed(rng.choice(base)) for _ in range(n)]


@pytest.mark.parametrize("threshold", [60.0, 75.0, 100.0])
def test_close_pairs_are_all_found(monkeypatch, threshold):
    monkeypatch.setattr(matching, "TILE", 7)
    monkeypatch.setattr(matching, "STEP", 50)
    a, b = (_odd_texts(1, 130)[k::2] for k in (0, 1))
    a.append(b[0])
    got = [tuple(int(v) for v in p) for p in zip(*matching.close_pairs(a, b, threshold))]
    r = {(i, j): round(matching.indel_ratio(x, y), 6) for i, x in enumerate(a) for j, y in enumerate(b)}
    want = {(i, j, round(v * (len(a[i]) + len(b[j])) / 200)) for (i, j), v in r.items() if v >= threshold}
    assert set(got) == want and len(got) == len(want) and want
    assert [len(x) for x in matching.close_pairs([], b, threshold)] == [0, 0, 0]


def test_sequences_are_scored_only_if_they_can_reach_the_threshold(monkeypatch):
    calls, ratio = [], matching.sequence_ratio
    monkeypatch.setattr(matching, "sequence_ratio", lambda a, b: calls.append((a, b)) or ratio(a, b))
    own = ["merge branch cache into main", "abcdefghijklmnop"]
    # the same characters in another order have full counts in common, but no long subsequence
    keys = ["".join(reversed(x)) for x in own] * 30 + ["merge branch caches into main", "merge branch cache into main"]
    got = list(matching._best(own, keys, "sequence", 80.0))
    assert got == [(0, 61, 100.0)] and len(calls) == 1
    for seed in range(3):
        a, b = (_odd_texts(seed, 80)[k::2] for k in (0, 1))
        want = {}
        for i, x in enumerate(a):
            r, j = max((round(ratio(x, y), 6), -j) for j, y in enumerate(b))
            if r >= 60:
                want[i] = (-j, r)
        assert {i: (j, r) for i, j, r in matching._best(a, b, "sequence", 60.0)} == want and want


def test_extensions(spark):
    p = spark.createDataFrame([("f", 10), ("f", 100)], "file string, line long")
    a = spark.createDataFrame([("f", 30), ("f", 31), ("f", 81), ("g", 10)], "file string, line long")
    assert rows(extensions.line_accuracy(p, a)) == [("f", 30, True), ("f", 31, False), ("f", 81, True), ("g", 10, False)]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "l int, r int")
    assert rows(extensions.reach(e, spark.createDataFrame([(1,)], "node int"), 2)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]
    t = spark.createDataFrame([("c", 1, ["a", "a", "b"]), ("c", 2, ["b", "z"])], "c string, t int, ts array<string>")
    r = extensions.turn_report(t, "c", "t", "ts").orderBy("t").collect()
    assert [x.gain for x in r] == [2, 1] and r[1].used == 5 and abs(r[0].entropy - 0.9182958) < 1e-6


def test_sinks_and_readers(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, title string")
    new = spark.createDataFrame([(3, "b", "p"), (4, "b", "q")], "id int, name string, title string")
    assert rows(sinks.upsert(old, new, "name", "id")) == [(1, "a", "x"), (4, "b", "q")]
    j = [('{"number": 7, "title": "T", "body": null, "comments_list": [{"body": "a"}, {"body": "b"}]}',), ('{"number": 8, "pull_request": "u", "title": "P"}',)]
    assert rows(readers.issues(spark.createDataFrame(j, "json string"), "github")) == [("#7", "T", "", "a b")]
    g = [('{"iid": 1, "title": "T", "description": "d", "notes": [{"body": "x", "system": true}, {"body": "y", "system": false}]}',)]
    assert rows(readers.gitlab_issues(spark.createDataFrame(g, "json string"))) == [("#1", "T", "d", "y")]
    m = [('{"iid": 5, "state": "merged", "closes": [{"iid": 1}, {"iid": 2}], "commits": ["c"], "files": ["f"]}',), ('{"iid": 6, "state": "opened", "closes": [{"iid": 1}]}',)]
    assert [(r.issue, r.mr) for r in readers.gitlab_merge_links(spark.createDataFrame(m, "json string")).orderBy("issue").collect()] == [(1, 5), (2, 5)]
    jira = [('{"key": "A-1", "fields": {"summary": "s", "description": "d", "comment": {"comments": [{"body": "c"}]}}}',)]
    assert rows(readers.jira_issues(spark.createDataFrame(jira, "json string"))) == [("A-1", "s", "d", '["c"]')]
    y = [('{"idReadable": "Y-1", "summary": "<b>s</b>", "description": "d", "comments": [{"text": "c"}]}',)]
    assert rows(readers.youtrack_issues(spark.createDataFrame(y, "json string"))) == [("Y-1", "s", "d", "c")]
    h = [("A-1", '<h1 id="summary-val">T</h1><div id="description-val"><p>D</p></div><div class="x action-body">c1</div>')]
    assert rows(readers.jira_html(spark.createDataFrame(h, "name string, html string"))) == [("A-1", "T", "D", "c1")]
    (tmp_path / "cp.json").write_text('{"completed_etl": ["a", "b"],\n "failed_etl": []}')
    r = readers.checkpoint_counts(spark, str(tmp_path / "cp.json")).first()
    assert (r.completed_etl, r.failed_etl, r.completed_experiments) == (2, 0, 0)
    done = spark.createDataFrame([("x", "1")], "a string, b string")
    assert rows(sinks.missing_variants({"a": ["x", "y"], "b": ["1"]}, done)) == [("y", "1")]
    v = spark.createDataFrame([(1, "p", "file", [1.0])], "id int, path string, type string, vector array<double>")
    sinks.create_collection(v, "weft_test_c")
    sinks.create_collection(v, "weft_test_c")
    assert spark.table("weft_test_c").count() == 1 and readers.commit_table(spark) is None
    assert sinks.drop_collections(spark, "weft_test%") == ["weft_test_c"]
    log = spark.createDataFrame([("time_001", "3.5"), ("name_001", "x"), ("odd", "1")], "key string, value string")
    assert [(r.name, r.run, r.number) for r in readers.run_log(log).orderBy("name").collect()] == [("name", 1, None), ("time", 1, 3.5)]


def test_analysis(spark):
    d = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("q", "a", 3.0), ("q", "b", 1.0)], "project string, model string, v double")
    assert rows(analysis.wins(d, "project", ["model"], "v").select("model", "wins")) == [("a", 1), ("b", 1)]
    r = analysis.paired(d, ["project"], "model", "a", "b", "v").first()
    assert (r.pairs, r.mean_diff, r.win_share) == (2, -0.5, 0.5)


def test_rotation_of_whole_vectors(spark, tmp_path):
    import numpy as np

    import __spark_entry__ as entry

    rng = np.random.default_rng(4)
    v = {f"T-{i}": rng.standard_normal(64).astype(np.float32) for i in range(90)}
    inc = {(t, f"m{k}") for t in v for k in rng.choice(8, 3)}
    raw = [(i, t, f"{m}/f") for i, (t, m) in enumerate(sorted(inc))]
    spark.createDataFrame([(i, "s", None, None, p, None, t) for i, t, p in raw], "id long, sha string, cmt_date string, message string, path string, diff string, task_name string").write.parquet(f"{tmp_path}/rawdata.parquet")
    spark.createDataFrame([(i, t, "task", x.tolist()) for i, (t, x) in enumerate(v.items())], "id long, path string, type string, vector array<float>").write.parquet(f"{tmp_path}/vec_collection.parquet")
    got = {r.row: r.v for r in entry.queries()["X35_procrustes"](spark, str(tmp_path)).collect()}
    w = np.array([got[i] for i in range(64)])
    assert w.shape == (64, 64) and np.allclose(w @ w.T, np.eye(64), atol=1e-8)
    mean = {m: np.mean([v[t].astype(float) for t, n in inc if n == m], axis=0) for m in {m for _, m in inc}}
    # with few centroids the rotation isn't unique, its trace against the outer products is: their nuclear norm
    cross = sum(np.outer(v[t].astype(float), mean[m]) for t, m in inc)
    assert abs(np.trace(w.T @ cross) - np.linalg.svd(cross, compute_uv=False).sum()) < 1e-6
