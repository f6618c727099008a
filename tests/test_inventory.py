"""Vector stores, landed repositories and pages, agents and measures."""

import subprocess

import pytest
from pyspark.sql import functions as F

from weftline.operators import agent, embed, extensions
from weftline.operators.index import open_index
from weftline.sources import git, readers


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("store", ["table", "files"])
def test_vector_index(spark, tmp_path, store):
    ix = open_index(spark, store, "weft_ix_test" if store == "table" else f"{tmp_path}/ix")
    v = spark.createDataFrame([(1, "a", "file", [1.0, 0.0]), (2, "b", "file", [0.0, 1.0]), (3, "c", "module", [1.0, 0.1]), (4, "n", "file", None)], "id long, path string, type string, vector array<double>")
    for _ in range(2):  # anew, so the second time changes nothing
        ix.create(v.where("id < 3"))
    ix.insert(v.withColumn("path", F.concat("path", F.lit("!"))))
    assert rows(ix.rows().select("id", "path")) == [(1, "a"), (2, "b"), (3, "c!"), (4, "n!")]
    ix.upsert(v.where("id = 2").withColumn("path", F.lit("z")))
    assert rows(ix.rows().select("id", "path")) == [(1, "a"), (2, "z"), (3, "c!"), (4, "n!")]
    q = spark.createDataFrame([(7, [1.0, 0.2])], "query_id int, v array<double>")
    assert [r.path for r in ix.search(q, 5).orderBy("rank").collect()] == ["c!", "a", "z"]
    assert [r.path for r in ix.search(q, 5, where=F.col("type") == "file").orderBy("rank").collect()] == ["a", "z"]
    assert {r.type: r.n for r in ix.info().collect()} == {"file": 3, "module": 1}
    ix.drop()
    with pytest.raises(ValueError):
        open_index(spark, "other", "x")


def test_git_commits(spark, tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=Zoë", "-c", "user.email=z@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (at / "a.txt").write_text("one\n")
    (at / "ü b.txt").write_text("two\n")
    run("add", "-A")
    run("commit", "-qm", "first\n\nbody")
    (at / "a.txt").unlink()
    (at / "c.txt").write_text("diff --git is not here\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    got = git.git_commits(spark.createDataFrame([(str(at),)], "repo string"), rows=1).collect()
    assert sorted((r.message, r.path) for r in got) == [("first\n\nbody", "a.txt"), ("first\n\nbody", "ü b.txt"), ("second", "a.txt"), ("second", "c.txt")]
    d = {(r.message[:5], r.path): r for r in got}
    assert "-one" in d["first", "a.txt"]["diff"] and "+one" in d["secon", "a.txt"]["diff"] and d["first", "a.txt"].author_name == "Zoë" and len(d["first", "a.txt"].sha) == 40
    assert git.capped(spark.range(5), 4).count() == 0 and git.capped(spark.range(5), 5).count() == 5


def test_bulk_pages(spark):
    p = ['[{"number": 1, "title": "a", "body": null}, {"number": 2, "pull_request": "u", "title": "p"}]', '[{"number": 1, "title": "a", "body": null}]', "[]", "nothing", None]
    got = readers.bulk_issues(spark.createDataFrame([(x,) for x in p], "page string"), "github")
    assert rows(got.select("name", "title", "comments")) == [("#1", "a", "")]
    j = ['{"issues": [{"key": "A-1", "fields": {"summary": "s", "description": "d"}}]}']
    assert [r.name for r in readers.bulk_issues(spark.createDataFrame([(x,) for x in j], "page string"), "jira").collect()] == ["A-1"]


def test_agents(spark):
    p = spark.createDataFrame([(1, "1. **a.c** (similarity: 0.9)\n2. **b.c** (similarity: 0.8)"), (2, None)], "query_id int, prompt string")
    s = agent.select_files(agent.simple_agent(p, agent.Echo()))
    assert {r.query_id: r.files for r in s.collect()} == {1: ["a.c", "b.c"], 2: None}
    text = spark.createDataFrame([("a.c", "x" * 6000)], "path string, text string")
    assert rows(agent.read_files(s, text)) == [(1, "a.c", "x" * 5000), (1, "b.c", None)]
    m = {r.query_id: r for r in agent.multi_agent(p, lambda x: "ANALYSED", lambda x: x[-8:]).collect()}
    assert m[1].analysis == "ANALYSED" and m[1].answer == "ANALYSED"


def test_expansion_is_refused_where_it_leads_away(spark):
    q = spark.createDataFrame([(1, "cache writer fails now"), (2, None), (3, "lonely")], "query_id int, text string")
    ranked = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (2, "p", 1), (1, "far", 9)], "query_id int, path string, rank int")
    terms = spark.createDataFrame([("p", "cache"), ("p", "reader"), ("q", "reader"), ("q", "alpha"), ("p", "beta"), ("far", "zeta")], "path string, term string")
    x = {r.query_id: r.expanded for r in extensions.expand_queries(q, ranked, terms, 5, 2).collect()}
    assert x == {1: "cache writer fails now reader alpha", 2: " beta cache", 3: "lonely"}
    y = {r.query_id: r for r in extensions.accept_expansion(extensions.expand_queries(q, ranked, terms, 5, 2), embed.embed).collect()}
    assert y[1].cos > 0.6 and y[1].used == x[1] and y[2].used == "" and y[3].used == "lonely"
    assert extensions.accept_expansion(extensions.expand_queries(q, ranked, terms, 5, 2), embed.embed, 0.99).where("query_id = 1").first().used == "cache writer fails now"


def test_measures(spark):
    k = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, term string")
    links = spark.createDataFrame([("a", "x", 3), ("b", "x", 2)], "l string, r string, cnt long")
    assert rows(extensions.memoization(k, links)) == [(1, 0.5), (2, 0.0)]
    f = lambda *p: spark.createDataFrame(list(p), "query_id int, file string")
    assert rows(extensions.noise_reduction(f((1, "a"), (1, "b"), (1, "c"), (2, "a")), f((1, "a"), (2, "a")), f((1, "b")))) == [(1, 2, 0.5)]
    d = spark.createDataFrame([("p", 0.0), ("q", 5.0), ("z", 10.0)], "path string, at double")
    r = spark.createDataFrame([(1, "p"), (1, "q")], "query_id int, path string")
    assert rows(extensions.time_spread(r, d)) == [(1, 0.5, 0.25)]
    assert rows(extensions.diversity(r, spark.createDataFrame([("p", "m"), ("q", "m"), ("q", "n")], "path string, module string"))) == [(1, 2 / 3)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    assert all(abs(r.specificity - (1 - 0.5**0.5)) < 1e-12 for r in extensions.specificity(v, "id", "v", 2).collect())
    n = extensions.novelty_structure(spark.createDataFrame([(1, "a/x"), (1, "a/y"), (1, "b/z"), (1, "a/w")], "query_id int, path string"), spark.createDataFrame([(1, "a/x")], "query_id int, path string"), F.substring_index("path", "/", 1)).first()
    assert (n.novelty, n.structure) == (0.75, 0.75) and abs(n.hes - 0.75) < 1e-12
