import math

from pyspark.sql import functions as F

from weftline.functions import names as N
from weftline.functions import text as X
from weftline.functions import vectors as V


def one(spark, col, **values):
    types = {str: "string", list: "array<double>", float: "double", int: "long", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(col.alias("r")).first().r


def test_paths(spark):
    cases = [("src/a/B.java", "src"), ("x.js", "root"), ("", "root"), ("/a/b", ""), ("a\\b", "a"), (None, "root")]
    for p, want in cases:
        assert one(spark, X.module_path(F.col("p")), p=p) == want
    for p, want in [("server/a.java", "server"), ("pom.xml", ""), (".github/x", "")]:
        assert one(spark, X.root_module(F.col("p")), p=p) == want
    assert one(spark, X.path_prefixes(F.col("p")), p="/a//b/c") == ["a", "a/b", "a/b/c"]
    assert one(spark, X.path_prefixes(F.col("p")), p="/") == []
    assert one(spark, X.file_path(F.col("p")), p="") == "unknown"
    for p, want in [(" a//./b\\c ", "a/b/c"), ("x/../y", "y"), ("../y", "y"), ("", None), (" / ", None), (None, None), ("Core/./X.java", "Core/X.java"), (".git/x", ".git/x")]:
        assert one(spark, N.path_text(F.col("p")), p=p) == want


def test_task_key(spark):
    cases = {
        "BRIX-000118": "BRIX-118", "brix1141": "BRIX-1141", "BRIX #110": "BRIX-110", "(brix-10)": "BRIX-10", "BRIX–1122": "BRIX-1122", "Brix_7": "BRIX-7", "[BRIX-100]": "BRIX-100",
        "https://tracker.example/browse/BRIX-1008": "BRIX-1008", "BRIX-1083 (done)": "BRIX-1083", "BRIX-1125:": "BRIX-1125", " BRIX 9\n": "BRIX-9", "n/a": None, "": None, None: None, "17": None, "BRIX-0": "BRIX-0",
    }
    for k, want in cases.items():
        assert one(spark, N.task_key(F.col("p")), p=k) == want, k


def test_commits_resolve_like_git(spark):
    a, b = "abcd" + "0" * 35 + "1", "abcd" + "0" * 35 + "2"
    rows = [(1, a), (2, a.upper()), (3, f" {b}\n"), (4, "abcd"), (5, "ABCD" + "0" * 10), (6, "0" * 40), (7, None), (8, "unknown"), (9, "ffff11"), (10, "ee" + "1" * 38), (11, "ee11"), (12, "ee1"), (13, "")]
    got = {r.id: r.commit for r in N.resolve_commits(spark.createDataFrame(rows, "id int, sha string")).collect()}
    c = "ee" + "1" * 38
    assert got == {1: a, 2: a, 3: b, 4: None, 5: None, 6: None, 7: None, 8: None, 9: None, 10: c, 11: c, 12: None, 13: None}


def test_commit_dates(spark):
    ok = {"2015-08-13T19:18:36+05:30": "2015-08-13 13:48:36", "2016-06-27 18:48:17 +0200": "2016-06-27 16:48:17", "2019-06-22T06:01:10.000+0000": "2019-06-22 06:01:10", "30/10/2016 15:30": "2016-10-30 15:30:00", "2018-03-13T17:14:18Z": "2018-03-13 17:14:18", "2024-06-24 08:20:18": "2024-06-24 08:20:18"}
    for k, want in ok.items():
        assert str(one(spark, N.commit_time(F.col("p")).cast("string"), p=k)) == want
    for k in (None, "", "n/a", "0000-00-00 00:00:00", "1970-01-01T00:00:00Z", "2015-13-01 00:00:00"):
        assert one(spark, N.commit_time(F.col("p")), p=k) is None


def test_texts(spark):
    assert one(spark, X.combine_fields(F.col("a"), F.col("b")), a=" A ", b=None) == "A"
    assert one(spark, X.combine_fields(F.col("a"), F.col("b")), a=None, b=None) == "empty_task"
    assert one(spark, X.extract_task_name(F.col("a")), a="[ABC-12] Fix") == "ABC-12"
    assert one(spark, X.extract_task_name(F.col("a"), "generic"), a="this fixes: #42 now") == "42"
    assert one(spark, X.extract_task_name(F.col("a"), "simple"), a="no key") is None
    assert one(spark, X.normalize_commit(F.col("a")), a="Fix [core] NPE in Façade!\nmore") == "core npe in façade"
    assert one(spark, X.upper_split(F.col("a")), a="a-b!") == ["A", "B", ""]
    assert one(spark, X.short_name(F.col("a")), a="x" * 60)[:44] == "x" * 43 + "_"
    assert one(spark, X.preview(F.col("a"), 3), a="abcd") == "abc..."
    assert one(spark, X.json_list(F.col("a")), a='so {"selected_files": ["a", "b"]} ok') == ["a", "b"]
    assert one(spark, X.json_list(F.col("a")), a="none") is None
    assert one(spark, X.numbered_names(F.col("a")), a="1. **A-1** x\n2. **A-2**") == ["A-1", "A-2"]
    assert one(spark, X.numbered_names(F.col("a")), a="1. `p/q` x") == ["p/q"]
    assert one(spark, X.confidence(F.col("a")), a="Confidence: 80%") == 80
    assert one(spark, X.confidence(F.col("a")), a="?") == 50
    assert one(spark, X.list_section(F.col("a"), "Missing"), a="x\nMissing info:\n- one\n• two\nend\n- no") == ["one", "two"]
    assert one(spark, X.list_section(F.col("a"), "Missing"), a="x") == ["(None specified)"]
    assert one(spark, X.html_clean(F.col("a")), a="<p>a &amp;&nbsp;b</p>  c") == "a & b c"
    assert one(spark, X.common_prefix_length(F.split("a", "/"), F.split("b", "/")), a="a/b/c", b="a/b/d") == 2
    assert "the" not in one(spark, X.tfidf_tokens(F.col("a")), a="The quick_fox 12")


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert math.isclose(one(spark, V.euclidean(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[3.0, 4.0]), 5)
    assert one(spark, V.resize(F.col("a"), 3), a=[1.0]) == [1, 0, 0]
    assert one(spark, V.normalize(F.col("a")), a=[0.0, 0.0]) == [0, 0]
    assert one(spark, V.quantize(F.col("a")), a=[3.0, 4.0]) == [76, 102]
    assert one(spark, V.usable(F.col("a")), a=[float("nan"), 1.0]) is False
