"""Queries over texts of all scripts against Python's regular expressions."""

import re
from collections import Counter

import __spark_entry__ as entry
from weftline.functions.text import BRACKETS, IDENTIFIER, NOISE, STOP_WORDS

TEXTS = [None, "", "Fix [ядро] Ошибка!\nmore", "修复 登录, テスト42", "Façade e\u0301te\u0301 update_x", "añadió fixесть fix", "🚀 added (naïve) wip-тест", "plain ascii fix", "한국어 버그"]


def test_commit_messages_of_all_scripts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, message string").write.parquet(f"{tmp_path}/rawdata.parquet")

    def want(x):
        t = re.sub(NOISE, " ", re.sub(BRACKETS, " ", (x or "").split("\n")[0].lower()))
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t)).strip()

    got = {r.id: r.text for r in entry.queries()["F03_normalize_commit_all"](spark, str(tmp_path)).collect()}
    assert got == {i: want(x) for i, x in enumerate(TEXTS)}


def test_tokens_of_all_scripts(spark, tmp_path):
    spark.createDataFrame([(i, f"A-{i}", "Слово straße", x, "中文") for i, x in enumerate(TEXTS * 12)], "id long, name string, title string, description string, comments string").write.parquet(f"{tmp_path}/task.parquet")
    ts = {i: re.split(r"\W+", f"Слово straße {x or ''} 中文".upper()) for i, x in enumerate(TEXTS * 12)}
    n, df = Counter(t for x in ts.values() for t in x), Counter(t for x in ts.values() for t in set(x))
    get = lambda q: sorted(map(tuple, entry.queries()[q](spark, str(tmp_path)).collect()), key=repr)
    by = lambda x: sorted(x, key=repr)
    assert get("A01_token_dictionary_all") == by((t,) for t in n)
    assert get("A02_token_bigrams_all") == by((*k, c) for k, c in Counter(p for x in ts.values() for p in zip([None, *x], x)).items())
    assert get("A03_frequent_tokens_all") == by((t, c) for t, c in n.items() if c > 100) != []
    assert get("A08_token_document_frequency_all") == by(df.items())
    assert get("A09_tokens_of_task_all") == by((i, ",".join(sorted(x))) for i, x in ts.items())
    words = lambda x: [w for w in re.sub(r"[^\w\s]|\d|_", " ", (x or "").lower()).split() if len(w) > 1 and w not in STOP_WORDS]
    assert get("F07_tfidf_tokens_all") == by((i, words(x)) for i, x in enumerate(TEXTS * 12))


def test_identifiers_of_all_scripts(spark, tmp_path):
    texts = [*TEXTS, "İstanbul e\u0301té sum∑sum a#b_c 2x x2 #tag _x éclair x", "a1#. b# #c 9", "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in entry.queries()["F10_identifier_tokens_all"](spark, str(tmp_path)).collect()}
    assert got == {i: [w for w in re.findall(IDENTIFIER, (x or "").lower()) if len(w) >= 2] for i, x in enumerate(texts)}
