"""Small fixtures against brute force, with nulls, empty texts, ties, repeated rows, empty tables and odd extra columns."""

import itertools
import random
from fractions import Fraction
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, neighbours, overlap, packing, pairs, splits, terms

RAW = "id long, sha string, author_name string, cmt_date string, created_at timestamp, path string, task_name string, `rank` int, node string"


def raw_table(spark, rows):
    return spark.createDataFrame([(i, sha, None, date, None, path, task, 1, "x") for i, sha, date, path, task in rows], RAW)


def random_raw(rng, n):
    shas = [f"{k:040x}" for k in range(1, n // 3 + 2)]
    out = []
    for i in range(n):
        sha = rng.choice([None, "", "unknown", "0" * 40, rng.choice(shas), rng.choice(shas), rng.choice(shas), rng.choice(shas)[:39]])
        task = rng.choice([None, "", "HOT-1", "hot 1", f"A-{rng.randrange(n)}", f"a{rng.randrange(n)}", f"B-00{rng.randrange(n)}"])
        out.append((i, sha, rng.choice([None, "n/a", "2020-01-0%dT00:00:00Z" % rng.randrange(1, 9)]), rng.choice([None, "", "a/b", "./a/b", "c\\d", f"p/{rng.randrange(9)}"]), task))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_splits_keep_groups_together(spark, seed):
    rng = random.Random(seed)
    raw = raw_table(spark, random_raw(rng, 160))
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.3)], "split string, share double")
    a = splits.split_records(raw, plan).collect()
    assert sorted(r.id for r in a) == list(range(160)) and all(r.split for r in a)
    for key in ("task_key", "commit"):
        of = defaultdict(set)
        for r in a:
            if r[key]:
                of[r[key]].add((r.split, r.group_key))
        assert all(len(x) == 1 for x in of.values())
    # tied tasks by search over the bipartite graph
    com, tas = defaultdict(set), defaultdict(set)
    for r in a:
        if r.task_key and r.commit:
            com[r.commit].add(r.task_key)
            tas[r.task_key].add(r.commit)
    want = set()
    for t in tas:
        seen, todo = {t}, [t]
        while todo:
            for c in tas[todo.pop()]:
                todo += [x for x in com[c] if x not in seen]
                seen |= com[c]
        if len(seen) > 1:
            want.add((t, min(seen)))
    assert {tuple(r) for r in splits.tied_tasks(splits.split_records(raw, plan)).collect()} == want


def test_split_quotas():
    b = [(1, "R", 1000), (2, "T", 300), (3, "T", 100), (50, "T", 2), (400, "T", 1)]
    total = sum(s * n for s, _, n in b)
    plan = [("train", 0.8), ("test", 0.1), ("validation", 0.1)]
    got = splits.plan_bundles(b, plan)
    assert all(sum(got[s, lab]) == n for s, lab, n in b)
    rows = [sum(s * got[s, lab][k] for s, lab, _ in b) for k in range(3)]
    assert all(abs(r - total * w) <= 1 for r, (_, w) in zip(rows, plan)), rows
    # one group holds nine tenths: it goes to the largest split, and the others share what is left
    got = splits.plan_bundles([(900, "T", 1), (1, "R", 100)], plan)
    assert got[900, "T"] == [1, 0, 0] and got[1, "R"] == [0, 50, 50]
    assert splits.plan_bundles([], plan) == {} and splits.plan_bundles([(1, "R", 2)], []) == {(1, "R"): []}


@pytest.mark.parametrize("seed", range(20))
def test_flow_of_one_size_is_the_least_cost(seed):
    # against every way to deal the components of one size
    rng = random.Random(seed)
    size, labels = rng.randrange(1, 5), ["T:1", "C:1"]
    bundles = [(size, lab, rng.randrange(1, 7)) for lab in labels]
    plan = [("a", 0.6), ("b", 0.3), ("c", 0.1)]
    total = sum(s * n for s, _, n in bundles)
    share = [Fraction(w).limit_denominator(10**6) for _, w in plan]
    quota, lab_quota = splits._apportion(total, share), {lab: splits._apportion(s * n, share) for s, lab, n in bundles}

    def cost(deal):
        rows = [size * sum(d[k] for d in deal) for k in range(3)]
        over = sum(max(0, r - q) for r, q in zip(rows, quota)) * splits.OVER_TOTAL
        return over + sum(max(0, size * d[k] - lab_quota[lab][k]) for d, (_, lab, _) in zip(deal, bundles) for k in range(3)) * splits.OVER_LABEL

    ways = [[(a, b, n - a - b) for a in range(n + 1) for b in range(n + 1 - a)] for _, _, n in bundles]
    got = splits.plan_bundles(bundles, plan)
    mine = [got[s, lab] for s, lab, _ in bundles]
    assert all(sum(d) == n for d, (_, _, n) in zip(mine, bundles))
    assert cost(mine) // splits.OVER_LABEL == min(map(cost, itertools.product(*ways))) // splits.OVER_LABEL


def test_large_components_stay_in_the_flow():
    rng = random.Random(3)
    b = Counter((int(1 / rng.random() ** 0.9), rng.choice("TCR") + f":{rng.randrange(6)}") for _ in range(30_000))
    bundles = [(s, lab, n) for (s, lab), n in b.items()] + [(20_000, "T:1", 1), (9_000, "T:2", 1), (9_000, "C:2", 1)]
    plan = [("train", 0.8), ("test", 0.1), ("validation", 0.1)]
    total = sum(s * n for s, _, n in bundles)
    got = splits.plan_bundles(bundles, plan)
    assert all(sum(got[s, lab]) == n for s, lab, n in bundles)
    for k, (_, w) in enumerate(plan):
        assert abs(sum(s * got[s, lab][k] for s, lab, _ in bundles) - w * total) <= 1
    for lab in {lab for _, lab, _ in bundles} - {"T:1", "T:2", "C:2"}:  # labels without a component beyond their quotas are spread like all rows
        rows = [sum(s * got[s, x][k] for s, x, _ in bundles if x == lab) for k in range(3)]
        assert all(abs(r - w * sum(rows)) <= 0.02 * sum(rows) + 1 for r, (_, w) in zip(rows, plan)), (lab, rows)


def test_splits_of_nothing(spark):
    plan = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert splits.split_records(raw_table(spark, []), plan).collect() == []
    assert splits.tied_tasks(splits.split_records(raw_table(spark, []), plan)).collect() == []
    two = splits.split_records(raw_table(spark, [(None, None, None, None, None)] * 2), plan).collect()
    assert [(r.split, r.group_key) for r in two] == [("train", "R:")] * 2
    one = splits.split_records(raw_table(spark, [(1, None, None, None, None)]), plan.limit(0)).collect()
    assert [(r.id, r.split, r.group_key) for r in one] == [(1, None, "R:1")]


def test_terms(spark):
    t = [("A-1", "Fix the fix-it, fix"), ("A-1", "Fix the fix-it, fix"), ("A-2", None), ("A-3", ""), ("A-4", " \u3000İx THE\u00a0end "), (None, "the"), (None, "the"), ("A-5", "--")] + [(f"B-{i}", "the common") for i in range(50)]
    task = spark.createDataFrame([(*x, 1) for x in t], "name string, title string, total int")
    c = Counter()
    d = defaultdict(int)
    titles = {n: v for n, v in t if n}
    texts = list(titles.values()) + ["the", "the"]
    import re

    for v in texts:
        ws = re.sub(r"[^a-zA-Z0-9\s-]", "", v or "").lower().split()
        c.update(ws)
        for w in set(ws):
            d[w] += 1
    got = {r.term: (r.total_count, r.task_cnt, r.n_records) for r in terms.term_counts(terms.one_per_record(task, "name", "title")).collect()}
    n = sum(1 for v in texts if re.sub(r"[^a-zA-Z0-9\s-]", "", v or "").split())
    assert got == {w: (c[w], d[w], n) for w in c}
    assert {tuple(r) for r in terms.marked_terms(task).collect()} == {(w, "rare" if d[w] < 3 else "common") for w in c if d[w] < 3 or d[w] * 20 > n}
    assert terms.marked_terms(task.limit(0)).collect() == []
    st = spark.createDataFrame([("THE", 5, 5), ("gone", None, 1), ("the ", 53, None), (None, 1, 1)], "term string, total_count long, task_cnt long")
    r = {x.term: x for x in terms.term_report(task, st).collect()}
    assert r["the"].n_stored == 2 and r["gone"].total_count == 0 and r["gone"].mark is None and None not in r


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_last_seen_counters(monkeypatch, size):
    import pyarrow as pa

    # records go on from one batch to the next, where only the record last seen tells that it is the same
    monkeypatch.setattr(terms, "FLUSH", 4)
    rng = random.Random(size)
    recs = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6))] for _ in range(60)] + [["a", "b", "a", "a", "b"]] * 3
    rows = [(t, i * 10) for i, r in enumerate(recs) for t in r]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in p]), pa.array([x[1] for x in p], pa.int64())], ["term", "rec"]) for p in (rows[k : k + size] for k in range(0, len(rows), size))]
    total, cnt = Counter(), Counter()
    for b in terms._count(iter(batches)):
        for t, a, r in zip(*(c.to_pylist() for c in b.columns)):
            total[t] += a
            cnt[t] += r
    assert total == Counter(w for r in recs for w in r) and cnt == Counter(w for r in recs for w in set(r))


def test_pairs(spark, monkeypatch):
    rng = random.Random(5)
    inc = [(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), f"p{rng.randrange(30)}") for _ in range(500)] + [(f"hot{h}", f"p{i}") for h in range(6) for i in range(25)] + [("A", None), (None, "p1"), ("A", "p1"), ("A", "p1")]
    df = spark.createDataFrame([(a, b, 1) for a, b in inc], "task string, path string, iid int")
    by = defaultdict(set)
    for a, b in inc:
        if a and b:
            by[a].add(b)
    deg, com = Counter(), Counter()
    for s in by.values():
        deg.update(s)
        com.update(itertools.combinations(sorted(s), 2))
    for chunk in (4096, 2):  # with short lists, counting goes by their pieces
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        c = pairs.count_pairs(df, "path", "task", 5, heavy=8)  # nearly every basket is heavy
        name = {r.iid: r.item for r in c.items.collect()}
        got = {tuple(sorted((name[r.l], name[r.r]))): r.common for r in c.pairs.collect()}
        assert got == {k: v for k, v in com.items() if v >= 5}
    r = pairs.cooccurrence(df, "path", "task", 5).collect()
    assert {(x.l, x.r): (x.common, x.n_l, x.n_r, x.n_baskets) for x in r} == {k: (v, deg[k[0]], deg[k[1]], len(by)) for k, v in com.items() if v >= 5}
    assert all(x.log10_p <= 0 and x.log10_q <= 0 and x.log10_q >= x.log10_p - 1e-9 for x in r)
    assert pairs.cooccurrence(df.limit(0), "path", "task", 5).collect() == []


def test_reports_hold_every_pair(spark, tmp_path):
    from weftline.llm.catalog import llm

    rng = random.Random(6)
    inc = [(f"T-{rng.randrange(1, 12)}", f"d/p{rng.randrange(14)}") for _ in range(60)] + [("T-99", f"d/p{i}") for i in range(14, 140)]
    by, deg, com = defaultdict(set), Counter(), Counter()
    for t, p in inc:
        by[t].add(p)
    for s in by.values():
        deg.update(s)
        com.update(itertools.combinations(sorted(s), 2))
    tree = [(1000, None, "d")] + [(i, 1000, f"p{i}") for i in range(150)]
    met = [tuple(int(p[3:]) for p in k) for k, v in com.items() if v == 1][0]
    links = [(1, *met, 2), (2, *met[::-1], 3), (1, 0, 20, 4), (1, 0, 149, 7), (1, 148, 149, None)]
    title = [(k, f"A-{k}", t) for k, t in enumerate(["red green", "red green blue", "blue black", None, "", "white"])]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(inc, "task_name string, path string", "rawdata")
    put(tree, "id long, parent_id long, name string", "module_tree")
    put(links, "batch_no long, l_file long, r_file long, cnt long", "file_links")
    put(title, "id long, name string, title string", "task")
    put([(1, "Red"), (2, "white"), (3, "green"), (4, "gone")], "term_id long, term string", "term_rank")
    put([(1, 3, 1, 2), (1, 1, 2, 5), (1, 4, 1, 3)], "batch_no long, l_term long, r_term long, cnt long", "term_links")

    name = lambda i: f"d/p{i}"
    want = {k: (v, deg[k[0]], deg[k[1]], None) for k, v in com.items()}
    k = tuple(sorted(map(name, met)))
    want[k] = (*want[k][:3], 5)
    for a, b, n in ((0, 20, 4), (0, 149, 7), (148, 149, 0)):
        k = tuple(sorted((name(a), name(b))))
        want[k] = (0, deg[k[0]], deg[k[1]], n)
    rows = llm.queries["p4_files"](spark, str(tmp_path)).collect()
    listed = {(r.l_path, r.r_path): (r.common, r.n_l, r.n_r, r.stored_cnt) for r in rows}
    assert len(rows) == len(listed)
    # two paths of a heavy task that are not listed meet there only
    groups = defaultdict(dict)
    for r in llm.queries["p4_file_groups"](spark, str(tmp_path)).collect():
        groups[r.task_name][r.path] = r.n
    assert {t: len(g) for t, g in groups.items()} == {"T-99": 126}
    rest = {(a, b): (1, g[a], g[b], None) for g in groups.values() for a, b in itertools.combinations(sorted(g), 2) if (a, b) not in listed}
    assert listed | rest == want and rest
    once = {(r.n_l, r.n_r): r for r in llm.queries["p4_files_once"](spark, str(tmp_path)).collect()}
    assert {k: r.pairs for k, r in once.items()} == Counter(tuple(sorted(v[1:3])) for v in rest.values())
    assert all(abs(r.lift - len(by) / (a * b)) < 1e-9 and r.log10_p <= r.log10_q <= 0 for (a, b), r in once.items())
    for r in rows:
        assert r.n_baskets == len(by) and r.log10_p <= 0 and r.log10_p - 1e-9 <= r.log10_q <= 0
        if r.n_l and r.n_r:
            assert abs(r.lift - r.common * len(by) / (r.n_l * r.n_r)) < 1e-9 and r.expected > 0
        else:
            assert r.lift is None and r.expected == 0 and r.log10_p == 0
    got = {(r.l_term, r.r_term): (r.common, r.n_l, r.n_r, r.stored_cnt) for r in llm.queries["p4_terms"](spark, str(tmp_path)).collect()}
    assert got == {
        ("green", "red"): (2, 2, 2, 2), ("blue", "green"): (1, 2, 2, None), ("blue", "red"): (1, 2, 2, None), ("black", "blue"): (1, 1, 2, None), ("red", "white"): (0, 2, 1, 5), ("gone", "red"): (0, 0, 2, 3),
    }


def test_whole_reports_list_pairs_of_heavy_tasks(spark, tmp_path):
    from weftline.llm.catalog import llm

    inc = [("T-1", "a"), ("T-1", "b"), ("T-2", "a"), ("T-2", "p0")] + [("T-9", f"p{i}") for i in range(110)]
    com = Counter()
    for t in ("T-1", "T-2", "T-9"):
        com.update(itertools.combinations(sorted({p for u, p in inc if u == t}), 2))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(inc, "task_name string, path string", "rawdata")
    put([(i, None, f"p{i}") for i in range(112)], "id long, parent_id long, name string", "module_tree")
    put([(1, 0, 1, 3), (1, 0, 111, 4)], "batch_no long, l_file long, r_file long, cnt long", "file_links")
    put([(1, "A-1", " ".join(f"w{i}" for i in range(105)))], "id long, name string, title string", "task")
    put([(1, "w0"), (2, "w1")], "term_id long, term string", "term_rank")
    put([(1, 2, 1, 5)], "batch_no long, l_term long, r_term long, cnt long", "term_links")
    rows = llm.queries["p4_files_all"](spark, str(tmp_path)).collect()
    got = {(r.l_path, r.r_path): (r.common, r.stored_cnt) for r in rows}
    assert len(rows) == len(got) and got == {k: (v, None) for k, v in com.items()} | {("p0", "p1"): (1, 3), ("p0", "p111"): (0, 4)}
    # the same surprise as the pairs that are not listed have
    once = {(r.n_l, r.n_r): r for r in llm.queries["p4_files_once"](spark, str(tmp_path)).collect()}
    r = next(r for r in rows if (r.l_path, r.r_path) == ("p2", "p3"))
    assert all(abs(r[c] - once[1, 1][c]) < 1e-9 for c in ("lift", "expected", "log10_p", "log10_q"))
    terms_ = llm.queries["p4_terms_all"](spark, str(tmp_path)).collect()
    assert {(r.l_term, r.r_term): r.stored_cnt for r in terms_} == {k: 5 if k == ("w0", "w1") else None for k in itertools.combinations(sorted(f"w{i}" for i in range(105)), 2)}


@pytest.mark.parametrize("heavy", [8, 1000])
def test_surprise_is_over_all_pairs(spark, heavy):
    rng = random.Random(heavy)
    inc = {(f"t{rng.randrange(60)}", f"p{int(25 * rng.random() ** 2)}") for _ in range(260)} | {("hot", f"p{i}") for i in range(22)} | {("warm", f"p{i}") for i in range(9, 24)}
    # two items of degree four that share all four baskets
    inc |= {(f"t{k}", x) for k in (50, 51, 52, 53) for x in ("q1", "q2")}
    by, deg, com = defaultdict(set), Counter(), Counter()
    for t, p in inc:
        by[t].add(p)
    for g in by.values():
        deg.update(g)
        com.update(itertools.combinations(sorted(g), 2))
    s = pairs.study(spark.createDataFrame(list(inc), "task string, path string"), "path", "task", heavy=heavy)
    got, once = {(r.l, r.r): r for r in s.pairs.collect()}, {(r.n_l, r.n_r): r for r in s.once.collect()}
    null = pairs.Null(sorted(Counter(deg.values()).items()), sorted(Counter(map(len, by.values())).items()))
    q = {d: null.probabilities(np.array([d]))[0] for d in set(deg.values())}
    assert all(abs((v * null.n).sum() / d - 1) < 1e-9 for d, v in q.items())
    lp = {k: pairs.upper_tail(q[deg[k[0]]] * q[deg[k[1]]], null.n, com[k]) for k in itertools.combinations(sorted(deg), 2)}
    order = sorted(lp, key=lp.get)
    best, want = 0.0, {}
    for i in reversed(range(len(order))):
        best = min(best, lp[order[i]] + np.log10(len(order) / (i + 1)))
        want[order[i]] = best
    for k, c in com.items():
        r = got.get(k) or once[tuple(sorted((deg[k[0]], deg[k[1]])))]
        assert abs(r.log10_p - lp[k]) < 1e-6 and abs(r.log10_q - want[k]) < 3e-3, k
        assert (c == 1 and any(len(g) > heavy and {*k} <= g for g in by.values())) if k not in got else got[k].common == c
    assert len(got) + sum(r.pairs for r in once.values()) == len(com) and got["q1", "q2"].log10_q < 0 and bool(once) == (heavy == 8)
    # given that pairs meet three times or more
    r = pairs.cooccurrence(spark.createDataFrame(list(inc), "task string, path string"), "path", "task", 3).collect()
    assert {(x.l, x.r) for x in r} == {k for k, c in com.items() if c >= 3}
    for x in r:
        p = q[x.n_l] * q[x.n_r]
        assert abs(x.log10_p - min(0.0, pairs.upper_tail(p, null.n, x.common) - pairs.upper_tail(p, null.n, 3))) < 1e-6 and x.log10_p - 1e-9 <= x.log10_q <= 0


def test_null_of_wide_tables():
    # a million frequencies and sizes make some thousands of classes; items in every basket have probability 1
    k = [(float(i), 3) for i in range(1, 1500)]
    null = pairs.Null(k, [(float(i), 4) for i in range(1, 1400)] + [(4400.0, 5)])
    d = np.array([1, 7, 900, 1499])
    assert np.allclose(null.probabilities(d) @ null.n, d, rtol=1e-9)
    one = pairs.Null([(2.0, 3)], [(3.0, 2)])
    assert np.allclose(one.probabilities(np.array([2, 0])), [[1], [0]], atol=1e-6)


def test_tails_of_many_rows():
    rng = np.random.default_rng(2)
    n = np.append(np.floor(9000 / np.arange(1, 40) ** 2) + 1, [3.0, 1.0, 1.0])
    x, y = rng.random(30) ** 3 * 0.3, np.append(np.arange(1, 40) / 90, [0.7, 0.9, 0.99])
    q = np.minimum(x[:, None] * y, 0.999)
    q[0] = 0
    which, c = np.repeat(np.arange(30), 7), np.tile([0, 1, 2, 3, 8, 30, 400], 30)
    got = pairs.upper_tails(q, n, which, c)
    for w, k, g in zip(which, c, got):
        want = pairs.upper_tail(q[w], n, int(k))
        assert g == want or abs(g - want) < 1e-6


def test_upper_tail():
    rng = np.random.default_rng(1)
    for _ in range(200):
        q, n, pm = rng.random(20) ** 3 * rng.choice([0.02, 0.3, 0.9]), rng.integers(1, 5, 20), np.array([1.0])
        for a, b in zip(q, n):
            for _ in range(b):
                pm = np.convolve(pm, [1 - a, a])
        c = int(rng.integers(0, min(n.sum(), (n * q).sum() + 12) + 1))
        want = pm[c:].sum()
        if want > 1e-280:
            assert abs(pairs.upper_tail(q, n, c) - np.log10(want)) < 1e-6


def test_encoding_is_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, "Hello  world's\r\n\t<|endoftext|>", "a" * 5000, " " * 700, "ab" * 900 + "é" * 300, "中文字符" * 80, "\u200b\ufeff 👩\u200d💻", "x\x00y", "Ünï" * 100, "=" * 1000]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab cé中1\n'sS—") for _ in range(rng.randrange(300))) for _ in range(60)]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)] + [(None, "null id", [1])], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    want = {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    want[None] = t.encode("null id", add_special_tokens=False).ids
    assert got == want
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()} == {k: len(v) for k, v in want.items()}
    assert bpe.encode(df.limit(0)).collect() == []


def naive_bfd(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(b, i) for i, b in enumerate(bins) if b >= s]
        if fit:
            bins[min(fit)[1]] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    items = [(i, rng.choice([None, 0, 1, 1, 2, 3, rng.randrange(1, 3 * capacity)]), 5) for i in range(300)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, container int")
    got = packing.pack(df, "doc_id", "n_tokens", capacity).collect()
    load, pieces = Counter(), defaultdict(list)
    for r in got:
        load[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.piece_no, r.n_tokens))
    assert max(load.values()) <= capacity
    for i, n, _ in items:
        p = [x for _, x in sorted(pieces.get(i, []))]
        assert sum(p) == (n or 0) and all(x == capacity for x in p[:-1])
    assert len(load) == naive_bfd([r.n_tokens for r in got], capacity)
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", capacity).collect() == []
    rep = packing.packing_report(packing.pack(df, "doc_id", "n_tokens", capacity), capacity).first()
    assert rep.containers == len(load) and rep.fullest <= capacity


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
        p = q
    return p[-1]


@pytest.mark.parametrize("seed", range(8))
def test_index_finds_all(seed):
    rng = random.Random(seed)
    v = rng.choice([5, 20, 200])
    base = [[rng.randrange(v) for _ in range(rng.randrange(1, 60))] for _ in range(30)]

    def change(x):
        x = list(x)
        for _ in range(rng.randrange(0, max(2, len(x) // 6))):
            r, i = rng.random(), rng.randrange(len(x) + 1)
            if r < 0.4 and i < len(x):
                x[i] = rng.randrange(v)
            elif r < 0.7:
                x.insert(i, rng.randrange(v + 3))
            elif len(x) > 1 and i < len(x):
                del x[i]
        return x

    left, right = [change(rng.choice(base)) for _ in range(90)], [change(rng.choice(base)) for _ in range(60)]
    ix = overlap.Index.load(overlap.Index.build([np.array(x, np.int64) for x in right]))
    want = {(i, j, c) for i, a in enumerate(left) for j, b in enumerate(right) if (c := lcs(a, b)) * 10 >= 9 * max(len(a), len(b))}
    assert set(overlap.search(ix, [np.array(x, np.int64) for x in left])) == want


def test_words():
    assert overlap.words("<p>Don’t&nbsp;**stop** {code}A_b{code}</p>") == overlap.words("don't stop a b")
    assert overlap.words("E\u0301te\u0301 ＦＵＬＬ") == overlap.words("Été full")
    assert overlap.words("中文 字") == ["中", "文", "字"] and overlap.words(" \n!") == [] and overlap.words("") == []
    assert overlap.words("copied from") == ["copied", "from"]


def test_overlaps(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, base, None), (2, base.upper(), ""), (2, base.upper(), ""), (3, None, base.replace(" ten ", " x ").replace(" six ", " y ")), (4, base.replace(" ten ", " x ").replace(" six ", " y ").replace("two", "z"), ""), (5, None, None), (6, "", " "), (7, "!!", None), (8, base, "different words altogether and more of them to be far away from the others here now"), (9, base, None), (None, base, None)]
    task = spark.createDataFrame([(i, t, d, "c", "x") for i, t, d in rows], "id long, title string, description string, comments string, cls string")
    s = spark.createDataFrame([(1, "train", "a"), (2, "test", None), (3, "validation", "b"), (4, "test", "b"), (5, "train", "a"), (6, "test", "a"), (7, "train", "a"), (8, "test", "a"), (9, None, "a"), (77, "train", "a"), (None, "test", "a")], "task_id long, split string, source string")
    p = overlap.split_overlaps(task, s)
    assert sorted((r.train_id, r.eval_id, r.common) for r in p.collect()) == [(1, 2, 20), (1, 3, 18)]
    rep = {(r.split, r.source): (r.tickets, r.overlapping, r.pairs) for r in overlap.overlap_report(p, s).collect()}
    assert rep["test", None] == (1, 1, 1) and rep["validation", "b"] == (1, 1, 1) and rep["test", "b"] == (1, 0, 0)
    assert overlap.split_overlaps(task.limit(0), s).collect() == [] and overlap.split_overlaps(task, s.limit(0)).collect() == []


def test_overlaps_are_not_exchanged_for_each_shard(spark, monkeypatch):
    # texts of all sizes over many shards against every pair, training texts staying where they were read
    rng = random.Random(7)
    base = [[rng.randrange(40) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    texts = []
    for _ in range(120):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            x[rng.randrange(len(x))] = rng.randrange(40)
        texts.append(x)
    rows = [(f"c{i}", len(x), np.array(x, np.int64).tobytes()) for i, x in enumerate(texts)] + [("none", 0, b"")]
    monkeypatch.setattr(overlap, "SHARD", 150)
    plan = overlap.shard_plan(sorted(Counter(map(len, texts[60:])).items()))
    assert len(plan) > 3 and plan[-1][1] > 8 and max(k for _, _, k in plan) > 1
    df = pairs.stage(spark.createDataFrame(rows, "cls string, n int, w binary"), "t")
    at = lambda a, b: df.where(f"n = 0 or cast(substring(cls, 2) as int) between {a} and {b}")
    near = overlap.near_same(at(0, 59), at(60, 119))
    got = near.collect()
    want = set()
    for i, j in itertools.product(range(60), range(60, 120)):
        c = overlap.common_subsequence(texts[i], texts[j])
        if 10 * c >= 9 * max(len(texts[i]), len(texts[j])):
            want.add((f"c{i}", f"c{j}", c, len(texts[i]), len(texts[j])))
    assert set(map(tuple, got)) == want and len(got) == len(want) and want
    assert "CoGroup" not in near._jdf.queryExecution().toString()
    assert overlap.near_same(at(0, 59), at(200, 300)).collect() == []


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    v = [(centres[rng.integers(12)] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist() for _ in range(700)]
    rows = [(i, f"p{i % 650}", "file" if i % 3 else "task", x) for i, x in enumerate(v)]
    rows += [(1000 + i, f"c{i}", "file", v[1]) for i in range(40)]  # many copies of one vector
    rows += [(2000, "p", "file", None), (2001, "p", "file", [0.0] * 16), (2002, "p", "file", [float("nan")] * 16), (2003, None, "file", v[4]), (2004, None, "file", v[4]), (2005, "p", None, v[5]), (2006, "q", None, [2 * x for x in v[5]]), (2007, "x", "file", [1.0, 2.0]), (2008, "p", "file", [])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, path string, type string, vector array<float>, w double")
    got = neighbours.most_similar(df).collect()
    ok = [(i, p, t, np.array(x, float)) for i, p, t, x in rows if x and np.isfinite(x).all() and np.any(x)]
    by = defaultdict(list)
    for r in got:
        by[r.l_id].append(r)
    hit = total = 0
    for i, p, t, x in ok:
        c = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), j) for j, q, u, y in ok if u == t and len(y) == len(x) and j != i and q != p)[:10]
        assert len(by[i]) == len(c) and all(r.l_path != r.r_path for r in by[i] if r.l_path or r.r_path)
        if c:
            kth = -c[-1][0]
            hit += sum(r.similarity >= kth - 1e-5 for r in by[i])
            total += len(c)
    assert hit / total > 0.97, hit / total
    assert {(r.l_id, r.r_id) for r in got if r.l_id >= 2005} == {(2005, 2006), (2006, 2005)}
    assert neighbours.most_similar(df.limit(0)).collect() == []
    assert all(a < b for a, b in map(tuple, neighbours.close_pairs(df).collect()))
