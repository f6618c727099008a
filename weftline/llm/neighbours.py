"""Most similar vectors for every vector, by NN-descent.

Vectors of one type and length are a group; equal ones (up to length) become one node. Random-projection trees, fitted on a bounded
sample, put the nodes into blocks and give a first graph. Then, round by round, every node joins its neighbours and those it
is a neighbour of with each other: pairs with a new member are compared, and whoever finds a better neighbour keeps it. A
round is three exchanges between blocks: edges to the blocks of their ends, each vector once to every block where it is somebody's
neighbour, and improvements back. Rounds end when next to nothing changes. Queries from outside walk the graph greedily.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import drop, spread, stage, wide

#: Nodes of a block; neighbours kept of a node while the graph is built; trees of the first graph; their leaves.
BLOCK, WIDTH, TREES, LEAF = 24_000, 24, 3, 128
#: Vectors that trees are fitted on, at most, and blocks that a tree tells apart, at most; beyond, ids divide them further.
FIT, LEAVES = 65_536, 1024
#: Rounds end when a smaller share of neighbours is new, at the latest after so many.
SETTLED, ROUNDS = 0.01, 12

STATE, EDGES, VECTORS, BETTER = range(4)
_ROW = "dest int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_COLS = ["dest", "kind", "a", "b", "c", "d", "e", "f"]


def usable(df: DataFrame, id: str, path: str, kind: str, vector: str) -> DataFrame:
    """(id, path, kind, dim, cls, v): rows with a usable vector, scaled to length 1 as 32-bit floats; cls names equal ones.

    Null vectors, vectors of length 0, with null or non-finite elements or without direction are left out.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, cls, vs, dim = [], [], [], []
            for i, x in enumerate(b["_v"]):
                if x is None:
                    continue
                v = np.asarray(x, np.float64)
                top = np.abs(v).max(initial=0)
                if not len(v) or not np.isfinite(top) or top == 0:
                    continue
                v = v / top
                raw = (v / np.sqrt((v * v).sum())).astype(np.float32)
                raw = (raw + 0.0).tobytes()  # one zero only
                keep.append(i)
                dim.append(len(v))
                vs.append(raw)
                cls.append(hashlib.blake2b(raw, digest_size=12).hexdigest())
            k = b.iloc[keep]
            yield pd.DataFrame({"id": k["_id"].tolist(), "path": k["_p"].tolist(), "kind": k["_k"].tolist(), "dim": dim, "cls": cls, "v": vs}, columns=["id", "path", "kind", "dim", "cls", "v"]).astype(object)

    s = df.select(F.col(id).alias("_id"), F.col(path).alias("_p"), F.col(kind).alias("_k"), F.col(vector).cast("array<float>").alias("_v")).where("_id is not null and _v is not null")
    return wide(s).mapInPandas(run, "id long, path string, kind string, dim int, cls string, v binary")


class Tree:
    """Splits by hyperplanes at the sample's medians, down to `leaves` leaves (a power of two)."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        depth = int(np.ceil(np.log2(max(1, leaves))))
        self.depth = depth
        n, d = (len(sample), sample.shape[1]) if len(sample) else (0, 1)
        self.planes, self.cuts = np.zeros((max(1, (1 << depth) - 1), d), np.float32), np.zeros(max(1, (1 << depth) - 1), np.float32)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            for node in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(at == node)
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    self.planes[node] = a - b
                    self.cuts[node] = np.median(sample[own] @ self.planes[node])
                else:
                    self.planes[node] = rng.standard_normal(d)
            at = self._down(sample, at)

    def _down(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 2 * at + 1 + (np.einsum("ij,ij->i", v, self.planes[at]) > self.cuts[at])

    def leaf(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            at = self._down(v, at)
        return at - ((1 << self.depth) - 1)


def _mat(raw, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(-1, dim)


def _best(u: np.ndarray, w: np.ndarray, s: np.ndarray, f: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of edges (u, w, s, new f): each pair once, old before new, and of each u the `width` best, ties by w."""
    o = np.lexsort((f, w, u))
    u, w, s, f = u[o], w[o], s[o], f[o]
    k = np.ones(len(u), bool)
    k[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    u, w, s, f = u[k], w[k], s[k], f[k]
    o = np.lexsort((w, -s, u))
    u, w, s, f = u[o], w[o], s[o], f[o]
    k = np.arange(len(u)) - np.searchsorted(u, u) < width
    return u[k], w[k], s[k], f[k]


def _leaf_edges(v: np.ndarray, ids: np.ndarray, path: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Edges to the best of each node's leaf, leaves being halves of halves by random directions."""
    rng = np.random.default_rng(seed)
    todo, out = [np.arange(len(v))], []
    while todo:
        own = todo.pop()
        if len(own) > LEAF:
            a, b = v[rng.choice(own, 2, replace=False)]
            p = v[own] @ (a - b) if (a != b).any() else rng.random(len(own))
            o = np.argsort(p, kind="stable")
            todo += [own[o[: len(o) // 2]], own[o[len(o) // 2 :]]]
            continue
        if len(own) < 2:
            continue
        s = v[own] @ v[own].T
        pp = path[own]
        s[(pp[:, None] == pp) & (pp[:, None] != 0)] = -9
        np.fill_diagonal(s, -9)
        k = min(WIDTH, len(own) - 1)
        j = np.argpartition(-s, k - 1, 1)[:, :k] if k < len(own) - 1 else np.argsort(-s, 1)[:, :k]
        val = np.take_along_axis(s, j, 1)
        ok = val > -9
        out.append((np.repeat(ids[own], k)[ok.reshape(-1)], ids[own][j][ok], val[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))


class _Layout:
    """Where nodes live: block b of a group holds ids first[b] .. first[b + 1] - 1."""

    def __init__(self, first: np.ndarray, dims: np.ndarray) -> None:
        self.first, self.dims = first, dims
        self.kind = np.int32 if first[-1] < 2**31 else np.int64

    def block(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, ids, "right") - 1


def _row(dest: int, kind: int, *cols: np.ndarray) -> tuple:
    return (dest, kind, *[c.tobytes() for c in cols], *[b""] * (6 - len(cols)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS).astype({"dest": "int32", "kind": "int32"} | {c: object for c in _COLS[2:]})


def _by_block(layout: _Layout, key: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """(block, columns...) of the entries whose key lives there."""
    b = layout.block(key)
    o = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(b[o]) != 0])) if len(o) else np.zeros(0, np.int64)
    for x, y in zip(edge, np.append(edge[1:], len(o))):
        yield int(b[o[x]]), *[c[o[x:y]] for c in cols]


class _Block:
    """A block's state: vectors (16-bit), paths, and edges (u, w, s, new) sorted by u."""

    def __init__(self, layout: _Layout, row) -> None:
        k = layout.kind
        self.dest, self.layout = int(row.dest), layout
        self.dim = int(layout.dims[self.dest])
        self.lo, self.hi = int(layout.first[self.dest]), int(layout.first[self.dest + 1])
        self.v = np.frombuffer(row.a, np.float16).reshape(-1, self.dim)
        self.path = np.frombuffer(row.b, np.int64)
        self.u, self.w, self.s, self.new = (np.frombuffer(x, t) for x, t in ((row.c, k), (row.d, k), (row.e, np.float32), (row.f, bool)))

    def row(self, u, w, s, new) -> tuple:
        k = self.layout.kind
        return _row(self.dest, STATE, self.v, self.path, u.astype(k), w.astype(k), s.astype(np.float32), new)

    def kth(self) -> np.ndarray:
        """The similarity that a new neighbour of each node must exceed."""
        n = self.hi - self.lo
        out = np.full(n, 9, np.float32)
        np.minimum.at(out, self.u - self.lo, self.s)
        out[np.bincount(self.u - self.lo, minlength=n) < WIDTH] = -9
        return out


def _rows(g: pd.DataFrame, kind: int):
    return g[g.kind == kind].itertuples(index=False)


def _send_edges(layout: _Layout):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in _rows(b, STATE):
                s = _Block(layout, r)
                out = [tuple(r)]
                for at, u, w, new in _by_block(layout, s.w, s.u, s.w, s.new):
                    out.append(_row(at, EDGES, u.astype(layout.kind), w.astype(layout.kind), new))
                yield _frame(out)

    return run


def _reverse(layout: _Layout, g: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(node here, whoever has it as neighbour, new) of the edges sent here."""
    k = layout.kind
    got = [(np.frombuffer(r.b, k), np.frombuffer(r.a, k), np.frombuffer(r.c, bool)) for r in _rows(g, EDGES)]
    if not got:
        return np.zeros(0, k), np.zeros(0, k), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*got))


def _send_vectors(layout: _Layout):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = list(_rows(g, STATE))
        if not own:
            return _frame([])
        s = _Block(layout, own[0])
        at, by, new = _reverse(layout, g)
        out = [tuple(own[0]), _row(s.dest, EDGES, by, at, new)]
        kth = s.kth()
        u, w = np.concatenate([s.u, at]), np.concatenate([s.w, by])
        key = np.unique(np.stack([layout.block(w), u.astype(np.int64)], 1), axis=0)
        key = key[key[:, 0] != s.dest]
        edge = np.searchsorted(key[:, 0], np.unique(key[:, 0]))
        for x, y in zip(edge, np.append(edge[1:], len(key))):
            i = key[x:y, 1] - s.lo
            out.append(_row(int(key[x, 0]), VECTORS, key[x:y, 1].astype(layout.kind), s.v[i], kth[i], s.path[i]))
        return _frame(out)

    return run


def _join(layout: _Layout):
    """The local join: neighbours of each node here, in either direction, are compared with each other."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = list(_rows(g, STATE))
        if not own:
            return _frame([])
        s = _Block(layout, own[0])
        at, by, new = _reverse(layout, g)
        ids, vs, kths, paths = [np.arange(s.lo, s.hi)], [s.v], [s.kth()], [s.path]
        for r in _rows(g, VECTORS):
            ids.append(np.frombuffer(r.a, layout.kind).astype(np.int64))
            vs.append(np.frombuffer(r.b, np.float16).reshape(-1, s.dim))
            kths.append(np.frombuffer(r.c, np.float32))
            paths.append(np.frombuffer(r.d, np.int64))
        ids, v, kth, path = np.concatenate(ids), np.concatenate(vs).astype(np.float32), np.concatenate(kths), np.concatenate(paths)
        o = np.argsort(ids)
        ids, v, kth, path = ids[o], v[o], kth[o], path[o]
        a, b, f = np.concatenate([s.u, at]).astype(np.int64), np.searchsorted(ids, np.concatenate([s.w, by])), np.concatenate([s.new, new])
        o = np.lexsort((~f, b, a))
        a, b, f = a[o], b[o], f[o]
        k = np.ones(len(a), bool)
        k[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, f = a[k] - s.lo, b[k], f[k]
        n = s.hi - s.lo
        first = np.searchsorted(a, np.arange(n + 1))
        deg = np.diff(first)
        active = np.flatnonzero((np.bincount(a[f], minlength=n) > 0) & (deg > 1))
        active = active[np.argsort(deg[active], kind="stable")]
        found: list[tuple[np.ndarray, ...]] = []
        held = i = 0

        def settle() -> None:
            u, w, x = (np.concatenate(c) for c in zip(*found))
            found[:] = [_best(u, w, x, np.zeros(len(u), bool), WIDTH)[:3]]

        while i < len(active):
            wide = int(deg[active[min(i + 255, len(active) - 1)]])
            m = max(1, min(256, 3_000_000 // (wide * wide)))
            nodes = active[i : i + m]
            i += m
            wide = int(deg[nodes[-1]])
            idx = first[nodes][:, None] + np.arange(wide)
            val = np.arange(wide) < deg[nodes][:, None]
            idx = np.minimum(idx, len(b) - 1)
            who = np.where(val, b[idx], 0)
            fresh = val & f[idx]
            mat, lim, pth = v[who], kth[who], path[who]
            step = max(1, 4_000_000 // max(1, wide * len(nodes)))
            for z in range(0, wide, step):  # a hub's rows come in slices
                sim = np.matmul(mat[:, z : z + step], mat.transpose(0, 2, 1))
                ok = (fresh[:, z : z + step, None] | fresh[:, None, :]) & val[:, z : z + step, None] & val[:, None, :] & (sim > lim[:, z : z + step, None])
                ok &= who[:, z : z + step, None] != who[:, None, :]
                pz = pth[:, z : z + step]
                ok &= (pz[:, :, None] != pth[:, None, :]) | (pz[:, :, None] == 0)
                p, q, r = np.nonzero(ok)
                found.append((who[p, z + q], who[p, r], sim[p, q, r]))
                held += len(p)
            if held > 4_000_000:
                settle()
                held = len(found[0][0])
        out = [tuple(own[0])]
        if found:
            settle()
            u, w, x = found[0]
            for dest, u, w, x in _by_block(layout, ids[u], ids[u], ids[w], x):
                out.append(_row(dest, BETTER, u.astype(layout.kind), w.astype(layout.kind), x.astype(np.float32)))
        return _frame(out)

    return run


def _merge(layout: _Layout, width: int = WIDTH):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = list(_rows(g, STATE))
        if not own:
            return _frame([])
        s = _Block(layout, own[0])
        parts = [(s.u, s.w, s.s, s.new)]
        for r in _rows(g, BETTER):
            u, w, x = (np.frombuffer(c, t) for c, t in ((r.a, layout.kind), (r.b, layout.kind), (r.c, np.float32)))
            parts.append((u, w, x, np.ones(len(u), bool)))
        # a pair that is old keeps its flag; edges that stay are old from now on
        u, w, x, f = (np.concatenate(c) for c in zip(*parts))
        old = np.concatenate([np.zeros(len(s.u), bool), np.ones(len(u) - len(s.u), bool)])
        return _frame([s.row(*_best(u, w, x, old, width))])

    return run


def build_graph(nodes: DataFrame, layout: _Layout, first_edges: DataFrame) -> DataFrame:
    """The settled graph as rows of blocks. nodes: STATE rows without edges; first_edges: BETTER rows."""
    spark = nodes.sparkSession
    blocks = len(layout.dims)
    at = lambda d: d.repartition(blocks, "dest").groupBy("dest")
    g = stage(at(nodes.unionByName(first_edges)).applyInPandas(_merge(layout), _ROW), "graph")
    for _ in range(ROUNDS):
        e = g.mapInPandas(_send_edges(layout), _ROW)
        x = at(e).applyInPandas(_send_vectors(layout), _ROW)
        y = at(x).applyInPandas(_join(layout), _ROW)
        new = stage(at(y).applyInPandas(_merge(layout), _ROW), "graph")
        drop(g)
        g = new
        # shares of new edges, from the rows' flags: one byte each
        n = g.select(F.sum(F.length("f")).alias("n"), F.sum(F.length(F.regexp_replace(F.hex("f"), "00", ""))).alias("new")).first()
        gc.collect()
        spark._jvm.System.gc()  # lets Spark remove the exchanges of past rounds
        if not n.n or n.new / 2 / n.n < SETTLED:
            break
    return g


def _exact(layout: _Layout):
    """Exact similarities of the graph's edges: blocks get the 32-bit vectors of their nodes' neighbours."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in _rows(b, STATE):
                s = _Block(layout, r)
                out = [_row(s.dest, STATE, s.u, s.w)]
                for at, w in _by_block(layout, s.w, s.w):
                    out.append(_row(at, EDGES, np.unique(w), np.array([s.dest], np.int64)))
                yield _frame(out)

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        own = list(_rows(g, VECTORS))
        if not own:
            return _frame([])
        dest = int(own[0].dest)
        v = np.frombuffer(own[0].a, np.float32).reshape(-1, int(layout.dims[dest]))
        out = [tuple(r) for r in _rows(g, STATE)] + [_row(dest, BETTER, np.arange(layout.first[dest], layout.first[dest + 1]).astype(layout.kind), v)]
        for r in _rows(g, EDGES):
            w, to = np.frombuffer(r.a, layout.kind), int(np.frombuffer(r.b, np.int64)[0])
            if to != dest:
                out.append(_row(to, VECTORS, w, v[w - layout.first[dest]]))
        return _frame(out)

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        own, home = list(_rows(g, STATE)), list(_rows(g, BETTER))
        if not own or not home:
            return pd.DataFrame({"u": [], "w": [], "s": []}).astype({"u": "int64", "w": "int64", "s": "float64"})
        k, dest = layout.kind, int(own[0].dest)
        dim = int(layout.dims[dest])
        u, w = np.frombuffer(own[0].a, k), np.frombuffer(own[0].b, k)
        parts = [(np.frombuffer(r.a, k), np.frombuffer(r.b, np.float32).reshape(-1, dim)) for r in [*home, *_rows(g, VECTORS)]]
        ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        o = np.argsort(ids)
        ids, v = ids[o], v[o]
        i, j = np.searchsorted(ids, u), np.searchsorted(ids, w)
        s = np.empty(len(u))
        for x in range(0, len(u), 1 << 17):
            z = slice(x, x + (1 << 17))
            s[z] = np.einsum("ij,ij->i", v[i[z]].astype(np.float64), v[j[z]].astype(np.float64))
        return pd.DataFrame({"u": u.astype(np.int64), "w": w.astype(np.int64), "s": s})

    return ask, answer, settle


def similar_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of usable rows (kind, dim, cls, v, path): edges (u, w, s) of node ids, nodes (node, kind, dim, cls)."""
    c = rows.groupBy("kind", "dim", "cls").agg(F.first("v").alias("v"), F.min("path").alias("p"), F.max("path").alias("q"), F.count("path").alias("np"), F.count("*").alias("n"))
    one = (F.col("p") == F.col("q")) & (F.col("np") == F.col("n"))
    c = stage(c.select("kind", "dim", "cls", "v", F.when(one, F.xxhash64("p")).otherwise(F.lit(0)).alias("path")), "classes")
    groups = [(r.kind, r.dim, r.n) for r in c.groupBy("kind", "dim").agg(F.count("*").alias("n")).orderBy("kind", "dim").collect()]
    total = sum(n for *_, n in groups)
    if not total:
        spark = rows.sparkSession
        return spark.createDataFrame([], "u long, w long, s double"), spark.createDataFrame([], "node long, kind string, dim int, cls string")
    # trees, on a sample that ids choose
    trees, base, b0 = {}, {}, 0
    want = {(k, d): max(1, -(-n // BLOCK)) for k, d, n in groups}
    for k, d, n in groups:
        leaves = 1
        while leaves < min(LEAVES, want[k, d]):
            leaves *= 2
        more = -(-want[k, d] // leaves)
        base[k, d] = (b0, leaves, more)
        b0 += leaves * more
        sample = np.zeros((0, d), np.float32)
        if leaves > 1:
            share = min(1.0, FIT / n)
            s = c.where(F.col("kind").eqNullSafe(F.lit(k)) & (F.col("dim") == d) & (F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))).select("v").limit(FIT).collect()
            sample = _mat([bytes(r.v) for r in s], d)
        trees[k, d] = [Tree(sample, leaves, 7 * t + 1) for t in range(TREES)]
    shared = rows.sparkSession.sparkContext.broadcast((trees, base))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, base = shared.value
        for b in batches:
            b = b.reset_index(drop=True)
            out = np.zeros((len(b), TREES), np.int32)
            kinds = [None if x is None or x != x else x for x in b.kind]
            keys = np.array([f"{k!r}|{d}" for k, d in zip(kinds, b.dim)])
            for key in np.unique(keys):
                i = np.flatnonzero(keys == key)
                g = (kinds[i[0]], int(b.dim.iat[i[0]]))
                b0, leaves, more = base[g]
                v = _mat([b.v.iat[x] for x in i], g[1])
                sub = np.array([int(b.cls.iat[x][:8], 16) % more for x in i])
                for t in range(TREES):
                    out[i, t] = b0 + trees[g][t].leaf(v) * more + sub
            yield pd.DataFrame({"kind": kinds, "dim": b.dim, "cls": b.cls.tolist(), "v": b.v.tolist(), "path": b.path, **{f"t{t}": out[:, t] for t in range(TREES)}})

    ts = ", ".join(f"t{t} int" for t in range(TREES))
    a = stage(spread(c, "cls").mapInPandas(assign, f"kind string, dim int, cls string, v binary, path long, {ts}"), "assigned")
    counts = {r.t0: r.n for r in a.groupBy("t0").agg(F.count("*").alias("n")).collect()}  # a row for each block
    first = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(b0)])])
    dims = np.ones(b0, np.int64)
    for (k, d), (x, leaves, more) in base.items():
        dims[x : x + leaves * more] = d
    layout = _Layout(first, dims)

    def number(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cls", ignore_index=True)
        g["node"] = first[int(g.t0.iat[0])] + np.arange(len(g))
        return g.astype({"kind": object})

    numbered = stage(a.repartition(b0, "t0").groupBy("t0").applyInPandas(number, f"kind string, dim int, cls string, v binary, path long, {ts}, node long"), "numbered")

    def states(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        none = np.zeros(0, layout.kind)
        return _frame([_row(int(g.t0.iat[0]), STATE, _mat(g.v, int(g.dim.iat[0])).astype(np.float16), g.path.to_numpy(np.int64), none, none, np.zeros(0, np.float32), np.zeros(0, bool))])

    def exact(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        return _frame([_row(int(g.t0.iat[0]), VECTORS, _mat(g.v, int(g.dim.iat[0])))])

    def leaves_of(t: int):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("node")
            u, w, s = _leaf_edges(_mat(g.v, int(g.dim.iat[0])), g.node.to_numpy(np.int64), g.path.to_numpy(np.int64), t)
            return _frame([_row(at, BETTER, u.astype(layout.kind), w.astype(layout.kind), s.astype(np.float32)) for at, u, w, s in _by_block(layout, u, u, w, s)])

        return run

    by = lambda t: numbered.select("dim", "v", "path", "node", "t0", F.col(f"t{t}").alias("tt")).repartition(b0, "tt").groupBy("tt")
    edges = by(0).applyInPandas(leaves_of(0), _ROW)
    for t in range(1, TREES):
        edges = edges.unionByName(by(t).applyInPandas(leaves_of(t), _ROW))
    graph = build_graph(by(0).applyInPandas(states, _ROW), layout, edges)
    ask, answer, settle = _exact(layout)
    asked = graph.mapInPandas(ask, _ROW).unionByName(by(0).applyInPandas(exact, _ROW))
    told = asked.repartition(b0, "dest").groupBy("dest").applyInPandas(answer, _ROW)
    out = stage(told.repartition(b0, "dest").groupBy("dest").applyInPandas(settle, "u long, w long, s double"), "edges")
    drop(graph, a)
    return out, numbered.select("node", "kind", "dim", "cls")


def most_similar(df: DataFrame, k: int = 10, id: str = "id", path: str = "path", kind: str = "type", vector: str = "vector") -> DataFrame:
    """(l_id, r_id, l_path, r_path, type, similarity, rank) of each usable row's k most similar rows of its type and length and of
    another path; ties by id. Approximate: a true neighbour may be missing (see the README for the recall measured).

    A null path is a path of its own kind: rows without path are not paired with each other; a null type is a type. Equal vectors are one
    node of the graph; of its rows only the first by id that a partner can need are expanded (k for each path, 2 * k in
    all), which loses none of the k. Repeated ids are rows of their own. An empty table gives an empty result.
    """
    rows = stage(usable(df, id, path, kind, vector), "usable")
    edges, nodes = similar_classes(rows)
    m = rows.select("id", F.coalesce("path", F.lit("\0")).alias("path"), "kind", "dim", "cls").join(nodes.withColumnRenamed("kind", "nk"), ["cls", "dim"]).where(F.col("kind").eqNullSafe(F.col("nk")))
    m = stage(m.select("node", "id", "path", "kind"), "members")
    # row_number <= n is cut in each partition before the exchange, so a class of a third of the rows is never in one task
    r1 = F.row_number().over(Window.partitionBy("node", "path").orderBy("id"))
    r2 = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    few = m.withColumn("x", r1).where(F.col("x") <= k).withColumn("x", r2).where(F.col("x") <= 2 * k).select(F.col("node").alias("w"), F.col("id").alias("r_id"), F.col("path").alias("r_path"))
    many = m.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("u"), F.col("node").alias("w"), F.lit(1.0).alias("s"))
    near = edges.unionByName(many).join(few, "w")
    # each class keeps of its own candidates what any of its rows can need
    top = F.row_number().over(Window.partitionBy("u", "r_path").orderBy(F.col("s").desc(), "r_id"))
    near = near.withColumn("x", top).where(F.col("x") <= k + 1).drop("x")
    top = F.row_number().over(Window.partitionBy("u").orderBy(F.col("s").desc(), "r_id"))
    near = near.withColumn("x", top).where(F.col("x") <= 3 * k).select("u", "r_id", "r_path", "s")
    j = m.select(F.col("node").alias("u"), F.col("id").alias("l_id"), F.col("path").alias("l_path"), "kind").join(near, "u").where("l_path <> r_path")
    rank = F.row_number().over(Window.partitionBy("l_id", "l_path", "u").orderBy(F.col("s").desc(), "r_id"))
    real = lambda c: F.when(F.col(c) != "\0", F.col(c)).alias(c)
    return j.withColumn("rank", rank).where(F.col("rank") <= k).select("l_id", "r_id", real("l_path"), real("r_path"), F.col("kind").alias("type"), F.col("s").alias("similarity"), "rank")


def close_pairs(df: DataFrame, least: float = 0.9, k: int = 10) -> DataFrame:
    """(l_id, r_id), l_id < r_id: one is among the k most similar of the other and the similarity is at least `least`."""
    p = most_similar(df, k).where(F.col("similarity") >= least - 1e-7)
    return p.select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id")).distinct()


#: Greedy search: vectors compared as entries (a bounded sample), of which so many start; nodes kept and expanded at a time; rounds at most.
ENTRIES, STARTS, BEAM, EXPAND, STEPS = 2048, 8, 40, 4, 30


def graph_search(queries: DataFrame, edges: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(qid, node, s) of each query's k nearest nodes found by greedy walks over the graph; approximate.

    queries (qid, grp, v), edges (u, w) in either direction, vectors (node, grp, v), v as 32-bit floats of length 1, grp telling which may meet.
    A query starts at the best of a bounded sample of entries. In each round it expands its best nodes not yet expanded: their
    neighbours that it has not met are compared, and its BEAM best stay. It ends when all of them are expanded. Queries are rows of
    joins with the graph and the vectors, so neither is ever gathered.
    """
    from weftline.functions.vectors import dot

    both = stage(edges.select("u", "w").union(edges.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct().groupBy("u").agg(F.collect_list("w").alias("ws")), "adjacency")
    vec = stage(vectors.select("node", "grp", "v"), "vectors")
    qs = stage(queries.select("qid", "grp", F.col("v").alias("q")), "queries")
    # entries: in each group those of the smallest hashes, ENTRIES in all at most
    groups = max(1, vec.select("grp").distinct().count())
    order = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node")))
    sample = vec.withColumn("x", order).where(F.col("x") <= max(STARTS, ENTRIES // groups)).drop("x")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s").desc(), "node"))
    near = qs.join(F.broadcast(sample), "grp").select("qid", "node", dot(F.col("q"), F.col("v")).alias("s"))
    beam = stage(near.withColumn("x", best).where(F.col("x") <= STARTS).select("qid", "node", "s", F.lit(False).alias("done")), "beam")
    met = beam.select("qid", "node")
    for _ in range(STEPS):
        todo = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s").desc(), "node"))
        front = beam.where("not done").withColumn("x", todo).where(F.col("x") <= EXPAND).select("qid", "node")
        front = stage(front, "front")
        if front.isEmpty():
            break
        new = front.join(both, front.node == both.u).select("qid", F.explode("ws").alias("node")).distinct().join(met, ["qid", "node"], "left_anti")
        new = stage(new, "new")
        seen = new.join(qs, "qid").join(vec.select("node", "v"), "node").select("qid", "node", dot(F.col("q"), F.col("v")).alias("s"), F.lit(False).alias("done"))
        old = beam.join(front.withColumn("f", F.lit(True)), ["qid", "node"], "left").select("qid", "node", "s", (F.col("done") | F.coalesce("f", F.lit(False))).alias("done"))
        grown = old.unionByName(seen).withColumn("x", best).where(F.col("x") <= BEAM).drop("x")
        nxt = stage(grown, "beam")
        met = stage(met.unionByName(new), "met")
        drop(beam, front)
        beam = nxt
    return beam.withColumn("x", best).where(F.col("x") <= k).select("qid", "node", "s")


def search_rows(df: DataFrame, k: int = 10, every: int = 20, id: str = "id", path: str = "path", kind: str = "type", vector: str = "vector") -> DataFrame:
    """(query_id, id, path, similarity, rank): greedy graph search of the stated query set - usable rows whose id is divisible by `every` - against all
    usable rows of their type and length and of another path. A query's own class of equal vectors counts like any other; ties by id.
    """
    rows = stage(usable(df, id, path, kind, vector), "usable")
    edges, nodes = similar_classes(rows)
    grp = F.xxhash64(F.coalesce("kind", F.lit("\0")), F.col("dim"))
    key = rows.select("id", F.coalesce("path", F.lit("\0")).alias("path"), grp.alias("grp"), "cls", F.col("v").alias("raw"))
    named = stage(key.join(nodes.select("node", grp.alias("grp"), "cls"), ["grp", "cls"]), "named")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "grp": b["grp"], "v": [np.frombuffer(x, np.float32) for x in b["raw"]]})

    as_array = lambda d: d.mapInPandas(unpack, "i long, grp long, v array<float>")
    vec = as_array(named.groupBy("node", "grp").agg(F.first("raw").alias("raw")).select(F.col("node").alias("i"), "grp", "raw")).withColumnRenamed("i", "node")
    q = as_array(named.where(F.col("id") % every == 0).select(F.col("id").alias("i"), "grp", "raw")).withColumnRenamed("i", "qid")
    # more than k nodes, for those that drop out as rows of the query's own path
    found = graph_search(q, edges, vec, BEAM)
    r1 = F.row_number().over(Window.partitionBy("node", "path").orderBy("id"))
    r2 = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    few = named.select("node", "id", "path").withColumn("x", r1).where(F.col("x") <= k).withColumn("x", r2).where(F.col("x") <= 2 * k).drop("x")
    own = named.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("path").alias("own"))
    j = found.join(few, "node").join(own, "qid").where("path <> own")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s").desc(), "id"))
    return j.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "id", F.when(F.col("path") != "\0", F.col("path")).alias("path"), F.round("s", 6).alias("similarity"), "rank")
