"""Fuzzy links of commit messages to ticket titles."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cores

#: Messages and titles that one task compares.
BLOCK = 8192
#: Characters with a count of their own, the most frequent ones; the others share one. Counts up to CAP, what is beyond counts as common.
CLASSES, CAP = 48, 12
#: Messages whose bounds are one product; pairs whose subsequences are found in step, and columns between two looks at what they can still reach.
TILE, STEP, LOOK = 256, 16_384, 6


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), the LCS a character of b at a time over all of a."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        if m := at.get(c):
            u = v & m
            v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(_sorted_tokens(a), _sorted_tokens(b))


def sequence_ratio(a: str, b: str) -> float:
    """matching blocks by Ratcliff and Obershelp, 100 * 2 M / T."""
    return 100.0 * difflib.SequenceMatcher(None, a, b).ratio()


class _Texts:
    """Texts as numbers of their characters, one after another."""

    def __init__(self, texts: list[str], chars: np.ndarray) -> None:
        self.size = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.code = np.searchsorted(chars, _points(texts))
        self.owner = np.repeat(np.arange(len(texts)), self.size)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _counts(t: _Texts, of: np.ndarray) -> np.ndarray:
    return np.bincount(t.owner * (CLASSES + 1) + of[t.code], minlength=len(t.size) * (CLASSES + 1)).reshape(-1, CLASSES + 1)


def close_pairs(messages: list[str], titles: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(message, title, length of the longest common subsequence) of all pairs with 200 * length >= threshold * (both sizes), none left out.

    Characters in common bound that length from above. Written as ones for the first, second, ... of each character, they are a matrix product, from
    which what the sizes need is taken off by two more columns. The pairs it leaves go on in step, a character of the titles at a time over all of a
    message in the bits of a few words, until too many characters are without partner.
    """
    out = [np.zeros((3, 0), np.int64)]
    if not messages or not titles:
        return tuple(out[0])
    chars = np.unique(_points(messages + titles))
    x, y = _Texts(messages, chars), _Texts(titles, chars)
    often = np.bincount(x.code, minlength=len(chars)) + np.bincount(y.code, minlength=len(chars))
    of = np.full(len(chars), CLASSES)
    of[np.argsort(-often, kind="stable")[:CLASSES]] = np.arange(min(CLASSES, len(chars)))
    hx, hy = _counts(x, of), _counts(y, of)
    top = np.minimum(np.minimum(hx.max(0), hy.max(0)), CAP)
    c, k = (np.array([(c, k) for c in range(CLASSES + 1) for k in range(1, top[c] + 1)], np.int64).reshape(-1, 2)).T
    beyond = np.maximum(hx - CAP, 0).sum(1)
    share = threshold / 200
    wide = -(-x.size // 64)
    rows = np.lexsort((np.arange(len(x.size)), wide))  # messages of as many words of bits together
    cols = np.argsort(-y.size, kind="stable")  # the longest titles first, so those that go on are always a head
    fy = np.concatenate([hy[cols][:, c] >= k, (-share * y.size[cols])[:, None], np.ones((len(cols), 1))], 1).astype(np.float32)
    at = 0
    while at < len(rows):
        own = rows[at : at + TILE]
        own = own[wide[own] == wide[own[0]]]
        own = own[: max(1, 8_000_000 // (max(1, int(wide[own[0]])) * len(chars)))]  # 64 MB of bits
        at += len(own)
        fx = np.concatenate([hx[own][:, c] >= k, np.ones((len(own), 1)), (beyond[own] - share * x.size[own])[:, None]], 1).astype(np.float32)
        near = np.flatnonzero((fy @ fx.T).reshape(-1) >= -0.01)
        # bits of a message where a character stands
        w = int(wide[own[0]])
        bits = np.zeros((max(1, w), len(own) * len(chars)), np.uint64)
        for i, m in enumerate(own):
            code = x.code[x.first[m] : x.first[m] + x.size[m]]
            p = np.arange(len(code))
            np.bitwise_or.at(bits, (p >> 6, i * len(chars) + code), np.uint64(1) << (p & 63).astype(np.uint64))
        full = np.zeros((max(1, w), len(own)), np.uint64)
        for z in range(w):
            held = np.clip(x.size[own] - 64 * z, 0, 64)
            full[z] = np.where(held == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(held, 63).astype(np.uint64)) - np.uint64(1))
        for z in range(0, len(near), STEP):
            t, i = np.divmod(near[z : z + STEP], len(own))
            t = cols[t]
            need = np.ceil(share * (x.size[own][i] + y.size[t]) - 1e-6).astype(np.int64)
            live, n = _subsequences(bits, full, i, len(chars), y.code, y.first[t], y.size[t], need, x.size[own][i])
            out.append(np.stack([own[i[live]], t[live], n]))
    return tuple(np.concatenate(out, 1))


def _subsequences(bits: np.ndarray, full: np.ndarray, i: np.ndarray, chars: int, code: np.ndarray, first: np.ndarray, size: np.ndarray, need: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, length) of the pairs whose longest common subsequence is need or more; sizes of the titles fall."""
    w = len(bits)
    live, row, f = np.arange(len(i)), i * chars, full[:, i]
    v = f.copy()
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    j, end = 0, int(size[0]) if len(size) else 0
    common = lambda v, f, live: length[live] - np.bitwise_count(v & f).sum(0, dtype=np.int64)
    while j < end and len(live):
        # up to the next look, or to where the shortest of the titles ends
        to = min(j + LOOK, int(size[live[-1]]))
        pos = first[live] + j
        for _ in range(j, to):
            m = row + code[pos]
            pos += 1
            if w == 1:
                u = v[0] & bits[0][m]
                s = v[0] + u
                v[0] ^= u
                v[0] |= s
            else:
                carry = np.zeros(len(live), np.uint64)
                for z in range(w):
                    u = v[z] & bits[z][m]
                    s = v[z] + u
                    over = s < u
                    s += carry
                    carry = (over | (s < carry)).astype(np.uint64)
                    v[z] ^= u
                    v[z] |= s
        j = to
        n = common(v, f, live)
        go = n + size[live] - j >= need[live]
        done = go & (size[live] == j)
        if done.any():
            kept.append((live[done], n[done]))
            go &= ~done
        if not go.all():
            live, row, f, v = live[go], row[go], f[:, go], v[:, go]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def _best(own: list[str], keys: list[str], method: str, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(message, title, score) of the best title of each message, the first of equals. By sequence only pairs are scored whose common subsequence
    reaches the threshold and the best score so far."""
    i, j, n = close_pairs(own, keys, threshold)
    if not len(i):
        return
    top = np.round(200.0 * n / (np.array([len(k) for k in own])[i] + np.array([len(k) for k in keys])[j]), 6)
    order = np.lexsort((j, -top, i))
    for z in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        best, at = threshold, -1
        for p in z:
            if top[p] < best - 1e-9 or (method == "token_sort" and at >= 0):
                break
            r = float(top[p]) if method == "token_sort" else round(sequence_ratio(own[i[p]], keys[j[p]]), 6)
            if r > best or (r == best and (at < 0 or j[p] < at)):
                best, at = r, int(j[p])
        if at >= 0:
            yield int(i[z[0]]), at, best


def best_titles(messages: DataFrame, titles: DataFrame, method: str = "token_sort", threshold: float = 75.0) -> DataFrame:
    """(message, title_id, title, score) of the best title of every message with score >= threshold; ties by the smallest id.

    messages: distinct `message`; titles: `title_id`, `title`; both normalised, texts under eight characters take no part. The
    messages are a stated set of queries against all titles, in blocks. The longest common subsequence is the first ratio and bounds the second
    from above, so only pairs for which it reaches the threshold are scored; no pair leaves its task.
    """
    m = messages.where(F.length("message") >= 8).select("message").distinct()
    t = titles.where(F.length("title") >= 8).select("title_id", "title")
    nm, nt = (max(1, -(-x.count() // BLOCK)) for x in (m, t))
    nt = max(nt, -(-3 * cores(m.sparkSession) // nm))
    m = m.withColumn("a", F.pmod(F.xxhash64("message"), F.lit(nm)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    t = t.withColumn("b", F.pmod(F.xxhash64("title_id"), F.lit(nt)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(nm - 1))))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values(["title_id", "title"], ignore_index=True)
            key = _sorted_tokens if method == "token_sort" else str
            own, keys = [key(s) for s in x.message], [key(s) for s in y.title]
            out = [(x.message[i], int(y.title_id[j]), y.title[j], r) for i, j, r in _best(own, keys, method, threshold)]
        return pd.DataFrame(out, columns=["message", "title_id", "title", "score"]).astype({"message": object, "title_id": "int64", "title": object, "score": float})

    # one task for each two blocks, which are small in bytes and must not be put together
    m, t = (d.repartition(nm * nt, "a", "b") for d in (m, t))
    got = m.groupBy("a", "b").cogroup(t.groupBy("a", "b")).applyInPandas(run, "message string, title_id long, title string, score double")
    best = got.groupBy("message").agg(F.min(F.struct((-F.col("score")).alias("s"), "title_id", "title")).alias("x"))
    return best.select("message", "x.title_id", "x.title", (-F.col("x.s")).alias("score"))
