"""Text that was read with another character encoding than it was written in.

A latent variable says for every sentence by which chain of encodings (written in, read as, once or twice) it came to be, the first
chain being none. Its prior is pooled over all sentences of a source and kind of record (a cell), its likelihood is that of the
text the chain leads back to, under a character model of the corpus. Expectation-maximization fits priors and
character model together, so that weak evidence adds up over records; each sentence is then repaired by its posterior.
Sentences with the same words count once with their number, so the fit works on distinct evidence only.
"""

from __future__ import annotations

import html
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import cores, drop, stage, wide

#: Encodings that texts are read with and written in.
LATIN = ["cp1252", "cp1250", "cp437", "cp850", "mac_roman", "iso8859_2", "cp1254", "cp1257"]
CYRILLIC = ["cp1251", "koi8_u", "cp866", "iso8859_5", "mac_cyrillic"]
EAST = ["cp932", "gbk", "euc_jp", "big5", "euc_kr"]
#: (written in, read as, times)
CHAINS = [("", "", 0)]
CHAINS += [("utf8", e, n) for e in LATIN + CYRILLIC for n in (1, 2)] + [("utf8", "cp1252", 3)]
CHAINS += [("utf8", e, 1) for e in EAST]
CHAINS += [(a, b, 1) for a in CYRILLIC for b in ["cp1252", "mac_roman", *CYRILLIC] if a != b]
CHAINS += [(a, b, 1) for a in LATIN[:6] for b in LATIN[:6] if a != b]
CHAINS += [(a, b, 1) for a in EAST for b in ("cp1252", "cp1251", "mac_roman")]

TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 15
#: Weights of the character model's parts: trigrams, pairs, characters; and how many characters a script is taken to have.
MIX, CHARS = (0.7, 0.2, 0.1), 3_000
LOST = "\ufffd"
#: Posterior of damage above which a sentence is repaired; share of damage that rounds begin with; sentences that all cells lend to each.
SURE, START, POOL = 0.5, 0.01, 200
#: What characters that are new to the corpus can cost a chain at most, in all of a sentence.
NEWS = -20.0
#: Sentences judged at a time, and pieces that a model's counts are added up in.
BATCH, BLOCKS = 2048, 64

_SENTENCE = re.compile(r"[^\n\r]*?(?:[.!?:;](?=\s)|(?=[\n\r])|$)[ \t]*|[\n\r]+")
_TOKEN = re.compile(r"[\x40-\x7e\x80-\U0010ffff]*[\x80-\U0010ffff][\x40-\x7e\x80-\U0010ffff]*")
_ESCAPE = re.compile(r"&#(?:x[0-9a-fA-F]{2,5}|[0-9]{3,6});|&[A-Za-z]{2,8};|\\u[0-9a-fA-F]{4}|(?:%[89A-Fa-f][0-9A-Fa-f]){2,}")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")


def _byte_of(enc: str) -> dict[int, str]:
    """Non-ASCII character -> its byte as a Latin-1 character; bytes that the encoding leaves open stand for control characters."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(enc))] = chr(b)
        except UnicodeDecodeError:
            out[b] = chr(b)
    if enc == "cp1252":
        for b in range(128, 160):
            out.setdefault(b, chr(b))
    return out


class _Chain:
    def __init__(self, true: str, wrong: str, times: int) -> None:
        self.true, self.wrong, self.times = true, wrong, times
        self.east = wrong in EAST
        self.to = {} if self.east or not wrong else _byte_of(wrong)
        single = true not in ("", "utf8", *EAST)
        self.back = {}
        if single:
            for ch, b in self.to.items():
                try:
                    self.back[ch] = b.encode("latin-1").decode(true)
                except UnicodeDecodeError:
                    pass

    def undo(self, s: str) -> str:
        """The text that s was before, or s itself where the chain doesn't lead to it."""
        for _ in range(self.times):
            t = self._once(s)
            if t == s:
                return s
            s = t
        return s

    def _once(self, s: str) -> str:
        if self.back:
            if any(ord(c) > 127 and ord(c) not in self.back for c in s):
                return s
            return s.translate(self.back)
        if self.east:
            try:
                raw = s.encode(self.wrong, "replace" if LOST in s else "strict")
            except UnicodeEncodeError:
                return s
            t = raw.decode("utf-8", "replace")
            return s if t.count(LOST) > max(2, len(t) // 4) else t
        m = s.translate(self.to)
        if self.true == "utf8":
            parts, at = [], 0
            for k in _UTF8.finditer(m):
                a, b = k.span()
                if any(ord(s[i]) not in self.to for i in range(a, b)):
                    continue
                try:
                    c = k.group().encode("latin-1").decode("utf-8")
                except UnicodeDecodeError:
                    continue
                parts += [s[at:a], c]
                at = b
            return "".join(parts) + s[at:] if at else s
        if any(ord(c) > 127 and ord(c) not in self.to for c in s):
            return s
        try:
            return m.encode("latin-1").decode(self.true)
        except (UnicodeDecodeError, UnicodeEncodeError):
            return s


_chains: list[_Chain] = []


def chains() -> list[_Chain]:
    if not _chains:
        _chains.extend(_Chain(*c) for c in CHAINS)
    return _chains


def unescape(s: str) -> str:
    """Character references, \\u escapes and percent-encoded UTF-8 of characters beyond ASCII as characters; others stay."""

    def one(m: re.Match) -> str:
        e = m.group()
        if e[0] == "&":
            c = html.unescape(e)
            if e[1] == "#" and len(c) == 1:  # the standard maps references to C1 controls by cp1252
                n = int(e[3:-1], 16) if e[2] in "xX" else int(e[2:-1])
                c = chr(n) if 127 < n < 0x110000 else c
            return c if len(c) == 1 and ord(c) > 127 else e
        if e[0] == "%":
            try:
                return bytes.fromhex(e.replace("%", "")).decode("utf-8")
            except UnicodeDecodeError:
                return e
        n = int(e[2:], 16)
        return chr(n) if n > 127 and not 0xD800 <= n < 0xE000 else e

    return _ESCAPE.sub(one, s)


#: What a text must have to be looked at: characters beyond ASCII, or escapes of such.
_LOUD = r"[^\x00-\x7f]|&#|&[A-Za-z]{2,8};|\\u[0-9a-fA-F]{4}|%[89A-Fa-f][0-9A-Fa-f]"
#: A run of characters that damage and escapes can stand in.
_RUN = re.compile(rf"(?:{_ESCAPE.pattern}|[\x40-\x7e\x80-\U0010ffff])+")


def sentences(text: str) -> list[str]:
    return [m.group() for m in _SENTENCE.finditer(text) if m.group()]


def signature(sentence: str) -> str:
    """The words with characters beyond ASCII, escapes resolved, joined by a space; '' for none."""
    if "&" in sentence or "\\" in sentence or "%" in sentence:
        sentence = unescape(sentence)
    elif sentence.isascii():
        return ""
    return " ".join(_TOKEN.findall(sentence))


class Model:
    """Hashed counts of characters, their pairs, triples and triples of scripts, and how often each character stands in text without damage;
    all of fixed size, so they can be sent to all. shares: evidence by chain, and of how much."""

    def __init__(self, flat: np.ndarray, shares: np.ndarray) -> None:
        self.tri, self.bi, self.uni, self.scripts, clean = np.split(flat.astype(np.float32), np.cumsum([TRI, BI, UNI, N_SCRIPTS**3]))
        self.total = max(1.0, float(self.scripts.sum()))
        own = np.zeros(N_SCRIPTS)
        t = self.scripts.reshape((N_SCRIPTS,) * 3)
        own += t.sum((0, 2))
        self.own = np.maximum(own, 1.0)
        #: What it costs a chain to lead to a character that hardly stands anywhere but where this chain would lead.
        self.known = np.log((clean + 1e-3) / (clean + 5))
        self.shares, self.evidence = shares, shares.sum()

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word as a bag of trigrams, each drawn by its share of all: how often a form stands in the corpus
        counts, not how well it continues itself, or rare forms of damage would explain themselves. A trigram not met before
        is drawn by its scripts, and each character within its script. Every character is in three trigrams, hence the
        sum is halved: a third would take neighbours to tell nothing new."""
        first, tri, bi, chars, (x, y, z), script = grams(words)
        n = self.total
        ch = [(self.uni[i] + 0.1) / (self.own[k] + 0.1 * CHARS) for i, k in zip(chars, (x, y, z))]
        cls = (self.scripts[script] + 0.01) / n
        pair = np.minimum(1, self.bi[bi] / self.own[y])
        p = MIX[0] * self.tri[tri] / n + MIX[1] * cls * ch[0] * pair + MIX[2] * cls * ch[0] * ch[1] * ch[2]
        return np.add.reduceat(np.log(p.astype(np.float64)), first) / 2

    def prior(self, cells: np.ndarray) -> np.ndarray:
        """Log prior of chains for a sentence of each cell, whose evidence by chain is given: its share there, drawn towards the
        share over all cells. A sentence is no evidence for itself: one that names a chain is taken out of both."""
        one = np.arange(len(CHAINS)) > 0
        start = np.full(len(CHAINS), START / (len(CHAINS) - 1))
        start[0] = 1 - START
        whole = (np.maximum(self.shares - one, 0) + 10 * start) / (self.evidence + 10)
        p = (np.maximum(cells - one, 0) + POOL * whole) / (cells.sum(1, keepdims=True) + POOL)
        return np.log(np.maximum(p, 1e-12))


#: Where blocks of scripts begin; 0 is the edge of a word. ASCII letters are Latin like those beyond.
_BLOCKS = [(0, 0), (4, 1), (0x40, 2), (0x7F, 1), (0xA0, 3), (0xC0, 2), (0x250, 4), (0x370, 5), (0x400, 6), (0x530, 4), (0x2000, 3), (0x2500, 7), (0x2600, 3), (0x2E80, 8), (0x3040, 9), (0x3100, 8), (0xA000, 4), (0xE000, 1), (0xF900, 8), (0xFB00, 4), (0xFF00, 8), (0xFFF0, 1), (0x10000, 3), (0x20000, 8)]
N_SCRIPTS = 10
#: Characters whose clean text is counted one by one; those beyond share them.
ALPHABET = 1 << 17
SIZE = TRI + BI + UNI + N_SCRIPTS**3 + ALPHABET


_STARTS, _KINDS = np.array([x for x, _ in _BLOCKS]), np.array([x for _, x in _BLOCKS])


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(words: list[str]) -> tuple:
    """Of all words' trigrams one after another: where each word's begin, buckets of each trigram and pair, of the three
    characters, their scripts, and the bucket of the scripts. No word is empty."""
    c = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _KINDS[np.searchsorted(_STARTS, c, "right") - 1]
    k = np.where((c == 0xD7) | (c == 0xF7), 3, k)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(2 * np.arange(len(words)), size)  # two edges stand between words
    c = c.astype(np.uint64)
    m, s = np.uint64(0x9E3779B97F4A7C15), np.uint64(21)
    h = lambda v, size: ((v * m) >> np.uint64(65 - size.bit_length())).astype(np.int64)
    a, b, d = c[at], c[at + 1], c[at + 2]
    u = h(c + np.uint64(1), UNI)
    x, y, z = k[at], k[at + 1], k[at + 2]
    return first, h((a << s | b) << s ^ d * np.uint64(0x5851F42D4C957F2D), TRI), h(b << s | d, BI), (u[at], u[at + 1], u[at + 2]), (x, y, z), (x * N_SCRIPTS + y) * N_SCRIPTS + z


def count(words: list[str], weight: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The weighted words' part of a model's counts; clean is the part of each weight that stands for text without damage."""
    acc = np.zeros(SIZE)
    use = np.flatnonzero(weight > 1e-9)
    base = TRI + BI + UNI
    for i in range(0, len(use), 50_000):
        own = use[i : i + 50_000]
        part = [words[k] for k in own]
        first, tri, bi, u, _, script = grams(part)
        size = np.array([len(x) for x in part])
        wt = np.repeat(weight[own], size)
        last = np.append(first[1:], len(wt)) - 1
        letters = _codes(part).astype(np.int64) & ALPHABET - 1
        for at, k, v in ((0, tri, wt), (TRI, bi, wt), (TRI + BI, u[1], wt), (TRI + BI, u[0][first], wt[first]), (TRI + BI, u[2][last], wt[last]), (base, script, wt), (base + N_SCRIPTS**3, letters, np.repeat(clean[own], size))):
            acc += np.bincount(at + k, v, SIZE)
    return acc


class Words:
    """The words met in this worker, what each chain makes of them, and which characters it brings in. None of it depends on a model."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        #: of each word that was asked for: chains, their words, and the characters that are new, one after another with their number
        self.made: dict[int, tuple[np.ndarray, ...]] = {}

    def id(self, w: str) -> int:
        i = self.index.get(w)
        if i is None:
            i = self.index[w] = len(self.words)
            self.words.append(w)
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        """Ids of words, each of them asked for."""
        out = np.fromiter(map(self.id, words), np.int64, len(words))
        every = chains()
        for i in set(out.tolist()) - self.made.keys():
            w = self.words[i]
            own, old = [], set(w)
            for k in _possible(w):
                t = every[k].undo(w)
                if t != w:
                    own.append((k, self.id(t), [ord(c) & ALPHABET - 1 for c in set(t) - old if c > "\x7f"]))
            self.made[i] = (np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64), np.array([len(x[2]) for x in own], np.int64), np.array([c for x in own for c in x[2]], np.int64))
        return out


_masks: dict[str, tuple[int, int, int]] = {}


def _mask(c: str) -> tuple[int, int, int]:
    """Chains, as bits, that this character can stand in, that it can begin a UTF-8 sequence of, and that it can continue one of."""
    m = _masks.get(c)
    if m is None:
        a = b = d = 0
        o = ord(c)
        for i, x in enumerate(chains()):
            if not i:
                continue
            if x.east:
                a |= 1 << i
            elif x.true == "utf8":
                if o in x.to:
                    k = ord(x.to[o])
                    b |= (0xC2 <= k <= 0xF4) << i
                    d |= (0x80 <= k <= 0xBF) << i
            elif o in (x.back or x.to):
                a |= 1 << i
        m = _masks[c] = (a, b, d)
    return m


def _possible(w: str) -> list[int]:
    """Chains that may change the word: those all of its characters beyond ASCII can stand in, or of which a sequence begins somewhere."""
    every, some, before = -1, 0, 0
    for c in w:
        if c > "\x7f":
            a, b, d = _mask(c)
            every &= a
            some |= before & d
            before = b
        else:
            before = 0
    m = (every if every > 0 else 0) | some
    return [i for i in range(1, len(CHAINS)) if m >> i & 1]


class Judge:
    """Posteriors of chains for whole batches of signatures under one model."""

    def __init__(self, model: Model | None, words: Words) -> None:
        self.m, self.w, self.ll = model, words, np.zeros(0)

    def _expand(self, sigs: list[str]):
        """Of the signatures' words: signature, word, place; and of what chains make of them: word's row, chain, new word, new characters."""
        parts = [s.split(" ") for s in sigs]
        ids = self.w.ids([w for p in parts for w in p])
        n = np.array([len(p) for p in parts])
        sig = np.repeat(np.arange(len(sigs)), n)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        u, at = np.unique(ids, return_inverse=True)
        made = [self.w.made[i] for i in u.tolist()]
        size = np.array([len(x[0]) for x in made])
        chain, new, k, chars = (np.concatenate([x[j] for x in made]) if made else np.zeros(0, np.int64) for j in range(4))
        first = np.cumsum(size) - size
        reps = size[at]
        row = np.repeat(np.arange(len(ids)), reps)
        pick = np.repeat(first[at] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        return sig, ids, place, row, chain[pick], new[pick], (k, chars, pick)

    def plain(self, sigs: list[str]) -> tuple:
        """Weights of the signatures for the first model: little where a chain from UTF-8 accounts for every character."""
        sig, ids, _, row, chain, new, _ = self._expand(sigs)
        size = np.array([len(w) for w in self.w.words])
        less = np.bincount(sig[row] * len(CHAINS) + chain, size[ids[row]] - size[new], len(sigs) * len(CHAINS)).reshape(len(sigs), -1)
        beyond = np.array([sum(c > "\x7f" for c in s) for s in sigs]) / 2.01
        utf8 = np.array([c[0] == "utf8" and c[2] == 1 for c in CHAINS])
        p = np.zeros((len(sigs), len(CHAINS)))
        p[:, 0] = np.where((less[:, utf8] >= beyond[:, None]).any(1), 0.01, 1.0)
        return p, sig, ids, row[:0], chain[:0], new[:0]

    def posterior(self, sigs: list[str], prior: np.ndarray) -> tuple:
        """(posterior by signature and chain, and the expansion). Chains of one outcome are one: the one of the greatest prior."""
        sig, ids, place, row, chain, new, (k, chars, pick) = self._expand(sigs)
        have = len(self.ll)
        if have < len(self.w.words):
            fresh = self.w.words[have:]
            self.ll = np.concatenate([self.ll, *[self.m.score(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]])
        n, c = len(sigs), len(CHAINS)
        key = sig[row] * c + chain
        base = np.bincount(sig, self.ll[ids], n)
        gain = np.bincount(key, self.ll[new] - self.ll[ids[row]], n * c)
        cost = np.bincount(np.repeat(np.arange(len(k)), k), self.m.known[chars], len(k)) if len(k) else np.zeros(0)
        gain += np.maximum(np.bincount(key, cost[pick], n * c), NEWS)
        x = base[:, None] + gain.reshape(n, c) + prior
        changed = np.zeros(n * c, bool)
        changed[key] = True
        x[:, 1:][~changed.reshape(n, c)[:, 1:]] = -np.inf
        # outcomes by a hash of their words and places
        mix = lambda a, b: (a + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b + 7).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        spin = lambda v: (v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out = np.zeros(n * c, np.uint64)
        np.add.at(out, key, spin(mix(new, place[row])) - spin(mix(ids[row], place[row])))
        some = np.flatnonzero(changed)
        o = np.lexsort((-prior.reshape(-1)[some], out[some], some // c))
        s, h = some[o] // c, out[some[o]]
        again = np.zeros(len(o), bool)
        again[1:] = (s[1:] == s[:-1]) & (h[1:] == h[:-1])
        x.reshape(-1)[some[o][again]] = -np.inf
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), sig, ids, row, chain, new


def _cell_columns(source: str, field: str) -> list:
    return [F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("src"), F.coalesce(F.col(field).cast("string"), F.lit("\0")).alias("knd")]


def _sigs(df: DataFrame, text: str, cell: list) -> DataFrame:
    """(src, knd, sig, n): distinct evidence with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple, int] = {}
            for s, k, t in zip(*(c.to_pylist() for c in b.columns)):
                for x in _SENTENCE.findall(t):
                    if g := signature(x):
                        n[s, k, g] = n.get((s, k, g), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in n], pa.string()) for i in range(3)] + [pa.array(list(n.values()), pa.int64())], ["src", "knd", "sig", "n"])

    d = wide(df.select(*cell, F.col(text).alias("_text"))).where(F.col("_text").rlike(_LOUD))
    return d.mapInArrow(run, "src string, knd string, sig string, n long").groupBy("src", "knd", "sig").agg(F.sum("n").alias("n"))


_PRIOR, _WHOLE = -1, -2


def _sum_rows(size: int):
    """Sums the vectors of a group, which come whole (no places) or as places and values."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(size)
        for a, w in zip(g["at"], g["w"]):
            v = np.frombuffer(w, np.float64)
            if a:
                acc[np.frombuffer(a, np.int32)] += v
            else:
                acc += v
        return pd.DataFrame({**{c: [x] for c, x in zip(g.columns, key)}, "w": [acc.tobytes()]})

    return run


def fit(sigs: DataFrame, settled: float = 0.01, most: int = 12) -> tuple[Model, DataFrame]:
    """Expectation-maximization over the distinct signatures: the model, of fixed size, and (src, knd, prior), the evidence by chain of each cell.

    Priors stay a table that is joined to the signatures, so there may be any number of sources and kinds. Rounds end when the
    evidence for damage changes by less than `settled` of itself; if `most` rounds don't settle it, a warning says so.
    """
    spark = sigs.sparkSession
    k = len(CHAINS)
    model, priors, last = None, None, None
    for r in range(most):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], r: int = r, shared=shared) -> Iterator[pd.DataFrame]:
            model = shared.value
            words = Words()
            judge = Judge(model, words)
            acc, whole, cells = np.zeros(SIZE), np.zeros(k), {}
            weight, clean = np.zeros(0), np.zeros(0)
            for b in batches:
                for i in range(0, len(b), BATCH):
                    p = b.iloc[i : i + BATCH]
                    own = p.sig.tolist()
                    n = p.n.to_numpy(np.float64)
                    if r:
                        q, sig, ids, row, chain, new = judge.posterior(own, model.prior(_vectors(p.prior)))
                        whole += q.sum(0)
                        for key, v in zip(zip(p.src, p.knd), q):
                            cells[key] = cells[key] + v if key in cells else v
                    else:
                        q, sig, ids, row, chain, new = judge.plain(own)
                    more = len(words.words) - len(weight)
                    weight, clean = np.concatenate([weight, np.zeros(more)]), np.concatenate([clean, np.zeros(more)])
                    moved = n[sig[row]] * q[sig[row], chain]
                    weight += np.bincount(ids, (n * q.sum(1))[sig], len(weight)) - np.bincount(ids[row], moved, len(weight)) + np.bincount(new, moved, len(weight))
                    clean += np.bincount(ids, (n * q[:, 0])[sig], len(weight))
                    if len(words.words) > 400_000:
                        acc += count(words.words, weight, clean)
                        words = Words()
                        judge = Judge(model, words)
                        weight, clean = np.zeros(0), np.zeros(0)
                if len(cells) > 50_000:
                    yield _prior_rows(cells)
                    cells = {}
            acc += count(words.words, weight, clean)
            rows = []
            for x in range(BLOCKS):
                part = acc[x * SIZE // BLOCKS : (x + 1) * SIZE // BLOCKS]
                at = np.flatnonzero(part)
                rows.append(("", "", x, at.astype(np.int32).tobytes() or b"", part[at].tobytes()))
            rows = [x for x in rows if x[4]] + [("", "", _WHOLE, b"", whole.tobytes())]
            yield pd.DataFrame(rows, columns=["src", "knd", "block", "at", "w"])
            if cells:
                yield _prior_rows(cells)

        seen = sigs.withColumn("prior", F.lit(None).cast("binary")) if priors is None else sigs.join(priors, ["src", "knd"], "left")
        got = stage(seen.mapInPandas(run, "src string, knd string, block int, at binary, w binary"), "em")
        flat, shares = np.zeros(SIZE), np.zeros(k)
        # BLOCKS pieces of a vector of fixed size, added up by block
        for x in got.where("block >= 0").select("block", "at", "w").groupBy("block").applyInPandas(_sum_rows(-(-SIZE // BLOCKS)), "block int, w binary").collect():
            a, z = x.block * SIZE // BLOCKS, (x.block + 1) * SIZE // BLOCKS
            flat[a:z] = np.frombuffer(x.w, np.float64)[: z - a]
        for x in got.where(f"block = {_WHOLE}").select("w").groupBy(F.lit(0).alias("g")).agg(F.collect_list("w").alias("w")).collect():  # a row for each task of the stage
            shares = sum((np.frombuffer(v, np.float64) for v in x.w), shares)
        model = Model(flat, shares)
        if r:
            new = got.where(f"block = {_PRIOR}").select("src", "knd", "at", "w").groupBy("src", "knd").applyInPandas(_sum_rows(k), "src string, knd string, w binary")
            if priors is not None:
                drop(priors)
            priors = stage(new.withColumnRenamed("w", "prior"), "priors")
        drop(got)
        bad = shares[1:].sum()
        if r > 1 and abs(bad - last) <= settled * max(bad, 1.0):
            break
        last = bad
    else:
        warnings.warn(f"encodings have not settled in {most} rounds")
    return model, priors


def _prior_rows(cells: dict) -> pd.DataFrame:
    return pd.DataFrame([(*key, _PRIOR, b"", v.tobytes()) for key, v in cells.items()], columns=["src", "knd", "block", "at", "w"])


def _vectors(raw) -> np.ndarray:
    """Evidence by chain of each row's cell, zeros where it has none."""
    none = np.zeros(len(CHAINS)).tobytes()
    return np.frombuffer(b"".join(none if x is None or x != x else x for x in raw), np.float64).reshape(len(raw), len(CHAINS))


def restore(sentence: str, chain: _Chain) -> str:
    """The sentence with its damaged runs undone. Escapes are resolved only where the chain changes what they stand for."""

    def one(m: re.Match) -> str:
        raw = m.group()
        if raw.isascii() and not _ESCAPE.search(raw):
            return raw
        u = unescape(raw)
        t = _TOKEN.sub(lambda x: chain.undo(x.group()), u)
        return raw if t == u else t

    return _RUN.sub(one, sentence)


def repair(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", field: str = "kind") -> DataFrame:
    """(id, text, damaged, chains) of every row: the text restored as far as it can be, other texts unchanged.

    Null and empty texts come out as they are, undamaged. Characters already lost (U+FFFD) make a text damaged and stay. Repeated
    ids keep their rows; null sources and fields are sources of their own. An empty table gives an empty result.

    A sentence is repaired if its posterior of having been damaged is above a half, by the most likely chain that changes it. Texts stay where they
    are read: only the cells' priors are joined to them.
    """
    cell = _cell_columns(source, field)
    sigs = stage(_sigs(df, text, cell).repartition(cores(df.sparkSession), "sig"), "sigs")
    model, priors = fit(sigs)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, judge, known = shared.value, None, {}
        for b in batches:
            ids, texts, prior = b.column(0), b.column(1), b.column(2)
            quiet = pc.fill_null(pc.invert(pc.match_substring_regex(texts, _LOUD)), True).to_numpy(zero_copy_only=False)
            out, bad, met = texts.to_pylist(), np.zeros(len(ids), bool), [""] * len(ids)
            loud = np.flatnonzero(~quiet)
            cells = [prior[i].as_py() for i in loud]
            cut = [[(s, signature(s)) for s in _SENTENCE.findall(out[i])] for i in loud]
            ask = list(dict.fromkeys((g, c) for x, c in zip(cut, cells) for _, g in x if g and (g, c) not in known))
            for i in range(0, len(ask), BATCH):
                if judge is None or len(judge.w.words) > 400_000:
                    judge = Judge(model, Words())
                part = ask[i : i + BATCH]
                q = judge.posterior([g for g, _ in part], model.prior(_vectors([c for _, c in part])))[0]
                best = np.where(1 - q[:, 0] > SURE, q[:, 1:].argmax(1) + 1, 0)
                known.update(zip(part, best.tolist()))
            for i, c, x in zip(loud, cells, cut):
                hit, parts = [], []
                for s, g in x:
                    if LOST in s or LOST in g:
                        bad[i] = True
                    if g and (k := known[g, c]):
                        hit.append(k)
                        s = restore(s, chains()[k])
                    parts.append(s)
                if hit:
                    bad[i] = True
                    out[i] = "".join(parts)
                    met[i] = ",".join(f"{CHAINS[k][0]}>{CHAINS[k][1]}" + (f"*{CHAINS[k][2]}" if CHAINS[k][2] > 1 else "") for k in dict.fromkeys(hit))
            if len(known) > 300_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), pa.array(bad), pa.array(met, pa.string())], [id, "text", "damaged", "chains"])

    d = wide(df.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *cell))
    d = (d.join(priors, ["src", "knd"], "left") if priors is not None else d.withColumn("prior", F.lit(None).cast("binary"))).select("_id", "_text", "prior")
    return d.mapInArrow(run, f"{id} {kind}, text string, damaged boolean, chains string")
