"""Encoding by a public byte-level BPE vocabulary, in length-bucketed padded numpy matrices.

A batch's texts are cut into pieces by the tokenizer's pattern. Pieces not met before in this worker are put as rows of byte ids
into matrices of one width class; in every round each row merges its leftmost pair of minimum rank, found by a hashed pair
table, and all rows shrink by one column; wide rows merge all places of that pair. Rows without a mergeable pair leave. Encoded pieces stay in a bounded cache.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import wide

#: Folder of the public tokenizers' files; a parameter of every call.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
NO_RANK = np.int32(2**31 - 1)
CACHE = 400_000
#: Width from which a row merges all places of its minimum pair in one round.
WIDE = 192
#: Characters of text handled at a time.
CHUNK = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class PairTable:
    """(left id, right id) -> (rank, merged id) in an open-addressing table that numpy looks up for whole matrices."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = int(np.ceil(np.log2(len(left) * 5 + 1)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.merged = merged.astype(np.int32)
        key = left.astype(np.int64) << 20 | right
        todo = np.arange(len(key))
        slot = self._slot(key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(s[free], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]], self.rank[slot[won]] = key[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = slot[todo] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where there is none or a side is padding (-1)."""
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.full(key.shape, NO_RANK, np.int32)
        open_ = None
        for p in range(self.probes):
            at = slot + p & self.mask
            hit = self.keys[at] == key
            if open_ is None:
                out[hit] = self.rank[at[hit]]
                idx = np.flatnonzero(~hit & (self.keys[at] >= 0))
                if not len(idx):
                    break
                flat, open_ = out.reshape(-1), idx
                slot, key = slot.reshape(-1)[idx], key.reshape(-1)[idx]
            else:
                flat[open_[hit]] = self.rank[at[hit]]
                go = ~hit & (self.keys[at] >= 0)
                if not go.any():
                    break
                open_, slot, key = open_[go], slot[go], key[go]
        return out


class Encoder:
    """Encodes texts with a byte-level BPE vocabulary file; special tokens' names are ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        import regex

        model = json.load(open(os.path.join(folder, f"{name}.json"), encoding="utf-8"))
        vocab = model["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int32)
        right = np.array([vocab[b] for _, b in merges], np.int32)
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.table = PairTable(left, right, merged)
        made = {int(m): i for i, m in enumerate(merged)}
        #: All places of a pair may merge at once if no pair ranks before the merge that makes a side of it.
        self.ordered = len(made) == len(merges) and all(made.get(int(x), -1) < i for i, (a, b) in enumerate(zip(left, right)) for x in (a, b))
        alphabet = byte_alphabet()
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        self.cut = regex.compile(_pattern(model)).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after another); null and empty texts have none."""
        sizes, parts = [], []
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b] or "") <= CHUNK):
                n += len(texts[b] or "")
                b += 1
            s, i = self._encode(texts[a:b])
            sizes.append(s)
            parts.append(i)
            a = b
        return (np.concatenate(sizes), np.concatenate(parts)) if sizes else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE:
            self._reset()
        words, per = [], []
        for t in texts:
            w = self.cut(t) if t else []
            words += w
            per.append(len(w))
        index = self.index
        fresh = [w for w in dict.fromkeys(words) if w not in index]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        n = self.size[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])
        return np.diff(ends[np.concatenate([[0], np.cumsum(per)]).astype(np.int64)]), ids

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        lens = np.array([len(r) for r in raw])
        base, rows = len(self.index), [None] * len(raw)
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            step = max(1, (1 << 21) // int(w))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                merge = self._wide if w > WIDE and self.ordered else self._rows
                for i, r in zip(part, merge([raw[i] for i in part], lens[part])):
                    rows[i] = r
        for i, w in enumerate(fresh):
            self.index[w] = base + i
        size = np.array([len(r) for r in rows], np.int64)
        need = self.used + int(size.sum())
        if need > len(self.flat):
            grown = np.zeros(max(need, 2 * len(self.flat)), np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : need] = np.concatenate(rows)
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used = need

    def _rows(self, raw: list[bytes], lens: np.ndarray) -> list[np.ndarray]:
        """The matrix rounds: every row merges its leftmost minimum-rank pair, then all close up by a column."""
        n, width = len(raw), int(lens.max())
        m = np.full((n, width), -1, np.int32)
        m[np.arange(width) < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        row, out = np.arange(n), [None] * n
        rank = self.table.ranks(m[:, :-1], m[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while True:
            if rank.shape[1]:
                j = rank.argmin(1)
                best = rank[np.arange(len(m)), j]
                stay = best < NO_RANK
            else:
                stay = np.zeros(len(m), bool)
            if not stay.all():
                for r, ids in zip(row[~stay], m[~stay]):
                    out[r] = ids[ids >= 0]
                if not stay.any():
                    return out
                row, m, rank, j, best = row[stay], m[stay], rank[stay], j[stay], best[stay]
            k, w = np.arange(len(m)), m.shape[1]
            m[k, j] = self.table.merged[best]
            keep = np.ones(m.shape, bool)
            keep[k, j + 1] = False
            m = m[keep].reshape(len(m), w - 1)
            rank = rank[keep[:, 1:]].reshape(len(m), w - 2)
            for at in (j - 1, j):
                ok = (at >= 0) & (at < w - 2)
                r, c = k[ok], at[ok]
                rank[r, c] = self.table.ranks(m[r, c], m[r, c + 1])

    def _wide(self, raw: list[bytes], lens: np.ndarray) -> list[np.ndarray]:
        """The same for wide rows: a round merges all places of a row's minimum pair, leftmost first where they overlap, and rows close up."""
        n, width = len(raw), int(lens.max())
        m = np.full((n, width), -1, np.int32)
        m[np.arange(width) < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        row, out = np.arange(n), [None] * n
        while True:
            rank = self.table.ranks(m[:, :-1], m[:, 1:])
            best = rank.min(1, initial=NO_RANK)
            stay = best < NO_RANK
            for r, ids in zip(row[~stay], m[~stay]):
                out[r] = ids[ids >= 0]
            if not stay.any():
                return out
            row, m, rank, best = row[stay], m[stay], rank[stay], best[stay]
            k, at = np.nonzero(rank == best[:, None])
            place = k * (m.shape[1] + 1) + at
            run = np.cumsum(np.concatenate([[0], np.diff(place) > 1]))
            use = (place - place[np.searchsorted(run, run)]) % 2 == 0
            k, at = k[use], at[use]
            m[k, at] = self.table.merged[best[k]]
            keep = m >= 0
            keep[k, at + 1] = False
            size = keep.sum(1)
            new = np.full((len(m), int(size.max())), -1, np.int32)
            new[np.arange(new.shape[1]) < size[:, None]] = m[keep]
            m = new


def _pattern(model: dict) -> str:
    """Fixed value: the public pattern that byte-level vocabularies of this family cut texts by."""
    pre = model.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("not a byte-level vocabulary without a prefix space")
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str) -> Encoder:
    if (name, folder) not in _encoders:
        _encoders[name, folder] = Encoder(name, folder)
    return _encoders[name, folder]


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of every row: the text's token ids, an empty list for an empty or null text. No text is trimmed or changed.

    Rows with a null or repeated id keep their row. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for b in batches:
            n, ids = e.encode(b.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(n)])
            for a, z in _pieces(ends, 1 << 24):
                off = (ends[a : z + 1] - ends[a]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.ListArray.from_arrays(pa.array(off), pa.array(ids[ends[a] : ends[z]]))], [id, "ids"])

    src = wide(df.select(F.col(id), F.col(text).alias("_text")))
    return src.mapInArrow(run, f"{id} {df.schema[id].dataType.simpleString()}, ids array<int>")


def _pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a, n = 0, len(ends) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, z
        a = z


def token_counts(df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens) of every row; 0 for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.encode(b.column(1).to_pylist())[0], pa.int64())], [id, "n_tokens"])

    src = wide(df.select(F.col(id), F.col(text).alias("_text")))
    return src.mapInArrow(run, f"{id} {df.schema[id].dataType.simpleString()}, n_tokens long")
