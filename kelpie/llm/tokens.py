"""Byte-pair encoding of a whole corpus with a public tokenizer's vocabulary, in numpy.

Texts are cut by the tokenizer's pattern; a worker encodes each distinct piece once and remembers a bounded number of them.
Pieces of like length form a padded matrix of ids. In every round each row merges its leftmost pair of minimum rank, found
through an open-addressing hash table of pairs; rows without a pair left are taken out. Pieces beyond the longest bucket
(runs without white space) take the same steps over a linked list with a heap, so their cost stays near linear."""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"
_NONE = np.int32(2**31 - 1)
_LONGEST = 128  # bytes of the longest matrix row
_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Bpe:
    """Merge tables of a byte-level vocabulary. They are a few MB whatever the corpus and travel by broadcast."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.byte_ids = byte_ids
        bits = 1
        while 1 << bits < 3 * max(len(left), 1):
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        key = (left.astype(np.int64) << 32) | right
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at] == -1
            lead = np.zeros(len(todo), bool)
            lead[np.unique(at, return_index=True)[1]] = True  # one pair a slot, the first one
            put = free & lead
            self.keys[at[put]], self.rank[at[put]], self.made[at[put]] = key[todo[put]], todo[put], made[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of the merge of each pair; rank _NONE where there is none. Negative ids are padding."""
        shape, a, b = a.shape, a.ravel(), b.ravel()
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(key)
        held = self.keys[at]
        wait = np.flatnonzero((held != key) & (held != -1))
        while len(wait):
            at[wait] = (at[wait] + 1) & self.mask
            held = self.keys[at[wait]]
            wait = wait[(held != key[wait]) & (held != -1)]
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE).reshape(shape), self.made[at].reshape(shape)

    @staticmethod
    def load(path: str = DEFAULT) -> Bpe:
        """From a tokenizer file (.json, with merges) or a rank file (.tiktoken)."""
        if path.endswith(".tiktoken"):
            ranks = {}
            for line in open(path, "rb"):
                if line.strip():
                    token, n = line.split()
                    ranks[base64.b64decode(token)] = int(n)
            byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
            rows = []
            for token, n in sorted(ranks.items(), key=lambda x: x[1]):
                if len(token) > 1 and (parts := _parts(token, ranks, n)):
                    rows.append((ranks[parts[0]], ranks[parts[1]], n))
            left, right, made = np.array(rows, np.int32).reshape(-1, 3).T
            return Bpe(byte_ids, left, right, made)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
        return Bpe(np.array([vocab[c] for c in byte_letters()], np.int32), left, right, made)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        out: list[list[int]] = [[] for _ in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width, lo = 4, 1
        while lo <= _LONGEST:
            at = np.flatnonzero((size >= lo) & (size <= width))
            for k in range(0, len(at), 65_536):
                self._matrix(at[k : k + 65_536], pieces, size, width, out)
            lo, width = width + 1, width * 2
        for i in np.flatnonzero(size > _LONGEST):
            out[i] = self._long(pieces[i])
        return out

    def _matrix(self, at: np.ndarray, pieces: list[bytes], size: np.ndarray, width: int, out: list[list[int]]) -> None:
        if not len(at):
            return
        n, have = len(at), size[at]
        there = np.arange(width)[None] < have[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[there] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in at]), np.uint8)]
        rank, made = self.pairs(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width)
        while len(at):
            best = rank.argmin(1)  # the leftmost of the least
            row = np.arange(len(at))
            go = rank[row, best] != _NONE
            if not go.all():
                for i, r, h in zip(at[~go].tolist(), ids[~go].tolist(), have[~go].tolist()):
                    out[i] = r[:h]
                at, ids, rank, made, have, best = at[go], ids[go], rank[go], made[go], have[go], best[go]
                if not len(at):
                    return
                row = np.arange(len(at))
            new = made[row, best]
            wide = cols[None] + (cols[None] > best[:, None])  # what stands right of the pair moves left
            wide[:, -1] = width - 1
            ids = np.take_along_axis(ids, wide, 1)
            ids[row, best] = new
            have = have - 1
            ids[row, have] = -1
            gap = cols[None, :-1] + (cols[None, :-1] > best[:, None])
            gap = np.minimum(gap, width - 2)
            rank, made = np.take_along_axis(rank, gap, 1), np.take_along_axis(made, gap, 1)
            rank[row, np.maximum(have - 1, 0)] = _NONE
            if width > 2:
                right = np.minimum(best, width - 2)
                rank[row, right], made[row, right] = self.pairs(ids[row, right], ids[row, right + 1])
                left = np.maximum(best - 1, 0)
                rank[row, left], made[row, left] = self.pairs(ids[row, left], ids[row, left + 1])

    def _long(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].copy()
        n = len(ids)
        rank, made = self.pairs(ids[:-1], ids[1:])
        seq, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b, m) for i, (r, a, b, m) in enumerate(zip(rank.tolist(), seq, seq[1:], made.tolist())) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int) -> None:
            j = nxt[i]
            if i < 0 or j >= n:
                return
            pair = (seq[i], seq[j])
            if (got := known.get(pair)) is None:
                r, m = self.pairs(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))
                got = known[pair] = (int(r[0]), int(m[0]))
            if got[0] != _NONE:
                heapq.heappush(heap, (got[0], i, *pair, got[1]))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if seq[i] != a or j >= n or seq[j] != b:
                continue  # one of the two was merged meanwhile
            seq[i], seq[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [x for x in seq if x >= 0]


def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes] | None:
    """The two tokens whose merge makes `token`: what its bytes come to under the merges of lower rank."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        rank, i = min(((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
        if rank >= below:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Encoder:
    """Encodes texts; remembers the pieces met so far, at most `memory` of them."""

    def __init__(self, bpe: Bpe, memory: int = 200_000):
        import regex

        self.bpe, self.memory, self.known = bpe, memory, {}
        self.cut = regex.compile(PATTERN).findall

    def batch(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text, all of them known afterwards."""
        cut = [self.cut(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.memory:
                self.known, new = {}, set(chain.from_iterable(cut))
            new = sorted(new)
            self.known.update(zip(new, self.bpe.encode([p.encode("utf-8", "surrogatepass") for p in new])))
        return cut

    def ids(self, texts: list[str | None]) -> pa.Array:
        cut = self.batch(texts)
        per = [list(chain.from_iterable(map(self.known.__getitem__, c))) for c in cut]
        return pa.array(per, pa.list_(pa.int32()))

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = self.batch(texts)
        return [sum(map(len, map(self.known.__getitem__, c))) for c in cut]


_TEXTS = 512  # texts encoded together


def _over(df: DataFrame, id_col: str, text: str, path: str, what: str, schema: str, extra: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Bpe.load(path))  # the vocabulary's size, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, _TEXTS):
                part = b.slice(lo, _TEXTS)
                texts = part.column(1).to_pylist()
                got = enc.ids(texts) if what == "ids" else pa.array(enc.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], got], [id_col, *extra, what])

    return df.select(id_col, text, *extra).mapInArrow(run, schema)


def encode(df: DataFrame, id_col: str, text: str, path: str = DEFAULT) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens (their strings are ordinary text).

    An empty and a null text have an empty list; a blank one has the ids of its white space. Texts of any length are encoded
    whole. One row per input row, repeated and null ids included; other columns are ignored."""
    kind = dict(df.dtypes)[id_col]
    return _over(df, id_col, text, path, "ids", f"`{id_col}` {kind}, ids array<int>", [])


def count(df: DataFrame, id_col: str, text: str, extra: list[str], path: str = DEFAULT) -> DataFrame:
    """(id, *extra, n_tokens): the number of tokens of every text; 0 for an empty and for a null one."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *extra]) + ", n_tokens bigint"
    return _over(df, id_col, text, path, "n_tokens", schema, extra)
