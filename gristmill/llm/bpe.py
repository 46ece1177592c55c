"""Problem 8: exact byte-level BPE in linear time, by automaton matches and backtracking."""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gristmill.session import spread, table

#: Fixed values of the public byte-level format: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by a worker before it forgets them all.
MEMO = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """Character -> byte of the vocabulary file: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encodes a pre-token by longest matches; a token is taken only if no merge would have joined it to its neighbour.

    Whether two adjacent tokens may stand side by side depends only on them, so the answer is remembered. A match
    that fits nowhere is replaced by its next shorter prefix, and a position found hopeless is never tried again:
    the work is linear in the length of the text whatever it holds.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = printable_bytes()
        latin = lambda s: bytes(byte[c] for c in s).decode("latin-1")
        self.vocab = {latin(s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}
        self.size = max(self.vocab.values()) + 1
        self.length = [0] * self.size
        for s, i in self.vocab.items():
            self.length[i] = len(s)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = self.vocab[latin(a)], self.vocab[latin(b)]
            z = self.vocab[latin(a + b)]
            self.rank.setdefault((x, y), r)
            self.made.setdefault(z, (x, y, r))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def fits(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Undo the later-made of the two tokens step by step; they clash if a pair on the border merges earlier."""
        top = len(self.rank)
        limit = top
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra = self.made[a][2] if a in self.made else -1
            rb = self.made[b][2] if b in self.made else -1
            if ra < 0 and rb < 0:
                return True
            # of two merges of equal rank the left one happens first, so the right one is undone first
            if ra > rb:
                limit, a = ra, self.made[a][1]
            else:
                limit, b = rb + 1, self.made[b][0]
            # a border pair made before `limit` would have formed before the undone token did

    def encode_word(self, word: str) -> tuple[int, ...]:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.vocab.get(s)
        if whole is not None and (len(s) == 1 or self._reachable(whole)):
            return (whole,)
        n = len(s)
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(s):
            at[end - self.length[token] + 1].append(token)  # ends rise, so shorter tokens come first
        out: list[int] = []
        tries: list[int] = []
        dead = bytearray(n + 1)
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            here = at[pos]
            while k >= 0:
                token = here[k]
                end = pos + self.length[token]
                if not dead[end] and self._reachable(token) and (not out or self.fits(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tries.append(k)
                pos = end
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                pos -= self.length[out.pop()]
                k = tries.pop() - 1
        return tuple(out)

    def _reachable(self, token: int) -> bool:
        """Whether merging its own bytes yields this token: its two parts must stand side by side."""
        key = (-1, token)
        got = self.pairs.get(key)
        if got is None:
            m = self.made.get(token)
            got = True if m is None else self._reachable(m[0]) and self._reachable(m[1]) and self._joins(m[0], m[1], m[2])
            self.pairs[key] = got
        return got

    def _joins(self, a: int, b: int, rank: int) -> bool:
        """Like fits(), for merges that come before the one which joins a and b."""
        limit = rank
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra = self.made[a][2] if a in self.made else -1
            rb = self.made[b][2] if b in self.made else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.made[a][1]
            else:
                limit, b = rb + 1, self.made[b][0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo, add = self.memo, out.extend
        for w in self.split(text):
            ids = memo.get(w)
            if ids is None:
                if len(memo) > MEMO:
                    memo.clear()
                ids = self.encode_word(w)
                if len(w) <= 64:
                    memo[w] = ids
            add(ids)
        return out


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def encode_table(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row. Null and empty texts give an empty list; strings of special tokens are
    plain text; blank and very long texts are encoded like any other. Repeated rows stay repeated, other columns
    are not read. The vocabulary's path must be readable on every executor."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                b = batch.slice(part, 1000)
                flat: list[np.ndarray] = []
                offsets = np.zeros(b.num_rows + 1, np.int32)
                for i, t in enumerate(b.column(1)):
                    ids = np.array(enc.encode(t.as_py() or ""), np.int32)
                    flat.append(ids)
                    offsets[i + 1] = offsets[i] + len(ids)
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
