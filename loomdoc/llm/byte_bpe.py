"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash (compress, hash, displace) resolves whole pre-tokens that the vocabulary has; for the others a
heap over linked bytes pops the lowest-ranked adjacent pair until none is left.

Cases. Null or empty text: no ids, the digests of the empty string. Very long texts and pre-tokens: the heap keeps a
merge at O(log n). Ties cannot happen: ranks are unique and equal pairs merge from the left. Repeated rows and extra
columns: each row stands for itself, other columns pass through unread.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, SparkSession

from loomdoc.llm.common import Memo, per_text

M64 = (1 << 64) - 1
_loaded: dict[str, ByteBpe] = {}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots, one displacement for each bucket of about two keys."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = m = max(1, n // 2)
        hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(m)]
        for i, h in enumerate(hashed):
            groups[(h & 0xFFFFFFFF) * m >> 32].append(i)
        self.shift, self.slots = [0] * m, [-1] * n
        free = n
        for b in sorted(range(m), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # any free slot will do; a negative displacement names it
                while self.slots[free - 1] >= 0:
                    free -= 1
                self.shift[b], self.slots[free - 1] = -free, group[0]
                continue
            d = 0
            while True:
                places = [self._place(hashed[i], d) for i in group]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p, i in zip(places, group, strict=True):
                self.slots[p] = i
        self.keys = [keys[i] for i in self.slots]

    def _place(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & M64
        x = (x ^ (x >> 31)) * 0xD6E8FEB86659FD93 & M64
        return (x >> 32) * self.n >> 32

    def get(self, key: bytes) -> int:
        """The key's index, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) * self.buckets >> 32]
        p = self._place(h, d) if d >= 0 else -d - 1
        return self.slots[p] if self.keys[p] == key else -1


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None):
        self.ranks = ranks
        self.words = list(ranks)
        self.ids = list(ranks.values())
        self.whole = whole or PerfectHash(self.words)
        self.by_id = {i: w for w, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.memo = Memo(self.pre_token)

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token by a heap over linked bytes."""
        ranks = self.ranks
        n = len(word)
        sym: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = word[i : i + 2]
            r = ranks.get(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            left, j = sym[i], nxt[i]
            if left is None or j >= n or len(left) + len(sym[j]) != len(pair) or left + sym[j] != pair:
                continue
            sym[i], sym[j] = pair, None
            j = nxt[i] = nxt[j]
            p = prv[i]
            if p >= 0:
                joined = sym[p] + pair
                r = ranks.get(joined)
                if r is not None:
                    heappush(heap, (r, p, joined))
            if j < n:
                prv[j] = i
                joined = pair + sym[j]
                r = ranks.get(joined)
                if r is not None:
                    heappush(heap, (r, i, joined))
        return [ranks[s] for s in sym if s is not None]

    def pre_token(self, word: str) -> bytes:
        """Ids of a pre-token, packed as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        at = self.whole.get(raw)
        if at >= 0:
            return struct.pack("<I", self.ids[at])
        ids = self.merged(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _codec(spark: SparkSession, ranks_path: str, pattern: str):
    ranks = load_ranks(ranks_path)
    whole = PerfectHash(list(ranks))
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((ranks, pattern, whole, key))

    def codec() -> ByteBpe:
        ranks, pattern, whole, key = shared.value
        if key not in _loaded:
            _loaded[key] = ByteBpe(ranks, pattern, whole)
        return _loaded[key]

    return codec


def encoded(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """A binary column: each whole text's ids as little-endian unsigned 32-bit integers."""
    codec = _codec(spark, ranks_path, pattern)
    return per_text(text, lambda: codec().encode, "binary")


def round_trip(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256): the text is encoded and the ids decoded again."""
    codec = _codec(spark, ranks_path, pattern)

    def make():
        bpe = codec()

        def run(text: str):
            ids = bpe.encode(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return run

    return per_text(text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
