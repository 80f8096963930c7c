"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only lengths decide: a histogram of piece lengths (at most `capacity` numbers, whatever the data's size) goes to the
driver, which packs all pieces at once. Pieces above a third of the capacity are matched greedily, the largest with the
largest that fits, so at most two share a sequence; smaller ones then go, longest first, to the smallest gap that holds
them. The plan is a list of runs; each piece finds its own place from its length and its rank among that length.

Cases. Null or empty text: one piece, the end token. Documents longer than the capacity: cut into full pieces, the last
may be shorter. Empty table: no rows. Repeated rows: each is packed. Ties (equal lengths): ranked by doc_id, piece and ids
within a hash bucket, so a hot length is spread over many tasks. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from loomdoc.llm.common import arrow_type, slices, staged

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
#: Pre-tokenisers whose matches never hold white space, so that ids of a text are those of its stretches.
SPACELESS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
#: Words of ASCII letters, and ASCII marks after them.
PLAIN = re.compile(r"([A-Za-z]+)([!-/:-@\[-`{-~]*)").fullmatch
_loaded: dict[str, WordTokenizer] = {}


def splits_at_spaces(rules: dict) -> bool:
    """Whether the tokenizer's rules never join, nor look at, anything over a space or newline."""
    def steps(x: dict | None, key: str) -> list[dict]:
        return [] if x is None else x[key] if x["type"] == "Sequence" else [x]

    def alone(n: dict) -> bool:
        return n["type"] in ("NFC", "NFD", "Lowercase") or n["type"] == "Replace" and (n["pattern"], n["content"]) == ({"Regex": r"\s+"}, " ")

    cuts = steps(rules["pre_tokenizer"], "pretokenizers")
    first = cuts[0] if cuts else {"type": None}
    return (
        rules["truncation"] is None and rules["padding"] is None and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"]
        and all(alone(n) for n in steps(rules["normalizer"], "normalizers"))
        and first["type"] == "Split" and first["pattern"].get("Regex") in SPACELESS and (first["behavior"], first["invert"]) == ("Removed", True)
        and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in rules["added_tokens"])
    )


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, asked once for each distinct stretch between spaces or newlines.

    What the table of stretches has not is joined by spaces and given to the library in one call; the ids' places tell
    whose they are. The table is bounded: when it is full it becomes the old one, and what is not asked for again goes.
    A tokenizer whose rules may reach over white space gets whole texts.
    """

    def __init__(self, serialised: str, limit: int = 250_000, longest: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rules = json.loads(serialised)
        self.encode = Tokenizer.from_str(serialised).encode
        self.split = splits_at_spaces(rules)
        self.lower = '"Lowercase"' in json.dumps(rules["normalizer"])
        # for words of ASCII letters, which the rules leave as they are (but for case) and in one piece: merges alone
        bare = {**rules, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merge = Tokenizer.from_str(json.dumps(bare)).encode if self.split else None
        self.limit, self.longest = limit, longest
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def asked(self, words: list[str], encode) -> list[bytes]:
        """The ids of words that hold no space, given to the library in few calls."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            room, end = 1 << 18, at
            while end < len(words) and (room > 0 or end == at):
                room -= len(words[end]) + 1
                end += 1
            part = words[at:end]
            got = encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4").tobytes()
            starts = np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)
            places = np.fromiter((x for x, _ in got.offsets), dtype=np.int64, count=len(ids) // 4)
            edges = (4 * np.searchsorted(places, starts)).tolist()
            out += [ids[x:y] for x, y in zip(edges, edges[1:])]
            at = end
        return out

    def unseen(self, words: list[str]) -> list[bytes]:
        """The ids of stretches that the table has not; letters with marks after them are two pieces by the rules."""
        cut = [PLAIN(w) for w in words]
        letters = [m and (m[1].lower() if self.lower else m[1]) for m in cut]
        known, old = self.known, self.old
        found: dict[str, bytes | None] = {w: known.get(w) or old.get(w) for w in letters if w}
        missing = [w for w, x in found.items() if x is None]
        found.update(zip(missing, self.asked(missing, self.merge), strict=True))
        rest = list(dict.fromkeys([w for w, m in zip(words, cut, strict=True) if m is None] + [m[2] for m in cut if m and m[2]]))
        other = dict(zip(rest, self.asked(rest, self.encode), strict=True))
        return [other[w] if m is None else found[x] + other[m[2]] if m[2] else found[x] for w, m, x in zip(words, cut, letters, strict=True)]

    def stretches(self, words: list[str]) -> list[bytes]:
        """The ids of distinct stretches."""
        out = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            before = map(self.old.get, [words[i] for i in missing])
            unseen = []
            for i, x in zip(missing, before, strict=True):
                if x is None:
                    unseen.append(i)
                out[i] = x
            for i, x in zip(unseen, self.unseen([words[i] for i in unseen]), strict=True):
                out[i] = x
            if len(self.known) + len(missing) > self.limit:
                self.old, self.known = self.known, {}
            self.known.update((words[i], out[i]) for i in missing[: self.limit] if len(words[i]) <= self.longest)
        return out

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        if not self.split:
            return [self.whole(t) for t in texts.to_pylist()]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.values.dictionary_encode()
        each = self.stretches(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(each), dtype="<u4")
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        codes = coded.indices.to_numpy()
        lengths, firsts = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = pool[np.repeat(firsts - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        edges = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:])]


def pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, which are packed 32-bit integers."""
    step = 4 * capacity
    return [(i // step, i // 4, len(part) // 4, zlib.crc32(part)) for i in range(0, len(ids), step) for part in (ids[i : i + step],)]


def piece_column(spark: SparkSession, text: Column, tokenizer_path: str, capacity: int, end_id: int) -> Column:
    with open(tokenizer_path, encoding="utf-8") as f:
        serialised = f.read()
    shared = spark.sparkContext.broadcast((serialised, hashlib.sha256(serialised.encode()).hexdigest()))
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = to_arrow_type(arrow_type(PIECES))

    @arrow_udf(PIECES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        serialised, key = shared.value
        if key not in _loaded:
            _loaded[key] = WordTokenizer(serialised)
        for batch in batches:
            edges, flat = [0], []
            for part in slices(batch, 1 << 23):
                for ids in _loaded[key].ids(part):
                    flat += pieces(ids + end, capacity)
                    edges.append(len(flat))
            columns = list(zip(*flat, strict=True)) or [()] * 4
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values, type=kind)

    return run(text)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packs counts[length] pieces of each length.

    Gives runs (length, first rank, pieces, pieces in a sequence, first sequence, offset in it).
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, sequences)
    made = 0

    def put(n: int, many: int, each: int, first: int, offset: int) -> None:
        runs.append((n, rank[n], many, each, first, offset))
        rank[n] += many
        left[n] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in groups:
                insort(gaps, gap)
            groups.setdefault(gap, []).append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            fits = bisect_left(large, min(n, capacity - n) + 1) - 1
            while fits >= 0 and left[large[fits]] < (2 if large[fits] == n else 1):
                fits -= 1
            if fits < 0:
                many = left[n]
                put(n, many, 1, made, 0)
                leave(capacity - n, made, many)
            else:
                other = large[fits]
                many = left[n] // 2 if other == n else min(left[n], left[other])
                put(n, many, 1, made, 0)
                put(other, many, 1, made, n)
                leave(capacity - n - other, made, many)
            made += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                many = -(-left[n] // (capacity // n))
                leave(capacity, made, many)
                made += many
                continue
            gap = gaps[at]
            first, many = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            each = gap // n
            offset = capacity - gap
            if left[n] >= each * many:
                put(n, each * many, each, first, offset)
                leave(gap - each * n, first, many)
            else:
                full, rest = divmod(left[n], each)
                if full:
                    put(n, full * each, each, first, offset)
                    leave(gap - each * n, first, full)
                if rest:
                    put(n, rest, rest, first + full, offset)
                    leave(gap - rest * n, first + full, 1)
                leave(gap, first + full + bool(rest), many - full - bool(rest))
    return runs


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).alias("doc_id"), piece_column(spark, F.col(text), tokenizer_path, capacity, end_id).alias("p"))
    # inline_outer: a plain inline would make the pieces once more to filter empty lists
    table = staged(cut.select("doc_id", F.inline_outer("p")), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    salts = min(4096, max(64, sum(counts.values()) // 100_000))
    # equal rows of all columns are the same piece of the same text, so a task that runs again ranks alike
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = table.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    # The rank of a piece among its length: pieces in buckets before its own, and its place in its own.
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    ranked = salted.withColumn("within", within).join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("within") - 1)
    shared = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 6))

    @pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs = shared.value
        keys = runs[:, 0] << 50 | runs[:, 1]
        n, r = length.to_numpy(), rank.to_numpy()
        run = runs[np.searchsorted(keys, n << 50 | r, side="right") - 1]
        q, k = np.divmod(r - run[:, 1], run[:, 3])
        return pd.DataFrame({"sequence_id": run[:, 4] + q, "offset": run[:, 5] + k * n})

    placed = ranked.withColumn("_at", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
