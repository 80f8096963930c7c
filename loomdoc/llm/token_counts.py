"""Token counts: heap-and-linked-list byte-pair merging over the pieces of a SentencePiece BPE model.

The lowest-rank adjacent pair is popped again and again; the count is the initial symbols minus the merges, plus the
extra bytes of characters that the model has no piece for. No identifiers are made.

Cases. Null or empty text: 0 tokens. Very long texts: cut, without loss, where no piece of the vocabulary can reach
over; the cut is used only if the vocabulary, checked when it is loaded, allows it. Repeated rows, ties and extra
columns: each row is counted for itself, other columns pass through unread.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.common import Memo, per_text

META = "▁"
#: A run of word marks with the letters, or with the other characters, that follow it.
CHUNK = regex.compile(rf"{META}*(?:\p{{L}}+|[^{META}\p{{L}}]+)|{META}+")
_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens as the SentencePiece library does for a BPE model with identity normalisation and byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]]):
        ranked = sorted(pieces, key=lambda p: -p[1])
        self.rank = {p: i for i, (p, _) in enumerate(ranked)}
        self.known = {p for p in self.rank if len(p) == 1}
        crosses = regex.compile(rf"[^{META}]{META}|\p{{L}}[^\p{{L}}{META}]|[^\p{{L}}{META}]\p{{L}}")
        self.splits = not any(crosses.search(p) for p in self.rank)
        self.lines = self.splits and not any("\n" in p and len(p) > 1 for p in self.rank)
        self.chunks = Memo(self.merged)
        self.words = Memo(self._word)

    def merged(self, text: str) -> int:
        """Tokens of one stretch of text with its word marks in place."""
        rank, known = self.rank, self.known
        sym = list(text)
        n = len(sym)
        if n == 1:
            return 1 if text in known else len(text.encode())
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            r = rank.get(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapify(heap)
        count = n
        while heap:
            _, i, pair = heappop(heap)
            left, j = sym[i], nxt[i]
            if left is None or j >= n or len(left) + len(sym[j]) != len(pair) or left + sym[j] != pair:
                continue
            sym[i], sym[j] = pair, None
            j = nxt[i] = nxt[j]
            count -= 1
            p = prv[i]
            if p >= 0:
                joined = sym[p] + pair
                r = rank.get(joined)
                if r is not None:
                    heappush(heap, (r, p, joined))
            if j < n:
                prv[j] = i
                joined = pair + sym[j]
                r = rank.get(joined)
                if r is not None:
                    heappush(heap, (r, i, joined))
        if not known.issuperset(text):
            count += sum(len(s.encode()) - 1 for s in sym if s is not None and len(s) == 1 and s not in known)
        return count

    def _split(self, marked: str) -> int:
        return sum(map(self.chunks.__getitem__, CHUNK.findall(marked)))

    def _word(self, word: str) -> int:
        """A word after a space, or, with \\n before it, at a line's start."""
        if word[:1] == "\n":
            return self.chunks["\n"] + (self._split(word[1:]) if len(word) > 1 else 0)
        return self._split(META + word)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return self.merged(META + text.replace(" ", META))
        if self.lines and text[0] != " " and "  " not in (spaced := text.replace("\n", " \n")) and META not in text:
            return sum(map(self.words.__getitem__, spaced.split(" ")))
        return self._split(META + text.replace(" ", META))


def load_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces that merges can make, with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    probe = "\uff21\u00e9 \ufb01  x\tA\u030a\n\u00bd "
    if sp.normalize(probe) != META + probe.replace(" ", META) or sum(map(sp.is_byte, ids)) != 256:
        raise ValueError("the model must leave texts as they are, put a word mark before them and fall back to bytes")
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def counter(pieces: list[tuple[str, float]], key: str) -> PieceCounter:
    if key not in _loaded:
        _loaded[key] = PieceCounter(pieces)
    return _loaded[key]


def n_tokens(spark: SparkSession, text: Column, model_path: str) -> Column:
    """A long column: tokens of each whole text under the model, whose vocabulary (bounded, read on the driver) is broadcast."""
    pieces = load_pieces(model_path)
    shared = spark.sparkContext.broadcast((pieces, hashlib.sha256(repr(pieces).encode()).hexdigest()))
    return per_text(text, lambda: counter(*shared.value).count, "long")


def count_tokens(df, model_path: str, *, text: str = "text", limit: int = 4096):
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    counted = df.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    return counted.withColumn("n_tokens", n_tokens(df.sparkSession, F.col(text), model_path)).withColumn("over_limit", F.col("n_tokens") > limit)
