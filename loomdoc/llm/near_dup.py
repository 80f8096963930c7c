"""Circulant MinHash near-duplicates: signatures by two permutations, banding, exact Jaccard verification, components.

sigma and pi are bijections of the 64-bit integers. Coordinate k of a signature is the minimum over the set of
pi(sigma(x) + k mod 2**64): pi circularly shifted by k, so the two permutations give all coordinates.

Documents with equal shingle sets form one class and their smallest doc_id stands for it. Classes that share a band are
candidates. In each bucket every class is compared with one hub, the class whose buckets are fullest (an aggregate, so a
bucket of any size is handled without gathering it), and the components found are merged; what is left is compared with
the next hub, three times. Classes in buckets whose rest still lies in several components are joined exactly: two sets alike enough share one of their rarest shingles, at places
that their sizes bound, so unlike texts that share bands do not meet. Pairs with fewer equal coordinates than five and a
half deviations below the threshold's mean are not compared in full (a chance below 1e-7 for a link). A link inside a component that is already connected
changes no result and is not looked for.

Cases. Null or empty text, or no words: an empty set, linked with nothing, its own component. Fewer words than a shingle:
the whole sequence is the one shingle. Very long texts: hashed in blocks. Repeated rows: equal sets, one class, every row
is returned. Ties: the smallest doc_id. Empty table: no rows. Extra columns are not read. A null doc_id takes part, is
never a component's id unless all ids in it are null, and is kept only then.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructType

from loomdoc.llm.common import release, staged
from loomdoc.llm.components import components, stars
from loomdoc.llm.set_join import hub_links, rare_pairs

BANDS, ROWS = 20, 5
UP = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: bytes.split() ends words at 09-0D and 20, as the contract's classes do.
_U = np.uint64


def mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 64-bit integers; a and b are odd."""
    x = x ^ (x >> _U(32))
    x = x * _U(a)
    x ^= x >> _U(29)
    x *= _U(b)
    x ^= x >> _U(32)
    return x


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().translate(UP).split()
    if not words:
        return np.empty(0, dtype=_U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=_U)
    ids: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for w in set(words):
        ids[w] = digest(w)
    h = np.fromiter(map(ids.__getitem__, words), dtype=_U, count=len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=_U)
    for k in range(size):
        out = mix(out + h[k : k + n], 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    return np.unique(out)


def signature(hashes: np.ndarray, length: int = BANDS * ROWS, block: int = 512) -> np.ndarray:
    """All coordinates of a block of hashes at once: few calls for short texts, bounded memory for long ones."""
    out = np.full(length, np.iinfo(np.uint64).max, dtype=_U)
    shifts = np.arange(length, dtype=_U)[:, None]
    for at in range(0, len(hashes), block):
        x = mix(hashes[at : at + block], 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
        np.minimum(out, mix(x + shifts, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> list[int]:
    return [np.int64(_U(xxhash.xxh3_64_intdigest(sig[i : i + rows].tobytes(), seed=i)).astype(np.int64)).item() for i in range(0, len(sig), rows)]


def _hashed(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, digests = batch.columns
            for lo in range(0, len(ids), 512):
                cols: list[list] = [[], [], [], []]
                seen: dict[bytes, tuple] = {}
                for t in texts[lo : lo + 512]:
                    s = shingle_set(t.as_py(), size)
                    raw = s.tobytes()
                    key = xxhash.xxh3_128_digest(raw)
                    if key not in seen:
                        sig = signature(s) if len(s) else s
                        seen[key] = ((sig >> _U(32)).astype(np.uint32).tobytes(), band_keys(sig))
                    for c, x in zip(cols, (len(s), key, *seen[key]), strict=True):
                        c.append(x)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], digests[lo : lo + 512], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "digest", "n", "key", "sig", "bands"])

    return run


@arrow_udf(ArrayType(LongType()))
def hash_list(raw: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x.as_py(), np.int64) for x in raw], pa.list_(pa.int64()))


def near_duplicates(docs: DataFrame, *, percent: int = 85, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    least_matches = int(BANDS * ROWS * (percent / 100 - 0.2))  # five and a half deviations below the threshold

    @arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([np.count_nonzero(np.frombuffer(x.as_py(), np.uint32) == np.frombuffer(y.as_py(), np.uint32)) >= least_matches for x, y in zip(a, b, strict=True)], pa.bool_())

    @arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
            both = len(p) + len(q) - len(np.union1d(p, q))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    # the digest tells rows of one doc_id apart, so that a doc_id with many texts joins row by row
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("digest"))
    kind = StructType([read.schema["doc_id"]]).simpleString()[7:-1]
    table = staged(read.mapInArrow(_hashed(size), f"{kind}, digest long, n long, key binary, sig binary, bands array<long>"), "shingles")
    # a class for each shingle set (by 128 bits); its node is a number given when the table is written, so it is unique
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("head")
    sets = table.where("n > 0").groupBy("key").agg(head, *[F.first(c).alias(c) for c in ("n", "sig", "bands")])
    sets = staged(sets.select("key", F.monotonically_increasing_id().alias("node"), F.col("head.doc_id").alias("rep"), F.col("head.digest").alias("digest"), "n", "sig", "bands"), "class-sets")
    classes = sets.select("key", "node", "rep", "digest")
    buckets = sets.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    many = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    shared = staged(buckets.join(many, "bucket"), "buckets")
    degrees = staged(shared.groupBy("node").agg(F.sum("c").alias("degree")), "degrees")
    left = staged(shared.drop("c").join(degrees, "node"), "shared-buckets")
    release(shared)
    signs = staged(sets.join(degrees, "node", "left_semi").select("node", "n", "sig"), "candidate-signatures")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                nodes, keys, texts = batch.slice(lo, 512).columns
                raws = [shingle_set(t.as_py(), size).tobytes() for t in texts]
                same = pa.array([xxhash.xxh3_128_digest(r) == k.as_py() for r, k in zip(raws, keys, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([nodes, pa.array(raws, pa.binary())], ["node", "hashes"]).filter(same)

    # the whole sets of the candidates alone, made again from the texts: not all sets are ever stored
    need = classes.join(degrees, "node", "left_semi").select("node", "key", "rep", F.col("digest").alias("own"))
    texts = read.join(need, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("own"))).select("node", "key", "text")
    wholes = staged(texts.mapInArrow(whole, "node long, hashes binary").dropDuplicates(["node"]), "full-sets")
    release(degrees)

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = [signs.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab"]
        bound = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
        near = staged(pairs.join(one, "a").join(two, "b").where(bound).where(alike("sa", "sb")).select("a", "b"), "alike")
        ha, hb = [wholes.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab"]
        found = staged(near.join(ha, "a").join(hb, "b").where(linked("ha", "hb")).select("a", "b"), "linked")
        release(near)
        return found

    found, rest = hub_links(left, verified)
    release(left)
    if not rest.isEmpty():
        own = signs.select("node", "n").join(rest.select("node", "component").distinct(), "node")
        tokens = staged(wholes.join(own, "node").select("node", "n", "component", F.explode_outer(hash_list("hashes")).alias("h")), "open-shingles")
        holds: list[DataFrame] = []
        more = verified(rare_pairs(tokens, percent, holds).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(tokens, *holds)
        before, found = found, components(more.union(stars(found)))
        release(more, before)
    release(rest, signs, wholes)
    # only components of several classes need a smallest id; the others have their class's
    joined = classes.join(found, "node")
    several = joined.join(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("key", "component_id")
    several = staged(several, "component-ids")
    ids = classes.join(several, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    full = table.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "key").join(ids, "key").drop("key")
    empty = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    release(found)
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
