"""Language-model scores by a gated recurrent network with a class-factored output, trained here.

A token has one of CLASSES * MEMBERS slots: the words that training documents hold most often have one each, all others
share the last ones by a hash. The network gives p(class | state) and p(member | class, state); a word's share of its slot
comes from counts over all training documents, so the product is a probability over all words, with room for one unknown
word in each slot. The output's biases start at the slots' frequencies.

Training is truncated backpropagation in numpy over all training documents. They are dealt by a hash of doc_id and tokens
into shards of some SHARD tokens and read there in the hash's order, so the result does not depend on how the table is
split; in each of ROUNDS rounds every shard goes on from the last round's weights over its part of that round, and the
shards' weights are averaged by their tokens (a vector of fixed size). Scoring starts each document at state 0 and carries
the state from window to window over the whole text.

Counts of all words are a table that grows with the corpus and is joined, never collected; the TOP words at most that are
most frequent in all documents, held out or not, go to every task, so no frequent word is a key of that join.

Cases. Null or empty text: one token, the end. Very long texts: windows; the state is carried. No training documents:
counts are 0, the network keeps its start. Repeated rows: each is scored, and counted, for itself. Null doc_id: held out
is null and the text is not trained on. Empty table: no rows. Extra columns are not read. doc_id keeps its type.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomdoc.llm.common import slices, staged, summed_vectors, sweep

CLASSES, MEMBERS, HIDDEN = 32, 32, 16
SLOTS, SHARED = CLASSES * MEMBERS, 64  # the last SHARED slots are for all words without one of their own
WINDOW, STREAMS, CHUNK = 16, 512, 1 << 16  # steps, rows side by side, and tokens that are cut into rows at once
SHARD, ROUNDS, TOP = 1 << 22, 3, 1 << 18
END = "\n"  # no word holds it; its slot is 0
SHAPES = {"E": (SLOTS, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "C": (HIDDEN, CLASSES), "c": (CLASSES,), "M": (CLASSES, HIDDEN, MEMBERS), "m": (CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s), at + n
    return out


def start(frequencies: np.ndarray | None = None) -> np.ndarray:
    """Weights to begin with; frequencies: how often each slot stands in the training documents."""
    flat = np.random.default_rng(5).normal(0, 0.1, SIZE)
    p = unpacked(flat)
    of = np.log1p(np.zeros(SLOTS) if frequencies is None else frequencies).reshape(CLASSES, MEMBERS)
    p["m"][...] = of - of.mean(1, keepdims=True)
    sums = np.log(np.exp(of).sum(1))
    p["c"][...] = sums - sums.mean()
    return flat


def advanced(p: dict, h: np.ndarray, x: np.ndarray) -> tuple:
    """The states after tokens x, and what backpropagation needs; an end sets the state to 0."""
    a, u = p["E"][x], h @ p["U"]
    zr = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
    on = (x != 0).astype(h.dtype)[:, None]
    return (n + z * (h - n)) * on, z, r, n, u[:, 2 * HIDDEN :], on


def by_class(k: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class with the rows that have it."""
    order = np.argsort(k.astype(np.int16), kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(k, minlength=CLASSES))))
    return ((c, order[edges[c] : edges[c + 1]]) for c in range(CLASSES) if edges[c] < edges[c + 1])


def log_softmax(a: np.ndarray) -> np.ndarray:
    if a.size and (a.max() > 60 or a.min() < -60):  # only then exp could leave its range
        a -= a.max(1, keepdims=True)
    a -= np.log(np.exp(a).sum(1, keepdims=True))
    return a


def log_probabilities(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logarithms of p(slot y | state h)."""
    k, j = y // MEMBERS, y % MEMBERS
    out = log_softmax(h @ p["C"] + p["c"])[np.arange(len(y)), k]
    for c, rows in by_class(k):
        out[rows] += log_softmax(h[rows] @ p["M"][c] + p["m"][c])[np.arange(len(rows)), j[rows]]
    return out


def gradients(p: dict, h: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """xs, ys: steps by rows. The mean loss's gradients, the last states and the loss."""
    kept, kind = [], h.dtype
    g = {k: np.zeros(s, dtype=kind) for k, s in SHAPES.items()}
    for x in xs:
        before, (h, *gates) = h, advanced(p, h, x)
        kept.append((before, h, *gates))
    states, y = np.concatenate([x[1] for x in kept]), ys.ravel()
    k, j = y // MEMBERS, y % MEMBERS
    logs = log_softmax(states @ p["C"] + p["c"])
    rows = np.arange(len(y))
    loss = -logs[rows, k].sum()
    d = np.exp(logs, out=logs)
    d[rows, k] -= 1
    g["C"], g["c"], dstates = states.T @ d, d.sum(0), d @ p["C"].T
    for c, at in by_class(k):
        own, mine = states[at], (np.arange(len(at)), j[at])
        logs = log_softmax(own @ p["M"][c] + p["m"][c])
        loss -= logs[mine].sum()
        d = np.exp(logs, out=logs)
        d[mine] -= 1
        g["M"][c], g["m"][c] = own.T @ d, d.sum(0)
        dstates[at] += d @ p["M"][c].T
    dstates = dstates.reshape(*xs.shape, HIDDEN)
    da = np.empty((*xs.shape, 3 * HIDDEN), dtype=kind)
    du = np.empty_like(da)
    carried, back = np.zeros_like(h), p["U"].T.copy()
    for t in range(len(xs) - 1, -1, -1):
        before, _, z, r, n, un, on = kept[t]
        dh = carried + dstates[t]
        dh *= on
        keep = dh * z
        dn = (dh - keep) * (1 - n * n)
        da[t, :, :HIDDEN] = keep * (before - n) * (1 - z)
        nr = dn * r
        da[t, :, HIDDEN : 2 * HIDDEN] = nr * un * (1 - r)
        da[t, :, 2 * HIDDEN :] = dn
        du[t, :, : 2 * HIDDEN] = da[t, :, : 2 * HIDDEN]
        du[t, :, 2 * HIDDEN :] = nr
        carried = du[t] @ back
        carried += keep
    g["U"] = np.concatenate([x[0] for x in kept]).T @ du.reshape(-1, 3 * HIDDEN)
    order = np.argsort(xs.ravel().astype(np.int16), kind="stable")
    counts = np.bincount(xs.ravel(), minlength=SLOTS)
    found = np.flatnonzero(counts)
    g["E"][found] = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[order], (np.cumsum(counts) - counts)[found], axis=0)
    return {k: v / xs.size for k, v in g.items()}, h, float(loss) / xs.size


def trained(p: dict, power: dict, stream: np.ndarray, rate: float = 0.1) -> None:
    """Goes over a stream of slots, cut into rows that are read side by side."""
    wide = min(STREAMS, max(1, len(stream) // (2 * WINDOW)))
    table = np.concatenate([stream, np.resize(stream, -len(stream) % wide)]).reshape(wide, -1).T
    h = np.zeros((wide, HIDDEN), dtype=p["E"].dtype)
    for at in range(0, len(table) - 1, WINDOW):
        ys = table[at + 1 : at + 1 + WINDOW]
        g, h, _ = gradients(p, h, table[at : at + len(ys)], ys)
        for k in g:
            power[k] += g[k] ** 2
            p[k] -= rate * g[k] / np.sqrt(power[k])


def train(rows: Iterable[tuple[int, bytes]], begin: np.ndarray) -> np.ndarray:
    """rows: (shard, slots), shards together. The sum over shards of their weights times their tokens, and the tokens."""
    total = np.zeros(SIZE + 1)
    shard, parts, waiting, seen, flat, p, power = None, [], 0, 0, None, {}, {}

    def flush() -> None:
        nonlocal parts, waiting, seen
        if waiting > 1:
            trained(p, power, np.concatenate(parts))
        seen, parts, waiting = seen + waiting, [], 0

    for own, slots in [*()] if rows is None else rows:
        if own != shard:
            if shard is not None:
                flush()
                total += np.append(flat.astype(np.float64) * seen, seen)
            shard, seen, flat = own, 0, begin.astype(np.float32)
            p, power = unpacked(flat), {k: np.full(s, 1e-6, dtype=np.float32) for k, s in SHAPES.items()}
        ids = np.frombuffer(slots, dtype="<u2").astype(np.int64)
        for lo in range(0, len(ids), CHUNK):
            parts.append(ids[lo : lo + CHUNK])
            waiting += len(parts[-1])
            if waiting >= CHUNK:
                flush()
    if shard is not None:
        flush()
        total += np.append(flat.astype(np.float64) * seen, seen)
    return total


def network_scores(p: dict, documents: list[np.ndarray]) -> np.ndarray:
    """log10 of the slots' probabilities, summed over each whole document."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lengths = np.array([len(documents[i]) for i in order])
    total = np.zeros(len(order))
    if len(order):
        flat = np.concatenate([documents[i] for i in order])
        firsts, h = np.cumsum(lengths) - lengths, np.zeros((len(order), HIDDEN), dtype=p["E"].dtype)
        t = 0
        while t < lengths[0]:
            states, ys, live, room = [], [], [], 1 << 16
            while t < lengths[0] and room > 0:
                n = int(np.searchsorted(-lengths, -t, side="left"))  # documents that have a token here
                y = flat[firsts[:n] + t]
                h = h[:n]
                states.append(h)
                ys.append(y)
                live.append(n)
                h, room, t = advanced(p, h, y)[0], room - n, t + 1
            logs, at = log_probabilities(p, np.concatenate(states), np.concatenate(ys)), 0
            for n in live:
                total[:n] += logs[at : at + n]
                at += n
    out = np.empty(len(order))
    out[order] = total / math.log(10)
    return out


def worded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts as a dictionary array, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    counts = np.diff(split.offsets.to_numpy())
    counts[pc.equal(pc.binary_length(split.flatten().take(split.offsets[:-1])), 0).to_numpy(zero_copy_only=False)] = 0 if len(texts) else counts[:0]
    flat = split.flatten()
    return flat.filter(pc.not_equal(flat, "")).dictionary_encode(), counts


def counted(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(text, held_out) to (w, c, t): partial counts in training documents and in all."""
    tables: list[pa.Table] = []

    def merged() -> pa.Table:
        out = pa.concat_tables(tables).group_by("w", use_threads=False).aggregate([("c", "sum"), ("t", "sum")])
        return out.select(["w", "c_sum", "t_sum"]).rename_columns(["w", "c", "t"])

    for batch in batches:
        held = pc.fill_null(batch.column(1), True).to_numpy(zero_copy_only=False)
        at = 0
        for part in slices(batch.column(0)):
            coded, counts = worded(part)
            use = ~held[at : at + len(part)]
            at += len(part)
            codes, n = coded.indices.to_numpy(), len(coded.dictionary)
            words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.string())])
            c, t = np.bincount(codes[np.repeat(use, counts)], minlength=n), np.bincount(codes, minlength=n)
            tables.append(pa.table({"w": words, "c": pa.array(np.append(c, use.sum()).astype(np.int64)), "t": pa.array(np.append(t, len(part)).astype(np.int64))}))
        if sum(map(len, tables)) > most:
            tables = [merged()]
            if len(tables[0]) > most // 2:
                yield from tables.pop().to_batches()
    if tables:
        yield from merged().to_batches()


class Vocabulary:
    """The most frequent words with their training counts and slots; slots: the training count and the words of each."""

    def __init__(self, words: list[str], counts: list[int], slots: np.ndarray):
        self.words, self.counts, self.slots = pa.array(words, pa.string()), np.array(counts, dtype=np.int64), slots

    def looked_up(self, words: pa.Array) -> np.ndarray:
        """Places in the table, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()


def shared_slot(word: str) -> int:
    return SLOTS - SHARED + zlib.crc32(word.encode()) % SHARED


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD, top: int = TOP) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.crc32(F.col(doc_id).cast("string")) % 7 == 2).alias("held_out"))
    counts = read.select("text", "held_out").mapInArrow(counted, "w string, c long, t long")
    counts = staged(counts.groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()

    # the lowest step of a count from which no more than `top` words are counted
    step = F.floor(F.log2("t") * 16).cast("int")
    least, room = 1 << 30, top
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        room -= r.n
        if room < 0:
            break
        least = r.s
    frequent = sorted(((r.w, r.c) for r in counts.where(step >= least).collect()), key=lambda x: (x[0] != END, -x[1], x[0]))
    rare = counts.where(step < least)
    own = [w for w, c in frequent if c or w == END][: SLOTS - SHARED]
    slot_of = {w: i for i, w in enumerate(own)}
    slots = np.array([slot_of.get(w, -1) for w, _ in frequent], dtype=np.int64)
    slots[slots < 0] = [shared_slot(w) for w, _ in frequent if w not in slot_of]
    sums = np.zeros((SLOTS, 2), dtype=np.int64)  # training tokens and words of each slot
    np.add.at(sums, slots, [(c, c > 0) for _, c in frequent] or np.zeros((0, 2), dtype=np.int64))
    place = F.crc32("w") % SHARED
    for r in rare.groupBy(place.alias("s")).agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect():
        sums[SLOTS - SHARED + r.s] += (r.c, r.v)
    room = sums.sum(1) + 1
    vocabulary = spark.sparkContext.broadcast(Vocabulary([w for w, _ in frequent], [c for _, c in frequent], slots))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        logs = np.append(np.log10(known.counts + 1.0), 0.0)
        shares = np.append(logs[:-1] - np.log10(room[known.slots]), 0.0)
        end = known.looked_up(pa.array([END], pa.string()))[0]
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                coded, sizes = worded(part)
                words = coded.dictionary
                places = known.looked_up(words)
                strings = words.filter(pa.array(places < 0)).to_pylist()
                slot = np.empty(len(words), dtype="<u2")
                slot[places >= 0] = known.slots[places[places >= 0]]
                slot[places < 0] = [shared_slot(w) for w in strings]
                codes = coded.indices.to_numpy()
                edges = np.concatenate(([0], np.cumsum(sizes)))
                of = places[codes]
                sure = np.append(known.counts > 0, False)

                def summed(x: np.ndarray, last: float) -> np.ndarray:
                    c = np.concatenate(([0], np.cumsum(x)))
                    return c[edges[1:]] - c[edges[:-1]] + last

                ids = slot[codes]
                documents = [ids[a:b].tobytes() + b"\0\0" for a, b in zip(edges, edges[1:])]
                # what the table has not: (word, times) of each document
                outside = np.flatnonzero(of < 0)
                doc = np.searchsorted(edges, outside, side="right") - 1
                pairs, times = np.unique(doc * len(words) + codes[outside], return_counts=True)
                doc, which = np.divmod(pairs, max(1, len(words)))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([words.take(pa.array(which)), pa.array(times, pa.int64())], ["w", "k"]),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(sizes + 1, pa.int64()), pa.array(summed(sure[of], bool(sure[end])), pa.int64()), pa.array(summed(logs[of], logs[end])), pa.array(summed(shares[of], shares[end])), pa.array(documents, pa.binary()), lists],
                    ["doc_id", "held_out", "n_tokens", "known", "logs", "shares", "slots", "rare"],
                )
                at += len(part)

    kind = StructType([read.schema["doc_id"]]).simpleString()[7:-1]
    table = read.mapInArrow(encoded, f"{kind}, held_out boolean, n_tokens long, known long, logs double, shares double, slots binary, rare array<struct<w:string,k:bigint>>")
    table = staged(table.select(F.monotonically_increasing_id().alias("row"), "*"), "lm-tokens")
    mixed = F.xxhash64("doc_id", "slots")
    shards, begin = max(1, round(n / shard)), start(sums[:, 0])
    dealt = table.where("not held_out").select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("round"), F.pmod(mixed, F.lit(shards)).alias("shard"), mixed.alias("o"), "slots")
    for r in range(ROUNDS if n else 0):
        part = dealt.where(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", "o")
        passed = begin

        def task(batches: Iterator[pa.RecordBatch], begin: np.ndarray = passed) -> np.ndarray:
            return train(((s, x.as_py()) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1), strict=True)), begin)

        sums_ = summed_vectors(part.select("shard", "slots"), task, SIZE + 1, max(8, min(64, shards)))
        begin = sums_[:-1] / sums_[-1] if sums_[-1] else begin
        sweep(spark)
    shared = spark.sparkContext.broadcast(begin.astype(np.float32))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpacked(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                net = network_scores(p, [np.frombuffer(x.as_py(), dtype="<u2").astype(np.int32) for x in part.column("slots")])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(net)], [*part.schema.names[:-1], "net"])

    columns = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "shares"]
    scored = table.select(*columns, "slots").mapInArrow(score, f"row long, {kind}, held_out boolean, n_tokens long, known long, logs double, shares double, net double")
    sizes = F.split(F.lit(",".join(map(str, room[SLOTS - SHARED :]))), ",").cast("array<double>")
    log = F.log10(F.col("c") + 1)
    k = F.col("k")
    others = table.select("row", F.inline("rare")).join(rare, "w").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("known_"), F.sum(k * log).alias("logs_"), F.sum(k * (log - F.log10(F.get(sizes, place.cast("int"))))).alias("shares_")
    )
    out = scored.join(others, "row", "left")
    both = {c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in ("known", "logs", "shares")}
    base = both["logs"] - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return out.select("doc_id", "held_out", "n_tokens", both["known"].cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("net") + both["shares"]).alias("score"))
