"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard verification, union-find.

DataFrame functions alone. A line with a word is the set of its 8-character shingles (a shorter one is its own shingle);
lines are alike with a Jaccard similarity of at least 80 in 100 over these full sets, and of each component of alike lines
the first stays, by doc_id and line number.

Equal lines form one class at once. A class is signed by all its shingles: a shingle's hash puts it in one of 8 groups, and 12
orders of a group's shingles give it 3 bands of 4 coordinates, so a class has up to 24 buckets, and groups have their own
shingles. A pair at 0.80 misses all buckets with a chance of some 3e-6 (simulated: 6 of 100,000 for pairs with 5 shingles,
none of 100,000 for 6 to 40 each, none of 20,000 for 60 to 400 each). Classes are signed in two passes and buckets dealt band
by band, each in one shuffle that goes before the next, so that few texts and buckets lie on disk at once. In each bucket every class is compared with one hub, the
class whose buckets are fullest. In buckets whose classes still lie in several components, those outside the largest one are
compared with all classes of other components; where these are over a million pairs, hubs go on, and what they leave is
joined exactly by the rarest shingles. A pair goes without the comparison in full only if a bound on its similarity shows
that it must fail: marks, 2,048 bits for a class with one set for each shingle, tell how many shingles of either are
surely not the other's. In open buckets this and the comparison in full are made before a pair becomes a row, in the first bucket that both are in, so that only links
leave them; texts of classes in such buckets come there. Else texts are moved four times, never signatures of single shingles: to meet
their equals, to be signed, to leave classes without a candidate behind, and to lose their lines.

Cases. Null or empty text: no lines, unchanged. Lines without a word: always stay. Very long lines: all their shingles
count. Ties: the smallest (doc_id, line). Repeated rows of one doc_id: equal lines at one doc_id and number are
one place, so they go together or, where the place is the first of its component, stay together; unlike ones are told apart. Null doc_id:
such a row's lines are not compared and stay. Empty table: no rows. Extra columns pass through; n_lines and n_dropped are
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import fresh, release, settle, staged
from loomdoc.llm.components import components, stars
from loomdoc.llm.set_join import hub_links, open_pairs, rare_pairs

SHINGLE, GROUPS, BANDS, ROWS = 8, 8, 3, 4
#: In so many passes classes are signed; so many words of 64 bits a class has for a pair's bound.
HALVES, FINE = 2, 32
#: Chunks of bits that a task may be given, 32 MB.
MOST = 1 << 13
LOW32 = (1 << 32) - 1


def points(line: Column) -> Column:
    """The line as UTF-32: a shingle is 32 bytes at a place found at once, whatever characters stand before it."""
    return F.encode(line, "UTF-32")


def places(points: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(points) - (4 * SHINGLE - 1)), F.lit(4))


def hashed(points: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(points, place, F.lit(4 * SHINGLE)))


def hashes(line: Column) -> Column:
    """The hashes of a line's shingles, each once."""
    return F.transform(F.array(points(line)), lambda p: F.array_distinct(F.transform(places(p), lambda i: hashed(p, i))))[0]


def multipliers(n: int) -> list[int]:
    """Odd constants below 2**26; with a hash's two halves a and b, (a + m * b) mod 2**32 gives n orders of the shingles."""
    out, x = [], 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 38 | 1)
    return out


def bands(classes: DataFrame) -> DataFrame:
    """(node, b0, b1, ...): of classes' (node, s), a bucket in each band for each group that has a shingle."""
    # dealt by node first: what is grouped by node afterwards stays where it is
    lines = classes.repartition("node").select("node", points(F.col("s")).alias("p"))
    shingles = lines.select("node", "p", F.explode(places(F.col("p"))).alias("i")).select("node", hashed(F.col("p"), F.col("i")).alias("h"))
    a, b = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(F.lit(LOW32))
    orders = [F.min((F.col("a") + F.col("b") * F.lit(m)).bitwiseAND(F.lit(LOW32))).alias(f"m{i}") for i, m in enumerate(multipliers(BANDS * ROWS))]
    least = shingles.select("node", F.pmod(a, F.lit(GROUPS)).alias("g"), a.alias("a"), b.alias("b")).groupBy("node", "g").agg(*orders)
    keys = [F.xxhash64(F.lit(k), "g", *[f"m{k * ROWS + r}" for r in range(ROWS)]) for k in range(BANDS)]
    return least.select("node", *[key.alias(f"b{k}") for k, key in enumerate(keys)])


def candidates(signs: DataFrame) -> list[DataFrame]:
    """(bucket, node, c) of the buckets that c nodes share, c > 1: a staged table for each band of signs (node, b0, b1, ...)."""
    out = []
    for k in range(BANDS):
        # one shuffle: counted where they lie, and joined there; the count reads the node so that the shuffle is the same
        dealt = signs.select("node", F.col(f"b{k}").alias("bucket")).repartition("bucket")
        many = dealt.groupBy("bucket").agg(F.count("node").alias("c")).where("c > 1")
        out.append(staged(dealt.join(many.hint("shuffle_hash"), "bucket"), "line-candidates"))
        del dealt, many
        settle(signs.sparkSession)
    return out


def chosen(classes: DataFrame, nodes: DataFrame, holds: list | None = None) -> DataFrame:
    """The rows of classes whose node nodes has. Nodes go to every task as bits, a bit for each row that classes has, so texts stay
    where they are; with more than MOST chunks of bits (4 KB each) both are dealt by node instead. holds: gets what is staged."""
    # numbers that are given when a table is written follow each other within a partition, so chunks are dense
    bits = nodes.groupBy(F.shiftright("node", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("node").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = staged(bits, "line-chosen")
    if bits.count() > MOST:
        release(bits)
        return classes.join(nodes.select("node"), "node", "left_semi")
    if holds is not None:
        holds.append(bits)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("node", 3).bitwiseAND(F.lit(4095)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.call_function("shiftright", byte, F.col("node").bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return classes.join(F.broadcast(bits), F.shiftright("node", 15) == F.col("chunk")).where(has).select(*classes.columns)


def marks(texts: DataFrame) -> DataFrame:
    """(node, marks, fine): of texts (node, s). fine: FINE words of 64 bits, one set for each shingle; marks: the number of
    shingles, repeated ones too."""
    lines = texts.select("node", points(F.col("s")).alias("p"))
    shingles = lines.select("node", "p", F.explode(places(F.col("p"))).alias("i")).select("node", hashed(F.col("p"), F.col("i")).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 58).cast("int"))
    # a column for each word: a node has one row while its shingles are counted, not one for each word
    words = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"f{w}") for w in range(FINE)]
    lines = shingles.select("node", F.pmod("h", F.lit(FINE)).cast("int").alias("word"), bit.alias("bit")).groupBy("node").agg(F.count("*").alias("marks"), *words)
    return lines.select("node", "marks", F.array(*[f"f{w}" for w in range(FINE)]).alias("fine"))


def bound(x: Column, y: Column, p: Column, q: Column, percent: int) -> Column:
    """Whether sets of at most x and y shingles may be alike, of which p and q at least are only in one. Of the first at most
    x - p are common, and x + q are in either at least; a larger x only raises the quotient, so repeated shingles may count."""
    return (100 * (x - p) >= percent * (x + q)) & (100 * (y - q) >= percent * (y + p))


def alone(x: Column, y: Column) -> Column:
    """How many bits x has that y has not: as many shingles at least y has not."""
    return F.bit_count(x.bitwiseAND(F.bitwise_not(y))).cast("long")


def possible(percent: int) -> Column:
    """A bound by the marks ma and mb and all words of fa and fb, as compiled code: alike sets of s shingles, both counted,
    have at most s * (100 - percent) / (100 + percent) that only one of them has, and each bit that only one has is one at least."""
    apart = reduce(Column.__add__, [F.bit_count(F.get("fa", F.lit(w)).bitwiseXOR(F.get("fb", F.lit(w)))) for w in range(FINE)])
    return (100 - percent) * (F.col("ma") + F.col("mb")) >= (100 + percent) * apart


def possible_in_full(percent: int) -> Column:
    """The bound by the marks ma, mb and by their fine words fa, fb."""
    p, q = (F.aggregate(F.zip_with(f"f{x}", f"f{y}", alone), F.lit(0).cast("long"), Column.__add__) for x, y in ("ab", "ba"))
    return F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), lambda s: bound(F.col("ma"), F.col("mb"), s["p"], s["q"], percent))[0]


def alike(percent: int) -> Column:
    """The comparison in full of the lines sa and sb, by all their shingles."""

    def enough(x: Column, y: Column) -> Column:
        return F.transform(F.array(F.size(F.array_intersect(x, y))), lambda i: 100 * i >= percent * (F.size(x) + F.size(y) - i))[0]

    sets = F.array(F.struct(hashes(F.col("sa")).alias("x"), hashes(F.col("sb")).alias("y")))
    return F.transform(sets, lambda p: enough(p["x"], p["y"]))[0]


def fuzzy_lines(docs: DataFrame, *, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines to drop: (doc_id, line, key), each once, staged; key: the line's MD5."""
    # outer: a plain explode would split texts once more to filter empty lists
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("line", "s")).where(F.col("doc_id").isNotNull() & F.col("s").rlike(r"[^\x20\x09-\x0D]"))
    keyed = lines.withColumn("key", F.unhex(F.md5("s")))
    # a node is a number given when the table is written: unique, unlike a hash
    classes = keyed.groupBy("key").agg(F.first("s").alias("s"), F.min(F.struct("doc_id", "line")).alias("first"), F.max(F.struct("doc_id", "line")).alias("last"))
    classes = staged(classes.select("key", F.monotonically_increasing_id().alias("node"), "first", (F.col("first") != F.col("last")).alias("several"), "s"), "line-classes", "zstd")
    settle(docs.sparkSession)
    signs = []
    for k in range(HALVES):
        signs.append(staged(bands(classes.where(F.pmod("node", F.lit(HALVES)) == k).select("node", "s")), "line-bands"))
        settle(docs.sparkSession)
    parts = candidates(reduce(DataFrame.union, signs))
    shared = reduce(DataFrame.union, parts)
    release(*signs)
    degree = staged(shared.groupBy("node").agg(F.sum("c").alias("degree")), "line-degrees")
    left = staged(shared.drop("c").join(degree, "node"), "line-shared")
    release(*parts)
    texts = staged(chosen(classes.select("node", "s"), degree, holds := []), "line-texts")
    release(degree, *holds)
    settle(docs.sparkSession)
    marked = staged(marks(texts), "line-marks")

    def verified(pairs: DataFrame) -> DataFrame:
        both = [marked.select(F.col("node").alias(c), F.col("marks").alias(f"m{c}"), F.col("fine").alias(f"f{c}")) for c in "ab"]
        pairs = pairs.join(both[0], "a").join(both[1], "b").where(possible_in_full(percent)).select("a", "b")
        ends = [texts.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab"]
        return staged(pairs.join(ends[0], "a").join(ends[1], "b").where(alike(percent)).select("a", "b"), "line-links")

    def joined(full: DataFrame, found: DataFrame) -> DataFrame:
        """Components with the links of the buckets in full, (bucket, node, degree): by hubs, then by rare shingles."""
        more, rest = hub_links(full, verified, found=found)
        if not rest.isEmpty():
            nodes = rest.select("node", "component").distinct()
            sets = texts.join(nodes, "node").select("node", "component", hashes(F.col("s")).alias("g"))
            tokens = staged(sets.select("node", F.size("g").cast("long").alias("n"), "component", F.explode_outer("g").alias("h")), "line-shingles")
            holds: list[DataFrame] = []
            links = verified(rare_pairs(tokens, percent, holds).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            release(tokens, *holds)
            before, more = more, components(links.union(stars(more)))
            release(links, before)
        release(rest)
        return more

    found, rest = hub_links(left, verified, rounds=1)
    release(left)
    if not rest.isEmpty():
        # texts come to their buckets, so only a link becomes a row; the cheap bounds are asked first
        links, full = open_pairs(rest, marked.join(texts, "node"), possible(percent), possible_in_full(percent) & alike(percent))
        links = staged(links, "line-links")
        full = staged(full, "line-full")
        before, found = found, components(links.union(stars(found)))
        release(links, before)
        if not full.isEmpty():
            before, found = found, joined(full, found)
            release(before)
        release(full)
    release(rest, texts, marked)
    # the first of a component stays; of a class alone, its own first
    named = classes.drop("s").join(found, "node", "left").where("component is not null or several").withColumn("component", F.coalesce("component", "node"))
    group = named.groupBy("component").agg(F.min("first").alias("keeper"))
    drop = staged(named.join(group, "component").select("key", "keeper"), "line-drops")
    gone = keyed.select("doc_id", "line", "key").join(drop, "key").where(F.struct("doc_id", "line") != F.col("keeper")).select("doc_id", "line", "key").distinct()
    gone = staged(gone, "dropped-lines")
    release(classes, found, drop)
    return gone


def drop_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the text without dropped lines, n_lines (before) and n_dropped."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    one, lines, gone, stay = (fresh(kept, c) for c in ("_id", "_lines", "_gone", "_stay"))
    marks = fuzzy_lines(docs, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias(one), F.concat_ws(":", F.col("line").cast("string"), F.lower(F.hex("key"))).alias("mark"))
    out = kept.join(marks.groupBy(one).agg(F.collect_list("mark").alias(gone)), F.col(doc_id) == F.col(one), "left").withColumn(lines, F.split(F.col(text), "\n"))
    # set difference of (number, digest) marks: linear in the lines, however many go
    own = F.transform(lines, lambda s, i: F.concat_ws(":", i.cast("string"), F.md5(s)))
    left = F.transform(F.array_except(own, gone), lambda m: F.get(F.col(lines), F.substring_index(m, ":", 1).cast("int")))
    out = out.withColumn(stay, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(left))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(lines) - F.size(stay), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long"))).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
    return out.withColumn(text, F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join(stay, "\n"))).drop(one, lines, gone, stay)
