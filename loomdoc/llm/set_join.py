"""Links of alike sets from buckets: by hubs, by pairs of what hubs leave in small buckets, and an exact join of what they
leave in large ones, with DataFrame functions alone.

Cases. Empty table: no rows. Equal sets in different components: a pair. A set that shares no token: no pair. Ties in
rarity: by the token. Pairs may come twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.llm.common import release, staged
from loomdoc.llm.components import components, stars

ROUNDS = 3
#: A bucket with more pairs of this kind than these is left to the join: a task looks at them all.
PAIRS = 1 << 20


def hub_links(shared: DataFrame, verified, rounds: int = ROUNDS, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, rest) of shared (bucket, node, degree), where nodes of a bucket are candidates for a link.

    In each round every node of a bucket is compared with the bucket's hub, the node of the largest degree, by
    verified(pairs of (a, b), a < b), which gives a staged table; then the hub leaves the bucket, and so does the bucket whose nodes all lie in one
    component. The components found so far, or given as found (which is not deleted), stand for their links in the next round. A hub is an aggregate with partial sums, so a bucket of any size is handled without gathering it. rest is
    what still lies in several components, (bucket, node, degree, component): no pair of it has been compared. All staged.
    """
    rest = shared.withColumn("component", F.col("node"))
    given, held = found, None
    if given is not None:
        rest = shared.join(given, "node", "left").withColumn("component", F.coalesce("component", "node"))
    for _ in range(rounds):
        hub = F.max(F.struct("degree", F.col("node").alias("hub"), F.col("component").alias("of")))
        hubs = rest.groupBy("bucket").agg(hub.alias("h")).select("bucket", "h.hub", "h.of")
        pairs = rest.join(hubs, "bucket").where("component != of").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        more = verified(pairs)
        new = components(more if found is None else more.union(stars(found)))
        others = rest.join(hubs, "bucket").where("node != hub").select("bucket", "node", "degree")
        now = others.join(new, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
        rest = staged(now.join(several, "bucket").select("bucket", "node", "degree", "component"), "open")
        release(*[x for x in (held, found, more) if x is not None and x is not given])
        held, found = rest, new
        if rest.isEmpty():
            break
    return found, rest


def open_pairs(rest: DataFrame, marked: DataFrame, possible: Column, alike: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, full) of rest (bucket, node, degree, component): the pairs (a, b), a < b, of nodes of one bucket in different
    components, each once, which by their marks ma, mb (and what else marked has) are possible, and alike if that is given; and full, (bucket, node, degree), the buckets with too many pairs.

    marked: (node, marks, ...). Nodes outside the bucket's largest component meet all others, so each pair of different components does.
    A pair that several buckets share leaves the smallest of them alone: what is not possible or alike, or was met before, never becomes a row.
    """
    sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all"))
    sized = rest.join(sizes.select("bucket", F.col("m.component").alias("big"), (F.col("all") - F.col("m.c")).alias("out"), "all"), "bucket")
    small = (F.col("out") * F.col("all")) <= PAIRS
    own = F.collect_list("bucket").over(Window.partitionBy("node"))  # a node has few buckets
    few = sized.where(small).select("bucket", "node", "component", "big", own.alias("own")).join(marked, "node")
    named = {"node": "", "component": "c", "own": "o"} | {c: c[0] for c in marked.columns if c != "node"}
    one, two = (few.select("bucket", "big", *[F.col(c).alias(k + x) for c, k in named.items()]) for x in "ab")
    before = F.exists("oa", lambda z: (z < F.col("bucket")) & F.array_contains("ob", z))
    meets = F.expr("ca != cb and (cb = big or a < b)") & possible & ~before
    # a merge join holds a bucket's rows of its right side: the nodes outside the largest component, 1,024 at most
    met = two.drop("big").join(one.where("ca != big"), "bucket").where(meets if alike is None else meets & alike)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sized.where(~small).select("bucket", "node", "degree")


def rare_pairs(tokens: DataFrame, percent: int, holds: list | None = None) -> DataFrame:
    """Pairs (a, na, b, nb) of sets in different components that hold all with a Jaccard similarity of percent or more.

    tokens: node, n (its number of tokens), component, h. Every set is ordered from the rarest token on. With t = percent
    / 100, sets of x and y tokens that alike share o = t / (1 + t) * (x + y), so their first common token stands in either
    before the last o. A token of the smaller set goes to the key of its size class, a token of the larger one to those
    classes that its place allows. At each key the sets of the largest component meet only the sets of other ones.
    """
    rarity = tokens.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    # a token of one set alone meets nothing; as the rarest it stands before all others, so places are counted from the end
    common = tokens.join(rarity, "h").withColumn("back", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("f"), F.desc("h"))))
    left = F.col("back")  # tokens from this one to the last
    t = percent / 100
    near = 1e-9
    size_class = lambda x: F.floor(F.log(x) / math.log(1.02) + near)
    need = lambda x, y: t / (1 + t) * (x + y)
    placed = staged(common.select("node", "n", "component", "h", "back").where(left >= need(F.col("n"), t * F.col("n")) - near), "rare-shingles")
    if holds is not None:
        holds.append(placed)
    small = placed.where(left >= need(F.col("n"), F.col("n")) - near).withColumn("class", size_class(F.col("n")))
    most = F.least(left * (1 + t) / t - F.col("n"), F.col("n").cast("double"))
    large = placed.withColumn("class", F.explode(F.sequence(size_class(t * F.col("n") - near), size_class(most + near))))
    big = small.select("h", "class", "component").groupBy("h", "class", "component").agg(F.count("*").alias("c"))
    big = big.groupBy("h", "class").agg(F.max(F.struct("c", "component"))["component"].alias("big"))
    small, large = small.join(big, ["h", "class"]), large.join(big, ["h", "class"])

    def meet(s: DataFrame, x: DataFrame) -> DataFrame:
        a = s.select("h", "class", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("back").alias("ra"))
        b = x.select("h", "class", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("back").alias("rb"))
        on = (a["h"] == b["h"]) & (a["class"] == b["class"]) & F.expr("ca != cb and na <= nb") & (F.least("ra", "rb") >= need(F.col("na"), F.col("nb")) - near)
        return a.join(b, on).select("a", "na", "b", "nb")

    other = F.col("component") != F.col("big")
    return meet(small.where(other), large).union(meet(small.where(~other), large.where(other)))
