"""Scores of the n-gram operators by plain code, and the cases of tables."""

import math
import random
import struct
from collections import Counter

import xxhash

from loomdoc.llm.ngram_model import BUCKETS
from loomdoc.llm.quality_rules import THRESHOLD, judge
from loomdoc.llm.resampling import resample

PRIOR = 20.0


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(*values):
    """xxhash64 of a row of strings, integers of 8 bytes, and ("int", 4 bytes); None is left out."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return signed(seed)


def grams(text):
    one = [hashed(w) for w in (text or "").split()]
    return [h % BUCKETS for h in one] + [hashed(a, b) % BUCKETS for a, b in zip(one, [*one[1:], None])]


def ratios(raw, target):
    r, t = Counter(g for x in raw for g in grams(x)), Counter(g for x in target for g in grams(x))
    total_r, total_t = sum(r.values()), sum(t.values())
    return {g: float(f"{math.log(t[g] + PRIOR) - math.log(n * total_t / total_r + PRIOR):.5g}") for g, n in r.items()} if total_t else {}


def corpus():
    r = random.Random(6)
    rows = []
    for i in range(120):
        bad = i % 4 == 3
        rows.append((i, " ".join(f"{'bad' if bad and k % 3 else 'good'}{r.randrange(25)}" for k in range(r.randint(15, 60)))))
    return rows + [(500, None), (501, ""), (7, rows[7][1]), (None, rows[8][1]), (502, "good1 bad1 " * 3000)]


def test_quality_score(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 60) if i % 4 != 3] + [(None,), (0,)], "doc_id long")
    table = ratios([t for _, t in rows], [t for i, t in rows if i is not None and i < 60 and i % 4 != 3])
    got = sorted(judge(docs.repartition(3), target).select("doc_id", "text", "score", "base_failed", "kept").collect(), key=str)
    kept = Counter()
    for r in got:
        n = len((r.text or "").split())
        want = sum(table.get(g, 0.0) for g in grams(r.text)) / (2 * n) if n else 0.0
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-12) and r.kept == (not r.base_failed and r.score >= THRESHOLD)
        kept[r.kept] += 1
    assert len(got) == len(rows) and kept[True] and kept[False]


def test_quality_ties_and_targets(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert judge(docs, none).where("score != 0").count() == 0
    top = judge(docs, docs.where("doc_id < 60").select("doc_id")).where("not base_failed").agg({"score": "max"}).first()[0]
    assert judge(docs, docs.where("doc_id < 60").select("doc_id"), threshold=top).where("kept").count() >= 1


def plain_resample(rows, marks, seed=7):
    best = {}
    for i, quality, toxic in marks:
        if i is not None and quality is not None:
            a, b = best.get(i, (False, False))
            best[i] = (a or quality == 1, b or (quality == 1 and toxic == 0))
    known = [(i, t, *best[i], hashed(i) % 2) for i, t in rows if i in best]
    weigh = lambda t, table: sum(table.get(g, 0.0) for g in grams(t))
    step = lambda w: -math.ceil(math.log1p(-w) * 1000) if w < 0 else math.floor(math.log1p(w) * 1000)
    folds = [ratios([t for _, t, _, _, f in known if f != k], [t for _, t, _, target, f in known if f != k and target]) for k in (0, 1)]
    scored = sorted(((step(weigh(t, folds[f])), good) for _, t, good, _, f in known), reverse=True)
    goods, least, most = sum(g for _, g in scored), None, 0
    for s in {s for s, _ in scored}:
        gain = sum(g for x, g in scored if x >= s) * (len(scored) - goods) - sum(not g for x, g in scored if x >= s) * goods
        if gain > most or gain == most and (least is None or s < least):
            most, least = gain, s
    table = ratios([t for _, t, *_ in known], [t for _, t, _, target, _ in known if target])
    out = []
    for i, t in rows:
        unit = (hashed(i, ("int", seed)) % (1 << 52) + 0.5) / (1 << 52)
        out.append((i, weigh(t, table), weigh(t, table) - math.log(-math.log(unit))))
    k = sum(step(w) >= least for _, w, _ in out)
    key = [math.floor((n + (1 << 30)) * (1 << 24)) for _, _, n in out]
    cut = sorted(key, reverse=True)[k - 1]
    return [(i, w, n, x >= cut) for (i, w, n), x in zip(out, key, strict=True)]


def test_resampling(spark):
    rows = corpus()
    marks = [(i, int(i % 4 != 3), int(i % 12 == 0)) for i in range(0, 120, 2)] + [(i, int(i % 4 != 3), 0) for i in range(3, 60, 4)] + [(1, None, 0), (None, 1, 0), (3, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as log_weight", "3 as w")
    out = resample(docs.repartition(5), labels=spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = sorted(((r.doc_id, r.log_weight, r.noisy, r.kept) for r in out.collect()), key=str)
    want = sorted(plain_resample(rows, marks), key=str)
    assert len(got) == len(want) and {x[3] for x in got} == {True, False}
    for x, y in zip(got, want, strict=True):
        assert x[0] == y[0] and x[3] == y[3] and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(x[2], y[2], rel_tol=1e-9, abs_tol=1e-9)
    assert out.where("key = 1 and w = 3").count() == len(rows)
    sampled = resample(docs, labels=spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), most=40)
    assert sampled.count() == len(rows) and sampled.where("kept").count() > 0
    assert resample(docs, labels=spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")).where("kept").count() == 0


def test_components(spark):
    from loomdoc.llm.components import components

    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links + links[:20] + [(b, a) for a, b in links[:9]], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rounds_carry_components(spark, monkeypatch):
    """A round starts from the components found so far: it reads their stars and its own links, not the links of all rounds."""
    from loomdoc.llm import components as c
    from loomdoc.llm.set_join import hub_links

    rows, links, read = [(b, n, 100 - n) for b in (1, 2) for n in range(12 * b)], [], []

    def verified(pairs):
        new = sorted((r.a, r.b) for r in pairs.collect() if (r.b - r.a) % 3 == 0)
        links.append(new)
        return spark.createDataFrame(new, "a long, b long")

    def kept(df, label, *more, f=c.staged):
        out = f(df, label, *more)
        if label == "links":
            read.append({(r.v, r.u) for r in out.collect()})
        return out

    monkeypatch.setattr(c, "staged", kept)
    found, rest = hub_links(spark.createDataFrame(rows, "bucket long, node long, degree long"), verified)
    assert sorted((r.node, r.component) for r in found.collect()) == [(n, n % 3) for n in range(24)]
    assert {(r.node, r.component) for r in rest.collect()} <= {(n, n % 3) for n in range(24)}
    assert len(links) == 3 and read[0] == set(links[0])
    for before, new, now in zip([links[0], links[0] + links[1]], links[1:], read[1:], strict=True):
        assert now == set(new) | {(n % 3, n) for p in before for n in p if n != n % 3}


def test_trim(spark):
    """The driver's JVM gives freed native memory back when shuffle files are swept."""
    import gc

    from loomdoc.llm import common

    said, f = [], common.trim
    common.trim = lambda s: said.append(f(s))
    try:
        common.sweep(spark)
    finally:
        common.trim = f
    gc.collect()
    assert len(said) == 1 and said[0].startswith("Trim native heap")
