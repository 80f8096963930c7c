"""Near-duplicates against all pairs on sf0.001 and on small cases."""

import re
import string

from loomdoc.llm.near_dup import near_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, long), (7, long + " x"), (8, long + " x y z"), (9, "b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as component", "3 as key")
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_rare_pairs(spark):
    """All pairs at the threshold, also where sets of one bucket are mostly unlike and one component is large."""
    import random

    from loomdoc.llm.set_join import rare_pairs

    r = random.Random(5)
    base = list(range(1000, 1040))
    sets = {i: set(r.sample(base, r.randint(30, 40))) | {r.randrange(90) for _ in range(r.randint(0, 6))} for i in range(120)}
    component = {i: 0 if i < 60 else i for i in sets}
    want = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    rows = [(i, len(s), component[i], h) for i, s in sets.items() for h in s]
    got = rare_pairs(spark.createDataFrame(rows, "node long, n long, component long, h long"), 85).collect()
    assert want and want <= {tuple(sorted((x.a, x.b))) for x in got}


def test_star_of_copies(spark):
    """Copies near one text, many of them too far from it and from one another."""
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(146)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_fuzzy_lines(spark):
    """Line links against all pairs, on lines that differ by a few characters."""
    import random

    from loomdoc.llm.line_dedup import drop_lines

    r = random.Random(9)
    bases = ["".join(r.choice("abcdefghij ") for _ in range(120)) for _ in range(4)]
    docs, lines = [], []
    for i in range(40):
        own = []
        for k in range(3):
            c = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 4])):
                c[r.randrange(120)] = r.choice("xyz")
            own.append("".join(c))
            lines.append(((i, k), own[-1]))
        docs.append((i, "\n".join(own)))
    sets = {p: {s[j : j + 8] for j in range(len(s) - 7)} for p, s in lines}
    root = {p: p for p in sets}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [(i, "\n".join(s for k, s in enumerate(t.split("\n")) if find((i, k)) == (i, k))) for i, t in docs]
    got = drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == want


def test_pipeline_stage(spark):
    """The pipeline's stage links at 0.80: 60 words and 12 more share 56 of 68 shingles, 0.82, and 17 more 56 of 73, 0.77."""
    from corpus_pipeline import minhash_near_dedup

    def words(c, n):
        return " ".join(f"{c}{i}" for i in range(n))

    rows = [(1, words("a", 60)), (2, words("a", 72)), (3, words("b", 60)), (4, words("b", 77))]
    assert sorted(r.doc_id for r in minhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == [1, 3, 4]


def test_short_lines(spark):
    """1,000 pairs of lines with 8 of 10 shingles in common: about 2 should share no band."""
    import random

    from loomdoc.llm.line_dedup import drop_lines

    r = random.Random(12)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(17)) for _ in range(1000)]
    rows = [row for i, s in enumerate(lines) for row in ((2 * i, s[:16]), (2 * i + 1, s[1:]))]
    out = drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("doc_id % 2 = 0 and n_dropped > 0").count() == 0
    assert out.where("doc_id % 2 = 1 and n_dropped = 0").count() <= 8


def test_lines_by_all_shingles(spark):
    """Lines whose shingles after spaces all differ, 694 of 854 shingles being equal; and shingles are of characters, not bytes."""
    import random

    from loomdoc.llm.line_dedup import drop_lines

    r = random.Random(4)
    rows = []
    for i in range(20):
        tail = "".join(r.choice(string.ascii_lowercase) for _ in range(700))
        rows += [(2 * i + k, " ".join(r.choice(string.ascii_letters) for _ in range(40)) + " " + tail) for k in (0, 1)]
    wide = "".join(r.choice("aé漢😀🜁ß") for _ in range(17))
    rows += [(40, wide[:16]), (41, wide[1:]), (42, wide[2:13] + "zzzz"), (43, "a"), (44, "a"), (45, "é"), (46, "")]
    out = drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x.doc_id for x in out.where("n_dropped > 0").orderBy("doc_id").collect()] == [*range(1, 40, 2), 41, 44]


def test_lines_leave_no_shuffles(spark, monkeypatch):
    """When a pass of signing lines, of dealing their buckets, or of marking them begins, no shuffle of a job before is left on disk."""
    from loomdoc.llm import line_dedup

    at = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    staged, seen = line_dedup.staged, []

    def watched(df, label, *rest):
        seen.append((label, at.size()))
        return staged(df, label, *rest)

    monkeypatch.setattr(line_dedup, "staged", watched)
    rows = [(i, f"a line of its own that has the number {i * i} in it\nand another one, number {i % 7}") for i in range(200)]
    line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    late = [n for label, n in seen if label in ("line-bands", "line-candidates", "line-marks")]
    assert len(late) > 3 and not any(late)


def test_line_bounds(spark, monkeypatch):
    """Pairs around 0.80 of lines of many lengths, some with repeated shingles: no alike one goes by its marks, most others do;
    and the links are the same by pairs in small buckets and by more hubs and rare shingles in large ones."""
    import random

    from pyspark.sql import functions as F

    from loomdoc.llm import line_dedup, set_join

    r = random.Random(3)
    rows = []
    for i in range(300):
        n = r.choice([3, 12, 40, 150, 600, 3000])
        s = ("abcdefghijkl" * n)[:n] if i % 10 == 0 else "".join(r.choice("abcdefgh ") for _ in range(n))
        cut = int(n * r.choice([0, 0.05, 0.1, 0.2, 0.3]))
        rows.append((i, s, s[cut:] + "".join(r.choice("xyz") for _ in range(r.choice([0, cut // 2])))))
    table = spark.createDataFrame(rows, "node long, sa string, sb string")
    ends = [line_dedup.marks(table.select("node", F.col(f"s{c}").alias("s"))).select("node", F.col("marks").alias(f"m{c}"), F.col("fine").alias(f"f{c}")) for c in "ab"]
    both = table.select("node").join(ends[0], "node").join(ends[1], "node").select("node", line_dedup.possible(80).alias("x"), line_dedup.possible_in_full(80).alias("y"))
    got = {x.node: (x.x, x.y) for x in both.collect()}
    sets = [[{s[j : j + 8] for j in range(max(1, len(s) - 7))} for s in pair] for _, *pair in rows]
    alike = {i for i, (x, y) in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)}
    assert len(got) == 300 and 100 < len(alike) < 250 and all(got[i] == (True, True) for i in alike)
    assert sum(got[i][1] for i in range(300) if i not in alike) < 0.5 * (300 - len(alike))
    docs = spark.createDataFrame([(i, f"{a}\n{b}") for i, a, b in rows], "doc_id long, text string")
    few = sorted(map(tuple, line_dedup.drop_lines(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(set_join, "PAIRS", 0)
    assert few == sorted(map(tuple, line_dedup.drop_lines(docs).select("doc_id", "text").collect()))


def test_open_pairs(spark):
    """Each pair of a bucket's nodes of different components, once; a bucket with too many is given back whole."""
    from itertools import combinations

    from pyspark.sql import functions as F

    from loomdoc.llm import set_join

    rest = [(1, n, 1, c) for n, c in enumerate([0, 0, 0, 3, 4, 4])] + [(2, n, 1, n) for n in (1, 3, 5)] + [(3, n, 1, n) for n in range(10, 1100)]
    marked = spark.createDataFrame([(n, n) for n in range(1100)], "node long, marks long")
    pairs, full = set_join.open_pairs(spark.createDataFrame(rest, "bucket long, node long, degree long, component long"), marked, F.lit(True))
    want = {(x[1], y[1]) for b in (1, 2) for x, y in combinations([z for z in rest if z[0] == b], 2) if x[3] != y[3]}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert sorted(x.node for x in full.collect()) == list(range(10, 1100))


def test_open_pairs_rows(spark):
    """Of 60 lines, 0.6 to 0.75 alike, in six shared buckets, fewer than a third of the pairs become rows; alike ones all do, once."""
    import random

    from loomdoc.llm import line_dedup, set_join

    r = random.Random(5)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(r.random())[2:12] for _ in range(50)]
    lines = [" ".join(w if r.random() > 0.08 else str(r.random())[2:15] for w in base) for _ in range(60)]
    lines += [s[:-20] for s in lines[:10]]
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} for s in lines]
    alike = {(a, b) for a in range(70) for b in range(a + 1, 70) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    rest = spark.createDataFrame([(k, n, 1, n) for k in range(6) for n in range(70)], "bucket long, node long, degree long, component long")
    marked = line_dedup.marks(spark.createDataFrame(list(enumerate(lines)), "node long, s string")).localCheckpoint()
    met = list(map(tuple, set_join.open_pairs(rest, marked, line_dedup.possible(80))[0].collect()))
    assert len(alike) >= 10 and alike <= set(met) and len(met) == len(set(met)) < 70 * 69 / 2 / 3


def test_open_buckets_give_links(spark):
    """Of lines in six shared buckets, mostly 0.6 to 0.79 alike, the open buckets give each alike pair once, and no other row that the bounds allow."""
    import random

    from loomdoc.llm import line_dedup, set_join

    r = random.Random(5)
    base = [r.choice(string.ascii_lowercase) * 3 + str(r.random())[2:12] for _ in range(50)]
    lines = [" ".join(w if r.random() > 0.07 else str(r.random())[2:15] for w in base) for _ in range(60)]
    lines += [s[:-20] for s in lines[:10]]
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} for s in lines]
    want = sorted((a, b) for a in range(70) for b in range(a + 1, 70) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    rest = spark.createDataFrame([(k, n, 1, n) for k in range(6) for n in range(70)], "bucket long, node long, degree long, component long")
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, s string")
    marked = line_dedup.marks(texts).join(texts, "node").localCheckpoint()
    possible = line_dedup.possible(80)
    allowed = set_join.open_pairs(rest, marked, possible)[0].count()
    got = set_join.open_pairs(rest, marked, possible, line_dedup.possible_in_full(80) & line_dedup.alike(80))[0]
    assert sorted(map(tuple, got.collect())) == want and len(want) < allowed


def test_texts_stay(spark, monkeypatch):
    """The rows whose node is asked for, by bits and by a join; by bits no row of texts is dealt out, even where no table is small."""
    from loomdoc.llm import line_dedup

    nodes = [p << 33 | n for p in (0, 1, 300) for n in (*range(20), 32766, 32767, 32768, 70000)]
    classes = spark.createDataFrame([(n, f"s{n}") for n in nodes], "node long, s string")
    asked = spark.createDataFrame([(n, 1) for n in nodes if n % 3 == 0 or n & 32767 == 32767], "node long, degree long")
    want = sorted((n, f"s{n}") for (n, _) in asked.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.chosen(classes, asked)
        assert sorted(map(tuple, out.collect())) == want and "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(line_dedup, "MOST", 1)
    assert sorted(map(tuple, line_dedup.chosen(classes, asked).collect())) == want


def test_lines_signed_flat(spark, monkeypatch):
    """Buckets that several lines share, with their counts, against plain code; no pass explodes the buckets of all bands, and
    marks leave a task as one row for each line, not as one for each of its words."""
    from collections import Counter

    from loomdoc.llm import line_dedup

    rows = [(n, f"some line of text, number {n // 3}, that has {'an even' if n % 2 else 'an odd'} end") for n in range(60)] + [(60, "short"), (61, "x" * 40)]
    texts = spark.createDataFrame(rows, "node long, s string").repartition(3).localCheckpoint()
    signs = line_dedup.bands(texts).localCheckpoint()
    held = [(r.node, b) for r in signs.collect() for x in r[1:] for b in (x if isinstance(x, list) else [x])]
    count = Counter(b for _, b in held)
    plans, staged = [], line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, *rest))
    got = sorted((r.node, r.bucket, r.c) for part in line_dedup.candidates(signs) for r in part.collect())
    assert got == sorted((n, b, count[b]) for n, b in held if count[b] > 1) and len(got) > 60
    assert plans and not any("Generate" in p for p in plans)
    plan = line_dedup.marks(texts)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((.*?), \d+\)", plan) == re.findall(r"hashpartitioning\((node#\d+L), \d+\)", plan) != []
    assert sorted(r.marks for r in line_dedup.marks(texts).collect()) == sorted(max(1, len(s) - 7) for _, s in rows)
