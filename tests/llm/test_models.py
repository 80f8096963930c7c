"""Models, rules and line dedup on small cases, against brute force and numeric gradients."""

import math
import re
from collections import Counter

import numpy as np
from loomdoc.llm import recurrent_lm as lm
from loomdoc.llm.line_dedup import drop_lines
from loomdoc.llm.quality_rules import judge
from loomdoc.llm.resampling import resample

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"


def test_gradients():
    p, rng = lm.unpacked(lm.start()), np.random.default_rng(1)
    xs, ys, h = rng.integers(0, lm.SLOTS, (3, 4)), rng.integers(0, lm.SLOTS, (3, 4)), rng.normal(size=(4, lm.HIDDEN))
    xs[1, 2] = 0  # an end
    g = lm.gradients(p, h, xs, ys)[0]
    for k in lm.SHAPES:
        i = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        ends = []
        for d in (1e-5, -1e-5):
            p[k][i] += d
            ends.append(lm.gradients(p, h, xs, ys)[2])
            p[k][i] -= d
        assert math.isclose(g[k][i], (ends[0] - ends[1]) / 2e-5, rel_tol=1e-4)


def test_lm_scores(spark):
    """All columns by plain code, token by token; the same however the table is split, with many shards and a small table of frequent words."""
    import zlib

    spaces = [" ", "\n", "\t ", "  "]
    rows = [(i, None if i % 9 == 8 else spaces[i % 4] * (i % 5 == 4) + f"the Cat {i % 13} sat{spaces[i % 4]}on mat {i} \u00c9 the" * (i % 6)) for i in range(120)] + [(3, "the twin"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as row", "2 as slots", "3 as w")
    options = {"shard": 200, "top": 12}
    out = lm.score_documents(docs.repartition(2), **options)
    assert out.schema["doc_id"].dataType.simpleString() == "int"
    got = sorted(map(tuple, out.collect()), key=str)
    again = sorted(map(tuple, lm.score_documents(docs.repartition(7), **options).collect()), key=str)
    for x, y in zip(got, again, strict=True):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9) and math.isclose(x[6], y[6], rel_tol=1e-6)

    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lm.END]) for i, t in rows]
    held = [None if i is None else zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in words]
    c = Counter(w for (_, ws), h in zip(words, held, strict=True) if h is False for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted([(i, h, len(ws), sum(x in c for x in ws), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws)) for (i, ws), h in zip(words, held, strict=True)], key=str)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9)


def test_lm_network():
    """Scores of whole documents by a plain loop over tokens; probabilities of all slots add up to 1."""
    rng = np.random.default_rng(2)
    p = lm.unpacked(rng.normal(0, 0.5, lm.SIZE))
    docs = [np.append(rng.integers(1, lm.SLOTS, n), 0) for n in (0, 3, 40, 1, 17)]
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    softmax = lambda a: np.exp(a) / np.exp(a).sum()
    for doc, got in zip(docs, lm.network_scores(p, docs), strict=True):
        h, score = np.zeros(lm.HIDDEN), 0.0
        for y in doc:
            score += math.log10(softmax(h @ p["C"] + p["c"])[y // lm.MEMBERS] * softmax(h @ p["M"][y // lm.MEMBERS] + p["m"][y // lm.MEMBERS])[y % lm.MEMBERS])
            a, u, k = p["E"][y], h @ p["U"], lm.HIDDEN
            z, r = sigmoid(a[:k] + u[:k]), sigmoid(a[k : 2 * k] + u[k : 2 * k])
            new = np.tanh(a[2 * k :] + r * u[2 * k :])
            h = ((1 - z) * new + z * h) * (y != 0)
        assert math.isclose(got, score, rel_tol=1e-9)
    every = lm.log_probabilities(p, np.tile(rng.normal(size=lm.HIDDEN), (lm.SLOTS, 1)), np.arange(lm.SLOTS))
    assert math.isclose(np.exp(every).sum(), 1)


def test_lm_beats_base(spark):
    """Held-out text of sf0.01 gets a higher probability than by the base."""
    out = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"base_score": "sum", "score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"] + 1000


def test_lm_edges(spark):
    docs = spark.createDataFrame([(5, "a"), (5, None), (5, "")], "doc_id long, text string")
    assert lm.score_documents(docs.limit(0)).collect() == []
    import zlib

    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.score_documents(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0 for r in got) and len(got) == 3


def test_quality_rules(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (4, "a b"), (5, f"{TEXT}\n{TEXT}\n#x"), (6, "z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as score")
    got = {r.doc_id: r for r in judge(docs, docs.where("doc_id = 1").select("doc_id")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert got[5].n_dup_lines == 1 and got[5].n_symbols == 1
    assert judge(docs.limit(0), docs.select("doc_id")).collect() == []


def test_resampling_size(spark):
    docs = spark.createDataFrame([(i, f"{TEXT} {i}") for i in range(40)] + [(50, None)], "doc_id long, text string")
    out = resample(docs, docs.where("doc_id < 9").select("doc_id"), share=0.5)
    assert out.where("kept").count() == 21
    assert resample(docs.limit(0), docs.select("doc_id"), share=0.5).collect() == []


def test_line_dedup(spark):
    other = "nothing here is like the rest of these lines, not by far"
    near = TEXT.replace("omicron", "omikron")
    rows = [(1, f"{TEXT}\n\n{other}"), (2, f"{near}\nhello"), (3, f"{TEXT}\n{TEXT}"), (4, None), (5, "")]
    got = {r.doc_id: r.text for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{TEXT}\n\n{other}", 2: "hello", 3: "", 4: None, 5: ""}


def test_copies_do_not_move_the_cut(spark):
    """A third of the rows are copies of one clean or one bad text: they are kept or dropped as it is, and nothing else changes."""
    rows, marks = [], []
    for i in range(300):
        bad = i % 6 == 0
        words = [f"{'bad' if bad else 'good'}{(i * 7 + k * k) % 40}" for k in range(30)] + [f"word{(i + k) % 30}" for k in range(30)]
        rows.append((i, " ".join(words)))
        if i % 5 < 2:
            marks.append((i, 0 if bad else 1, 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    clean, bad = [next(t for i, t in rows if i % 5 > 1 and (i % 6 == 0) == b) for b in (False, True)]
    base = {r.doc_id: r.kept for r in resample(spark.createDataFrame(rows, "doc_id long, text string"), labels=labels).collect()}
    for copied in (clean, bad):
        more = rows + [(1000 + i, f"{copied} w{i % 3}") for i in range(150)]
        got = {r.doc_id: r.kept for r in resample(spark.createDataFrame(more, "doc_id long, text string"), labels=labels).collect()}
        assert all(got[i] == (copied == clean) for i in range(1000, 1150))
        assert {i: got[i] for i, _ in rows} == base == {i: i % 6 != 0 for i, _ in rows}


def test_no_labels_keep_all(spark):
    docs = spark.createDataFrame([(i, f"{TEXT} {i}") for i in range(5)] + [(9, None)], "doc_id long, text string")
    for marks in ([], [(1, None, None), (2, None, 0)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        assert resample(docs, labels=labels).where("kept").count() == 6
