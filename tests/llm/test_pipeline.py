"""The pipeline's stages on awkward tables and, stage by stage, against plain code on a small corpus."""

import random
import re
import zlib

import pytest

import corpus_pipeline as cp
from loomdoc.llm.common import staged

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = [f"good{i}" for i in range(40)]
BAD = [f"bad{i}" for i in range(40)]


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad documents, labels for two in five, near copies, shared passages, nulls and repeated rows."""
    r, rows, marks = random.Random(8), [], []
    passage = sentence(r, GOOD, 30)
    for i in range(200):
        bad = i % 5 == 4
        text = "\n".join(sentence(r, BAD if bad else GOOD, 30) for _ in range(3))
        if not bad and i % 10 == 1:
            text += f"\n{passage}" + "!" * (i % 3)
        rows.append((i, text))
        if i % 10 < 5:
            marks.append((i, 0 if bad else 1, int(i % 20 == 2)))
    rows += [(300 + i, rows[i][1] + " good1 good2 good3") for i in (0, 2, 5)] + [(310, rows[0][1]), (320, None), (321, ""), (322, "good1 good2"), rows[3], rows[3], (330, "good3 " * 6000), (None, sentence(r, GOOD, 90))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def near_copies(rows, percent, size):
    """Groups by all pairs of sets."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return [find(i) for i in range(len(rows))]


def test_stages(spark, corpus):
    folder, rows = corpus
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    first = staged(cp.quality_classifier(spark, docs, folder), "t")
    assert first.columns == docs.columns
    got = of(first)
    assert all(x in rows for x in got) and not any("bad" in (t or "") for _, t in got)
    assert len([x for x in got if x[1] and "good" in x[1]]) >= 0.97 * len([x for x in rows if x[1] and "good" in x[1]])

    second = staged(cp.quality_rules(spark, first, folder), "t")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def passes(t):
        w = words(t)
        seen, hit = {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for ks in seen.values():
            hit |= {k + j for k in ks if len(ks) > 1 for j in range(8)}
        return len(w) >= 20 and 100 * len(hit) <= 30 * len(w)

    assert second.columns == docs.columns and of(second) == [x for x in got if passes(x[1])]

    third = staged(cp.line_dedup(spark, second, folder), "t")
    assert third.columns == docs.columns and all(r.n_chars == len(r.text) for r in third.collect())
    whole = sorted(of(second), key=lambda x: (x[0] is None, key(x)))
    lines = {(i, n): s for i, t in whole if i is not None for n, s in enumerate(t.split("\n"))}
    places = sorted(lines)
    sets = [(p, {s[k : k + 8] for k in range(len(s) - 7)}) for p in places for s in [lines[p]]]
    head = near_copies(sets, 80, 8)
    gone = {places[k] for k, h in enumerate(head) if h != k}
    want = sorted(((i, t if i is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in whole), key=key)
    assert gone and of(third) == want

    fourth = staged(cp.minhash_near_dedup(spark, third, folder), "t")
    left = sorted(of(third), key=lambda x: (x[0] is None, key(x)))
    sets = [(i, {tuple(words(t.lower())[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} if words(t) else set()) for i, t in left]
    head = near_copies(sets, 80, 5)
    assert fourth.columns == docs.columns and of(fourth) == sorted((x for k, x in enumerate(left) if left[head[k]][0] == x[0]), key=key)

    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = []
    for i, t in of(fourth):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    packed = cp.best_fit_packing(spark, fourth, folder).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == sorted(want, key=str)
    ends: dict = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(x[3] for x in want) // 2048) + 1


def test_run(spark, corpus):
    """run() gives the last stage's rows."""
    out = cp.run(spark, corpus[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_awkward_tables(spark, corpus, tmp_path):
    """Empty tables, and extra columns with the names that operators use."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    names = ["node", "key", "text_", "line", "kept", "score", "_id", "_lines", "_gone", "_stay", "h", "component", "n_lines", "fold", "bucket", "rep", "digest"]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), corpus[0]).collect() == [], name
    some = docs.where("doc_id < 12 or doc_id >= 320").selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(names)])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, some, corpus[0])
        assert out.columns == some.columns, name
        plain = stage(spark, some.select(docs.columns), corpus[0])
        assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, plain.collect())), name
        clash = {"kept", "score", "n_lines"}
        assert out.select(*[c for c in names if c not in clash]).distinct().count() <= 1, name
