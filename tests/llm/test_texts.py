"""Operators that work text by text, against the public libraries, plain searches and exact round trips."""

import hashlib
import random
import re
import zlib

import pytest

from loomdoc.llm.queries import op2_token_counts, op3_byte_bpe, op4_license_scan, op6_best_fit_packing, op8_media_columns

public = pytest.importorskip("public_tokenizers")
PARTS = ["the ", "Under the MIT license: MIT; ", "under the mit license", "Apache License, Version 2 ", "cc by nc ", "CC-BY-NC 4.0", "mit license mit license ", "\n", "\r\n", "  ", "\t", " ", " ", " ", "\u0085", "\x0b\x0c", "\x00", "\x1c", "é", "é", "ß", "ﬁ", "漢字", "かな", "한글", "👩‍👩‍👧", "‍", "▁", "<s>", "</s>", "<unk>", "<pad>", "[CLS]", "[UNK]", "[MASK]", "<|endoftext|>", "<0x41>", "don't", "I'LL", "1234567", "3.14", "...", "!!!", "a" * 300, "ab" * 90, "_x_", "﻿", "�", "İI", "$%&", "x", " y", "\U0010ffff"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(None, None), (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "a " * 5000), (6, "zq" * 3000), (7, "x"), (7, "x")]
    rows += [(10 + i, "".join(r.choice(PARTS) for _ in range(r.randint(1, 25)))) for i in range(400)]
    rows += [(1000 + x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as length", "3 as _r", "4 as piece").write.parquet(f"{folder}/documents.parquet")
    return folder, [(i, t or "") for i, t in rows]


def same(df, rows, columns):
    order = lambda x: tuple((v is not None, v) for v in x)
    got, want = sorted(map(tuple, df.select(columns).collect()), key=order), sorted(rows, key=order)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, (len(wrong), wrong[:3])


def test_token_counts(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = [(i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in table[1]]
    same(op2_token_counts(spark, table[0]), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_byte_bpe(spark, table):
    import numpy as np
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=load_tiktoken_bpe(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in table[1]:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same(op3_byte_bpe(spark, table[0]), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_license_base(spark, table):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = []
    for i, t in table[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    out = op4_license_scan(spark, table[0])
    same(out, want, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])
    for r in out.collect():
        found = r.labels.split(",") if r.labels else []
        assert found == sorted(set(found)) and set(filter(None, r.base_labels.split(","))) <= set(found) and 0 <= r.score <= 1


def test_license_gate():
    """Scans behind the keyword gate agree with scans without it, on texts made from the rules' own regexes."""
    from dataclasses import replace
    from re import _parser

    from loomdoc.llm.licenses import Scanner, rules

    r = random.Random(4)

    def sample(nodes):
        out = ""
        for op, arg in nodes:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "SUBPATTERN":
                out += sample(arg[3])
            elif kind == "BRANCH":
                out += sample(r.choice(arg[1]))
            elif kind == "MAX_REPEAT":
                out += "".join(sample(arg[2]) for _ in range(r.choice([arg[0], min(arg[1], arg[0] + 1)])))
            elif kind == "IN":
                k, v = r.choice(arg)
                out += chr(v) if str(k) == "LITERAL" else chr(r.randint(*v)) if str(k) == "RANGE" else "q"
        return out

    gated, whole = Scanner(), Scanner([replace(x, keywords=frozenset({b"zz"}), also=frozenset()) for x in rules()])
    texts = ["licensed as BSD 3-Clause", "Licence: BSD 3-Clause", "licensed under the terms of the Common Public License version 1.0"]
    texts += [sample(_parser.parse(x.pattern.pattern.decode())) for x in gated.rules for _ in range(30)]
    wrong = [t for t in texts if gated.scan(f"{t} zz") != whole.scan(f"{t} zz")]
    assert not wrong, (len(wrong), wrong[:5])
    assert all(gated.scan(t)[5] for t in texts[:3])


def test_packing(spark, table):
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = []
    for i, t in table[1]:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4")
            want.append((i, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    out = op6_best_fit_packing(spark, table[0]).cache()
    same(out, want, ["doc_id", "piece", "start", "length", "ids_crc32"])
    places: dict = {}
    for r in out.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1


def test_media_round_trip(spark, table):
    want = []
    for i, t in table[1]:
        raw = t.encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload = raw.ljust(size, b"\0")
        want.append((i, len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    out = op8_media_columns(spark, table[0])
    same(out, want, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"])
    by_text: dict = {}
    for r in out.collect():
        assert len(r.media_sha256) == 64 and r.media_bytes >= r.payload_bytes
        assert by_text.setdefault(r.payload_sha256, r.media_sha256) == r.media_sha256


def test_media_tag_in_a_frame():
    """The bytes of an ID3v1 tag's start are no tag inside the last frames; a tag after them is one."""
    from loomdoc.llm.mpeg import read_stream, write_stream

    for size in range(640, 2688, 64):
        for k in range(3):
            payload = (b"TAG" * 900)[k : k + size]
            media = write_stream(payload)
            assert read_stream(media).payload == payload
            s = read_stream(media + b"TAG" + b"title".ljust(125, b"\0"))
            assert s.payload == payload and s.tags["id3v1:title"] == "title"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (op2_token_counts, op3_byte_bpe, op4_license_scan, op6_best_fit_packing, op8_media_columns):
        assert query(spark, str(tmp_path)).collect() == []
