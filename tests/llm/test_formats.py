"""Licenses, audio frames and tokenizer rules on awkward inputs."""

import json
import random
import struct
import time

import pytest

from loomdoc.llm import licenses, mpeg

public = pytest.importorskip("public_tokenizers")


def test_suppression():
    r = random.Random(1)
    for _ in range(3000):
        found = [licenses.Detection("x", a, a + r.randint(0, 6), r.randint(0, 3), 0.5) for a in [r.randint(0, 12) for _ in range(r.randint(0, 12))]]
        found.sort(key=lambda d: (-d.priority, d.first, d.first - d.last, d.label))
        accepted: list = []
        for d in found:
            if not any(a.first <= d.first and d.last <= a.last for a in accepted):
                accepted.append(d)
        assert accepted == licenses.uncontained(found)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the GPL version 2.", "gpl-2"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("under the MIT license", "mit"),
        ("Apache License, Version 2.0", "apache-2"),
        ("CC BY-NC 4.0", "cc-by-nc"),
        ("This is released into the public domain. All rights reserved.", "proprietary,public-domain"),
        ("nothing of the kind", ""),
    ],
)
def test_labels(text, labels):
    assert licenses.scan(text)[5] == labels


def test_license_time():
    """Twice the repeats take about twice the time."""
    text = "licensed under the mit license and apache license version 2 "
    licenses.scan(text)
    took = []
    for n in (4000, 16000):
        began = time.process_time()
        out = licenses.scan(text * n)
        took.append(time.process_time() - began)
        assert out[1] == 2 * n and out[2:4] == (1, 10 * (n - 1) + 6)
    assert took[1] < 10 * took[0]


def frame(index, rate=0, mono=True, protected=False):
    head = bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | rate << 2, 0xC4 if mono else 0x04))
    return head + bytes(mpeg.header(head).length - 4)


def test_offsets_and_durations():
    sizes = [9, 5, 14, 1, 9]
    frames = [frame(i) for i in sizes]
    junk = b"\x00\xff\x12junk"
    s = mpeg.read_stream(junk + b"".join(frames) + b"\xff\xfb\x90")
    at, want = len(junk), []
    for f in frames:
        want.append(at)
        at += len(f)
    assert s.offsets == want and s.samples == 5 * 1152 and s.duration * 44100 == 5 * 1152 and s.skipped == len(junk) + 3 and s.checked == 0


def test_checksums():
    media = bytearray(mpeg.write_stream(b"x" * 5000))
    s = mpeg.read_stream(bytes(media))
    assert s.checked == len(s.offsets) and not s.bad_checksums and s.payload == b"x" * 5000
    media[s.offsets[2] + 7] ^= 1  # in the side information
    s = mpeg.read_stream(bytes(media))
    assert s.bad_checksums == 1 and s.checked == len(s.offsets)


def test_malformed():
    """Junk, truncation and tables that reach over their frame never raise."""
    r = random.Random(3)
    good = mpeg.write_stream(bytes(range(256)) * 12)
    vbri = b"VBRI" + struct.pack(">HHHIIHHH", 1, 0, 75, 1000, 10, 60000, 1, 4)
    streams = [b"", b"\xff", b"ID3", b"ID3\x04\0\0\x7f\x7f\x7f\x7f", good[:100], b"TAG" + bytes(125)]
    for index in range(1, 15):
        for rate in range(3):
            raw = bytearray(frame(index, rate))
            raw[36:] = (vbri + bytes(len(raw)))[: max(0, len(raw) - 36)]
            streams += [bytes(raw), bytes(raw[:50])]
    body = "\x03payload_bytes\0²".encode()
    tag = b"TXXX" + mpeg.synchsafe(len(body)) + b"\0\0" + body
    streams.append(b"ID3\x04\0\0" + mpeg.synchsafe(len(tag)) + tag + good)
    for _ in range(400):
        x = bytearray(r.choice(streams) + good)
        for _ in range(r.randint(1, 30)):
            x[r.randrange(len(x))] = r.choice([0xFF, 0xFB, 0, r.randrange(256)])
        streams.append(bytes(x[: r.randint(0, len(x))]))
    for x in streams:
        s = mpeg.read_stream(x)
        assert len(s.offsets) == len(s.headers) and s.skipped >= 0
        mpeg.describe(s)


def test_tokenizer_rules():
    """Stretches are cut only where the rules allow it; other tokenizers get whole texts."""
    from loomdoc.llm.packing import WordTokenizer, splits_at_spaces
    import numpy as np
    import pyarrow as pa

    serialised = open(public.path("word_bpe_49k.json"), encoding="utf-8").read()
    rules = json.loads(serialised)
    assert splits_at_spaces(rules)
    changed = [{"pre_tokenizer": None}, {"normalizer": {"type": "NFKC"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "x"}]}}, {"added_tokens": [{**rules["added_tokens"][0], "lstrip": True}]}, {"truncation": {}}]
    assert not any(splits_at_spaces({**rules, **c}) for c in changed)
    texts = ["Some text, don't\n you  know éé", "", "x" * 500, "<|endoftext|> a"]
    for own in (serialised, json.dumps({**rules, "normalizer": {"type": "Lowercase"}, "added_tokens": [{**rules["added_tokens"][0], "lstrip": True}]})):
        t = WordTokenizer(own, limit=5)
        for _ in range(3):
            got = t.ids(pa.array(texts))
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
