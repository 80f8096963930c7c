"""License scans: ordered signature rules.

Hundreds of regexes run over a text's words (ASCII letters lower-cased, joined by one space), each only where one of
its keywords is among the words. Overlapping detections are resolved by priority: a detection inside the interval of an
accepted one of the same or a higher priority is suppressed. The three base phrases are looked up beside the rules and
always keep their labels.

Cases. Null or empty text: 0 words, no labels, score 0. Very long texts: one pass for the words, regexes only behind the
keyword gate. Ties: the earlier, then the longer detection, then the label's order. Repeated rows and extra columns:
each row stands for itself, other columns pass through unread.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column

from loomdoc.llm.common import per_text

#: Bytes of words stay (A-Z as a-z), all others become spaces.
TO_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# label | keywords, any of which must be among the words | the license's name | its SPDX identifier's words
NAMES = """
mit | mit expat | (?:mit|expat)(?: x11)? | mit
apache-2 | apache asl | (?:apache|asl)(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | apache 2 0
apache-1.1 | apache | apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1 | apache 1 1
apache-1.0 | apache | apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 0 | apache 1 0
bsd-2-clause | bsd freebsd | (?:(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|bsd simplified)|freebsd) | bsd 2 clause
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) | bsd 3 clause
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd) | bsd 4 clause
0bsd | 0bsd bsd | (?:0bsd|zero clause bsd|bsd zero clause) | 0bsd
isc | isc | isc | isc
gpl-1 | gpl gnu general | (?:gnu )?(?:gpl|general public)(?: licen[cs]e)?(?: version| v)? ?1(?: 0)? | gpl 1 0
gpl-2 | gpl gplv2 gnu general | (?:gnu )?(?:gplv2|(?:gpl|general public)(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?) | gpl 2 0
gpl-3 | gpl gplv3 gnu general | (?:gnu )?(?:gplv3|(?:gpl|general public)(?: licen[cs]e)?(?: version| v)? ?3(?: 0)?) | gpl 3 0
lgpl-2 | lgpl gnu lesser library | (?:gnu )?(?:lgpl|(?:lesser|library) general public)(?: licen[cs]e)?(?: version| v)? ?2 0 | lgpl 2 0
lgpl-2.1 | lgpl gnu lesser | (?:gnu )?(?:lgpl|lesser general public)(?: licen[cs]e)?(?: version| v)? ?2 1 | lgpl 2 1
lgpl-3 | lgpl lgplv3 gnu lesser | (?:gnu )?(?:lgplv3|(?:lgpl|lesser general public)(?: licen[cs]e)?(?: version| v)? ?3(?: 0)?) | lgpl 3 0
agpl-3 | agpl agplv3 affero | (?:gnu )?(?:agplv3|(?:agpl|affero general public)(?: licen[cs]e)?(?: version| v)? ?3(?: 0)?) | agpl 3 0
mpl-1.1 | mpl mozilla | (?:mpl|mozilla public)(?: licen[cs]e)?(?: version| v)? ?1 1 | mpl 1 1
mpl-2 | mpl mozilla | (?:mpl|mozilla public)(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | mpl 2 0
epl-1 | epl eclipse | (?:epl|eclipse public)(?: licen[cs]e)?(?: version| v)? ?1(?: 0)? | epl 1 0
epl-2 | epl eclipse | (?:epl|eclipse public)(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | epl 2 0
edl-1 | edl eclipse | (?:edl|eclipse distribution)(?: licen[cs]e)?(?: version| v)? ?1(?: 0)? | edl 1 0
cddl-1.0 | cddl distribution | (?:cddl|common development and distribution)(?: licen[cs]e)?(?: version| v)? ?1 0 | cddl 1 0
cddl-1.1 | cddl distribution | (?:cddl|common development and distribution)(?: licen[cs]e)?(?: version| v)? ?1 1 | cddl 1 1
cpl-1 | cpl common | (?:cpl|common public)(?: licen[cs]e)?(?: version| v)? ?1(?: 0)? | cpl 1 0
eupl-1.1 | eupl union | (?:eupl|european union public)(?: licen[cs]e)?(?: version| v)? ?1 1 | eupl 1 1
eupl-1.2 | eupl union | (?:eupl|european union public)(?: licen[cs]e)?(?: version| v)? ?1 2 | eupl 1 2
ms-pl | ms microsoft | (?:ms pl|microsoft public) | ms pl
ms-rl | ms microsoft | (?:ms rl|microsoft reciprocal) | ms rl
artistic-1 | artistic | artistic(?: licen[cs]e)?(?: version| v)? ?1(?: 0)? | artistic 1 0
artistic-2 | artistic | artistic(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | artistic 2 0
zlib | zlib | zlib(?: libpng)? | zlib
libpng | libpng | libpng | libpng
bsl-1.0 | boost bsl | (?:bsl|boost(?: software)?)(?: licen[cs]e)?(?: version| v)? ?1 0 | bsl 1 0
busl-1.1 | busl bsl business | (?:busl|bsl|business source)(?: licen[cs]e)?(?: version| v)? ?1 1 | busl 1 1
sspl-1 | sspl side | (?:sspl|server side public)(?: licen[cs]e)?(?: version| v)? ?1? | sspl 1 0
elastic-2 | elastic | elastic(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | elastic 2 0
polyform-nc | polyform | polyform noncommercial | polyform noncommercial 1 0 0
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | wtfpl | wtfpl(?: 2)? | wtfpl
postgresql | postgresql | postgresql | postgresql
python-2 | psf python | (?:psf|python(?: software foundation)?)(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | python 2 0
php-3.01 | php | php(?: licen[cs]e)?(?: version| v)? ?3 01 | php 3 01
ruby | ruby | ruby | ruby
openssl | openssl | openssl | openssl
w3c | w3c | w3c(?: software)? | w3c
ofl-1.1 | ofl sil font | (?:ofl|sil open font|open font)(?: licen[cs]e)?(?: version| v)? ?1 1 | ofl 1 1
odbl-1 | odbl odc database | (?:odbl|open(?: data commons open)? database)(?: licen[cs]e)?(?: version| v)? ?1? | odbl 1 0
pddl-1 | pddl | pddl(?: version| v)? ?1? | pddl 1 0
ncsa | ncsa illinois | (?:ncsa|university of illinois ncsa) | ncsa
upl-1 | upl universal | (?:upl|universal permissive)(?: licen[cs]e)?(?: version| v)? ?1? | upl 1 0
afl-3 | afl academic | (?:afl|academic free)(?: licen[cs]e)?(?: version| v)? ?3(?: 0)? | afl 3 0
osl-3 | osl open | (?:osl|open software)(?: licen[cs]e)?(?: version| v)? ?3(?: 0)? | osl 3 0
ecl-2 | ecl educational | (?:ecl|educational community)(?: licen[cs]e)?(?: version| v)? ?2(?: 0)? | ecl 2 0
cecill-2.1 | cecill | cecill(?: version| v)? ?2 1 | cecill 2 1
mulan-psl-2 | mulan mulanpsl | mulan ?psl(?: version| v)? ?2 | mulanpsl 2 0
gfdl-1.3 | gfdl gnu documentation | (?:gnu )?(?:gfdl|free documentation)(?: licen[cs]e)?(?: version| v)? ?1 3 | gfdl 1 3
gfdl-1.2 | gfdl gnu documentation | (?:gnu )?(?:gfdl|free documentation)(?: licen[cs]e)?(?: version| v)? ?1 2 | gfdl 1 2
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])? | cc by nc sa 4 0
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])? | cc by nc nd 4 0
cc-by-nc | cc | cc by nc(?: [1-4] [05])? | cc by nc 4 0
cc-by-sa | cc | cc by sa(?: [1-4] [05])? | cc by sa 4 0
cc-by-nd | cc | cc by nd(?: [1-4] [05])? | cc by nd 4 0
cc-by | cc | cc by(?: [1-4] [05])?(?! (?:nc|sa|nd)) | cc by 4 0
beerware | beerware beer | beer ?ware | beerware
json | json | json | json
curl | curl | curl | curl
x11 | x11 | x11 | x11
"""

# label | priority | confidence in hundredths | keywords | regex over the words
SIGNATURES = r"""
mit | 100 | 99 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 95 | 95 | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 90 | 90 | copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 100 | 99 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | 101 | 99 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
postgresql | 101 | 99 | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd-3-clause | 100 | 97 | endorse | neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 102 | 99 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg
bsd-2-clause | 90 | 85 | redistribution redistributions | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 85 | 80 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
apache-2 | 100 | 99 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 95 | 97 | apache | apache license version 2 0 january 2004
apache-2 | 90 | 95 | apache | www apache org licenses license 2 0
apache-1.1 | 90 | 90 | apache | this product includes software developed by the apache software foundation
gpl-2 | 100 | 99 | gnu | gnu general public license version 2 june 1991
gpl-3 | 100 | 99 | gnu | gnu general public license version 3 29 june 2007
gpl-2-or-later | 98 | 97 | either | (?:the gnu general public license as published by the free software foundation )?either version 2 of the license or at your option any later version
gpl-3-or-later | 98 | 97 | either | (?:the gnu general public license as published by the free software foundation )?either version 3 of the license or at your option any later version
lgpl-2.1 | 100 | 99 | gnu | gnu lesser general public license version 2 1 february 1999
lgpl-3 | 100 | 99 | gnu | gnu lesser general public license version 3 29 june 2007
agpl-3 | 100 | 99 | affero | gnu affero general public license version 3 19 november 2007
gpl | 40 | 60 | gnu | gnu general public license
lgpl | 45 | 60 | gnu | gnu (?:lesser|library) general public license
agpl | 45 | 60 | gnu affero | gnu affero general public license
gpl | 90 | 90 | gnu | www gnu org licenses gpl
lgpl | 90 | 90 | gnu | www gnu org licenses lgpl
agpl | 90 | 90 | gnu | www gnu org licenses agpl
gpl | 88 | 85 | gnu | you should have received a copy of the gnu general public license along with
lgpl | 88 | 85 | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with
mpl-2 | 100 | 99 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 90 | 90 | mozilla | mozilla org mpl 2 0
mpl-1.1 | 100 | 97 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1 | 90 | 92 | eclipse | www eclipse org legal epl v10
epl-2 | 90 | 92 | eclipse | www eclipse org legal epl (?:v20|2 0)
cddl-1.0 | 95 | 95 | cddl distribution | subject to the terms of the common development and distribution license
unlicense | 100 | 99 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 100 | 99 | public | do what the fuck you want to public license
zlib | 95 | 95 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | 100 | 99 | boost | boost software license version 1 0 august 17th? 2003
bsl-1.0 | 90 | 92 | boost | www boost org license 1 0
ofl-1.1 | 100 | 99 | font | sil open font license version 1 1 26 february 2007
ofl-1.1 | 90 | 92 | sil | scripts sil org ofl
artistic-2 | 90 | 90 | artistic | the artistic license 2 0 copyright
python-2 | 95 | 95 | python | python software foundation license version 2
openssl | 95 | 95 | openssl | this product includes software developed by the openssl project
json | 101 | 95 | good | the software shall be used for good not evil
beerware | 95 | 95 | beer | you can buy me a beer in return
cc0 | 95 | 97 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain-mark | 95 | 95 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-nc-sa | 95 | 97 | creativecommons | creativecommons org licenses by nc sa
cc-by-nc-nd | 95 | 97 | creativecommons | creativecommons org licenses by nc nd
cc-by-nc | 94 | 97 | creativecommons | creativecommons org licenses by nc(?! (?:sa|nd))
cc-by-sa | 95 | 97 | creativecommons | creativecommons org licenses by sa
cc-by-nd | 95 | 97 | creativecommons | creativecommons org licenses by nd
cc-by | 94 | 97 | creativecommons | creativecommons org licenses by(?! (?:nc|sa|nd))
cc-by-nc-sa | 92 | 95 | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | 92 | 95 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc | 91 | 95 | creative | creative commons attribution non ?commercial(?! (?:share|no))
cc-by-sa | 92 | 95 | creative | creative commons attribution share ?alike
cc-by-nd | 92 | 95 | creative | creative commons attribution no ?deriv(?:ative)?s?
cc-by | 90 | 92 | creative | creative commons attribution(?! (?:non|no|share))
creative-commons | 40 | 50 | creative | creative commons licen[cs]e
public-domain | 60 | 70 | public | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
proprietary | 70 | 80 | rights | all rights reserved
proprietary | 80 | 90 | proprietary | proprietary and confidential
proprietary | 85 | 92 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
commercial | 60 | 70 | commercial | (?:under|with) a commercial licen[cs]e
noncommercial | 60 | 70 | noncommercial non | (?:for )?non ?commercial (?:use|purposes) only
research-only | 60 | 70 | research | for research (?:use|purposes) only
"""

#: How a name stands in a text: priority, confidence in hundredths, further keywords (any of them) or none, the regex around the name.
FORMS = (
    (90, 97, "spdx", r"spdx licen[cs]e identifier {spdx}"),
    (80, 92, "under", r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?"),
    (70, 85, None, r"(?:the )?{name} (?:public )?licen[cs]e"),
    (65, 80, "license licence licensed licenced", r"(?:licen[cs]e|licen[cs]ed) (?:is |as |by )?{name}"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keywords: frozenset[bytes]
    also: frozenset[bytes]
    pattern: re.Pattern


def rules() -> list[Rule]:
    out = []

    def add(label: str, priority: int, hundredths: int, keys: str, also: str | None, pattern: str) -> None:
        whole = re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )")
        out.append(Rule(label, priority, hundredths / 100, frozenset(k.encode() for k in keys.split()), frozenset(k.encode() for k in (also or "").split()), whole))

    for line in SIGNATURES.strip().splitlines():
        label, priority, hundredths, keys, pattern = line.split(" | ")
        # a word cut short at the end stands for its continuations
        add(label, int(priority), int(hundredths), keys, None, pattern + (r"\S*" if pattern[-1].isalpha() else ""))
    for line in NAMES.strip().splitlines():
        label, keys, name, spdx = line.split(" | ")
        if version := re.search(r" \?(\d)", name):  # which may be written to the last word of the name: gpl2
            keys += "".join(f" {k}{version[1]}" for k in keys.split())
        for priority, hundredths, also, form in FORMS:
            add(label, priority, hundredths, keys if "{name}" in form else spdx.split()[0], also, form.format(name=f"(?:{name})", spdx=f"{spdx}(?: only| or later)?"))
    for phrase, label in BASE.items():
        add(label, 99, 95, phrase.split()[2] if label == "mit" else phrase.split()[0], None, phrase)
    return out


@dataclass(frozen=True)
class Detection:
    label: str
    first: int  # words from 0
    last: int
    priority: int
    confidence: float


def uncontained(found: list[Detection]) -> list[Detection]:
    """Of detections by falling priority, those that lie in no accepted one before them.

    Only the widest accepted intervals are looked at. By their starts their ends rise as well, so the last one that starts
    no later than a detection tells whether any holds it.
    """
    accepted: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in found:
        i = bisect_right(starts, d.first)
        if i and ends[i - 1] >= d.last:
            continue
        accepted.append(d)
        lo, hi = bisect_left(starts, d.first), bisect_right(ends, d.last)
        starts[lo : max(lo, hi)], ends[lo : max(lo, hi)] = [d.first], [d.last]
    return accepted


class Scanner:
    def __init__(self, table: list[Rule] | None = None):
        self.rules = rules() if table is None else table
        self.by_key: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                self.by_key.setdefault(k, []).append(i)
        self.keys = frozenset(self.by_key)
        self.base = [(b" " + p.encode() + b" ", p.encode().split(), label) for p, label in BASE.items()]

    def detect(self, words: list[bytes], text: bytes, spaces: list[int], hits: frozenset[bytes]) -> list[Detection]:
        """Accepted detections; text: the words with a space before and after each, spaces: where these stand."""
        found: list[Detection] = []
        present = None
        for i in sorted({i for k in hits for i in self.by_key[k]}):
            r = self.rules[i]
            if r.also:
                present = present or frozenset(words)
                if r.also.isdisjoint(present):
                    continue
            for m in r.pattern.finditer(text):
                first = bisect_left(spaces, m.start()) - 1
                found.append(Detection(r.label, first, bisect_left(spaces, m.end()) - 1, r.priority, r.confidence))
        found.sort(key=lambda d: (-d.priority, d.first, d.first - d.last, d.label))
        return sorted(uncontained(found), key=lambda d: (d.first, d.last, d.label))

    def scan(self, text: str) -> tuple:
        words = text.encode().translate(TO_WORDS).split()
        if self.keys.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0
        joined = b" " + b" ".join(words) + b" "
        spaces = [0, *accumulate(len(w) + 1 for w in words)]
        starts, base = [], set()
        for phrase, _, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                starts.append(bisect_left(spaces, at))
                base.add(label)
                at = joined.find(phrase, at + 1)
        accepted = self.detect(words, joined, spaces, self.keys.intersection(words))
        miss = 1.0
        best: dict[str, float] = {}
        for d in accepted:
            best[d.label] = max(best.get(d.label, 0.0), d.confidence)
        for label in sorted(best):
            miss *= 1 - best[label]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | best.keys())), round(1 - miss, 6)


_scanner: list[Scanner] = []


def scan(text: str) -> tuple:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0].scan(text)


def license_struct(text: Column) -> Column:
    """A struct column of what the whole text says of licenses; first_word and last_word: starts of the base phrases."""
    return per_text(text, lambda: scan, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
