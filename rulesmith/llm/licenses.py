"""License scans by ordered signature rules.

Hand-written regular expressions over the words of a text: names of licences, their usual notices, and sentences of their texts.
Each is gated by a prefilter: strings of which every match of the rule holds one, derived from its pattern, are sought by one
automaton for all rules; a rule without such strings runs on every text. A name that is said to be the licence of something
(`licensed under the ...`) counts for more than a mere name. Detections are ordered by priority, then by length; one whose
interval lies in that of a better one is suppressed.

Defined results: a null text is an empty one: no words, labels '' and score 0; first_word and last_word are null without a
base place; repeated rows and null ids each get their result; an empty table gives no rows; other columns are ignored,
whatever their names. A text of any length is worked on whole, in memory of a few times its size.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_id, rows_of
from .secrets import literals

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Fixed values, one rule a line: label, pattern over words in lower case joined by single spaces. Names may have a version after them.
NAMES = r"""
gpl (?:gnu )?general public licen[sc]e(?: gpl)?
gpl (?:gnu )?gpl ?v?[123]?
gpl licence publique g[ée]n[ée]rale(?: gnu)?
gpl licencia p[uú]blica general(?: de)?(?: gnu)?
lgpl (?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)?
lgpl (?:gnu )?lgpl ?v?[23]?
agpl (?:gnu )?affero general public licen[sc]e(?: agpl)?
agpl (?:gnu )?agpl ?v?3?
gfdl (?:gnu )?free documentation licen[sc]e(?: gfdl)?
gfdl gfdl
apache apache(?: software)? licen[sc]e
apache apache 2 0
apache asl 2 0
mit mit(?: x11)? licen[sc]e
mit expat licen[sc]e
x11 x11 licen[sc]e
bsd bsd(?: style| type| like)? licen[sc]e
bsd bsd licensed
bsd-2-clause (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4-clause (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?
0bsd (?:0bsd|bsd zero clause|zero clause bsd)(?: licen[sc]e)?
mpl mozilla public licen[sc]e(?: mpl)?
mpl mpl ?[12] [01]
epl eclipse public licen[sc]e(?: epl)?
edl eclipse distribution licen[sc]e
cddl cddl
cddl common development and distribution licen[sc]e
cpl common public licen[sc]e
cpal common public attribution licen[sc]e
ipl ibm public licen[sc]e
eupl european union public licen[sc]e
eupl eupl
isc isc licen[sc]e
zlib zlib(?: libpng)? licen[sc]e
libpng libpng licen[sc]e
boost boost software licen[sc]e
artistic (?:perl )?artistic licen[sc]e
unlicense (?:the )?unlicense
wtfpl wtfpl
python python software foundation licen[sc]e
python psf licen[sc]e(?: agreement)?
python python licen[sc]e
postgresql postgresql licen[sc]e
php php licen[sc]e
ruby ruby licen[sc]e
vim vim licen[sc]e
curl curl licen[sc]e
icu icu licen[sc]e
unicode unicode(?: inc)? licen[sc]e agreement
w3c w3c software(?: and document)?(?: notice and)? licen[sc]e
w3c w3c document licen[sc]e
zpl zope public licen[sc]e
openssl openssl licen[sc]e
sleepycat sleepycat licen[sc]e
imagemagick imagemagick licen[sc]e
json json licen[sc]e
beerware beer ?ware licen[sc]e
upl universal permissive licen[sc]e
ms-pl microsoft public licen[sc]e(?: ms pl)?
ms-rl microsoft reciprocal licen[sc]e(?: ms rl)?
nasa nasa open source agreement
osl open software licen[sc]e
afl academic free licen[sc]e
ecl educational community licen[sc]e
qpl q public licen[sc]e
npl netscape public licen[sc]e
apsl apple public source licen[sc]e
intel intel open source licen[sc]e
ncsa (?:university of illinois )?ncsa open source licen[sc]e
lppl latex project public licen[sc]e
cecill cecill(?: [abc12])?(?: free software)?(?: licen[sc]e)?
mulan mulan permissive software licen[sc]e
blueoak blue oak model licen[sc]e
bittorrent bittorrent open source licen[sc]e
sspl server side public licen[sc]e
busl business source licen[sc]e
elastic elastic licen[sc]e
commons-clause commons clause(?: licen[sc]e)? condition
rsal redis source available licen[sc]e
confluent confluent community licen[sc]e
polyform polyform (?:noncommercial|strict|shield|perimeter|small business|internal use|free trial) licen[sc]e
ofl (?:sil )?open font licen[sc]e
odbl open database licen[sc]e
odbl odbl
odc-by (?:odc|open data commons) attribution licen[sc]e
pddl (?:open data commons )?public domain dedication and licen[sc]e
cdla-permissive community data licen[sc]e agreement permissive
cdla-sharing community data licen[sc]e agreement sharing
ogl open government licen[sc]e
etalab licence ouverte
dl-de datenlizenz deutschland
art-libre (?:free art licen[sc]e|licence art libre)
opl open publication licen[sc]e
dsl design science licen[sc]e
gutenberg project gutenberg licen[sc]e
openrail (?:big ?science |creative ml )?open ?rail(?: m| [ds])?(?: licen[sc]e)?
llama llama [234](?: [0-9])? community licen[sc]e(?: agreement)?
gemma gemma terms of use
cc0 cc0
cc0 creative commons (?:zero|cc0|public domain dedication)
cc-by cc by
cc-by creative commons attribution(?: licen[sc]e)?
cc-by creative commons namensnennung
cc-by creative commons (?:paternit[ée]|reconocimiento|atribuci[oó]n)
cc-by-sa cc by sa
cc-by-sa creative commons attribution share ?alike(?: licen[sc]e)?
cc-by-sa creative commons namensnennung weitergabe unter gleichen bedingungen
cc-by-sa creative commons attribution partage dans les m[êe]mes conditions
cc-by-sa creative commons (?:reconocimiento|atribuci[oó]n) compartir ?igual
cc-by-nc cc by nc
cc-by-nc creative commons attribution non ?commercial(?: licen[sc]e)?
cc-by-nc creative commons namensnennung nicht kommerziell
cc-by-nc creative commons attribution pas d utilisation commerciale
cc-by-nc creative commons (?:reconocimiento|atribuci[oó]n) no ?comercial
cc-by-nd cc by nd
cc-by-nd creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?
cc-by-nd creative commons namensnennung keine bearbeitungen?
cc-by-nc-sa cc by nc sa
cc-by-nc-sa creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
cc-by-nc-sa creative commons namensnennung nicht kommerziell weitergabe unter gleichen bedingungen
cc-by-nc-nd cc by nc nd
cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?
cc-by-nc-nd creative commons namensnennung nicht kommerziell keine bearbeitungen?
"""
#: Fixed values, one rule a line: label, score, pattern. Sentences of licences, their notices and their places.
TEXTS = r"""
mit 1.0 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 0.9 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 0.6 the software is provided as is without warranty of any kind express or implied
mit 0.9 opensource org licenses mit
boost 1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost 0.9 boost org license 1 0
isc 1.0 permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd 0.8 permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
postgresql 1.0 permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd 1.0 permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted(?: without fee)?
bsd 1.0 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 0.8 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 0.8 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd 0.6 this software is provided by the copyright holders? and contributors as is
bsd-2-clause 0.8 the views and conclusions contained in the software and documentation are those of the authors
bsd-3-clause 1.0 neither the names? of(?: [^ ]+){1,14} nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-4-clause 1.0 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 0.8 can be found in the license file .{0,40}bsd style
apache 1.0 apache license version 2 0 january 2004
apache 1.0 you may not use this file except in compliance with the license
apache 0.9 (?:www )?apache org licenses
apache 0.8 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache 0.9 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)
apache 0.7 this product includes software developed (?:by|at) the apache (?:software foundation|group)
apache 0.9 licensed to the apache software foundation
gpl 1.0 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 1.0 you should have received a copy of the gnu general public license
gpl 0.6 this program is distributed in the hope that it will be useful but without any warranty
gpl 0.8 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl 1.0 the gnu general public license is a free copyleft license for software and other kinds of works
gpl 0.9 the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change
gpl 0.9 (?:www )?gnu org (?:licenses|copyleft) gpl
gpl 0.9 gnu general public license (?:as published by|by) the free software foundation
gpl-exception 0.9 as a special exception(?: [^ ]+){0,12} permission to link (?:this|the)
gpl-exception 0.9 classpath exception
lgpl 1.0 this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl 1.0 you should have received a copy of the gnu (?:lesser|library) general public license
lgpl 0.6 this library is distributed in the hope that it will be useful but without any warranty
lgpl 0.9 this license the (?:lesser|library) general public license applies to some specially designated
lgpl 0.9 (?:www )?gnu org (?:licenses|copyleft) lgpl
agpl 1.0 under the terms of the gnu affero general public license
agpl 1.0 you should have received a copy of the gnu affero general public license
agpl 0.9 designed to ensure cooperation with the community in the case of network server software
agpl 0.9 (?:www )?gnu org licenses agpl
gfdl 1.0 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 0.8 with no invariant sections no front cover texts and no back cover texts
gfdl 0.9 (?:www )?gnu org (?:licenses|copyleft) fdl
mpl 1.0 this source code form is subject to the terms of the mozilla public license
mpl 0.9 if a copy of the mpl was not distributed with this file
mpl 1.0 the contents of this file are subject to the mozilla public license
mpl 0.9 (?:www )?mozilla org mpl
npl 1.0 the contents of this file are subject to the netscape public license
epl 1.0 made available under the terms of the eclipse public license
epl 0.9 (?:www )?eclipse org legal epl
cddl 1.0 the contents of this file are subject to the terms of the common development and distribution license
apsl 1.0 this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license
zlib 1.0 in no event will the authors? be held liable for any damages arising from the use of this software
zlib 0.9 the origin of this software must not be misrepresented
zlib 0.8 altered source versions must be plainly marked as such
unlicense 1.0 this is free and unencumbered software released into the public domain
unlicense 0.9 anyone is free to copy modify publish use compile sell or distribute this software
unlicense 0.9 unlicense org
wtfpl 1.0 do what the fuck you want to(?: public license)?
wtfpl 0.9 copies of this license document and changing it is allowed as long as the name is changed
artistic 0.9 the intent of this document is to state the conditions under which a package may be copied
artistic 0.9 redistribute it and or modify it under the same terms as perl(?: 5)?(?: [^ ]+){0,3} itself
ruby 0.9 you may modify your copy of the software in any way provided that you do at least one of the following
python 1.0 psf is making python(?: [^ ]+){0,4} available to licensee on an as is basis
python 0.9 cnri open source license agreement
php 0.9 the name php must not be used to endorse or promote products
openssl 0.9 this product includes software developed by the openssl project
openssl 0.9 this product includes cryptographic software written by eric young
json 1.0 the software shall be used for good not evil
beerware 1.0 you think this stuff is worth it you can buy me a beer in return
vim 0.9 there are no restrictions on distributing unmodified copies of vim
lppl 1.0 this work may be distributed and or modified under the conditions of the latex project public license
w3c 0.9 by obtaining using and or copying this work you the licensee agree
ncsa 0.9 may be used to endorse or promote products derived from this software without specific prior written permission .{0,200}university of illinois
curl 0.8 the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings
sspl 0.9 if you make the functionality of the program or a modified version available to third parties as a service
busl 0.9 the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic 0.9 you may not provide the software to third parties as a hosted or managed service
commons-clause 1.0 the license does not grant to you the right to sell the software
ofl 1.0 this font software is licensed under the sil open font license
ofl 0.9 scripts sil org ofl
odbl 0.9 opendatacommons org licenses odbl
odc-by 0.9 opendatacommons org licenses by
pddl 0.9 opendatacommons org licenses pddl
ogl 0.8 contains public sector information licensed under the open government licen[sc]e
gutenberg 1.0 this ebook is for the use of anyone anywhere(?: [^ ]+){0,12} at no cost and with almost no restrictions
cc 0.5 licensed under (?:a|the) creative commons
cc0 1.0 has waived all copyright and related or neighboring rights
cc0 0.9 cc0 1 0 universal
cc0 0.9 creativecommons org publicdomain zero
public-domain 0.8 creativecommons org publicdomain mark
cc-by 0.9 creativecommons org licenses by
cc-by-sa 0.9 creativecommons org licenses by sa
cc-by-nc 0.9 creativecommons org licenses by nc
cc-by-nd 0.9 creativecommons org licenses by nd
cc-by-nc-sa 0.9 creativecommons org licenses by nc sa
cc-by-nc-nd 0.9 creativecommons org licenses by nc nd
public-domain 0.5 public domain(?: dedication)?
public-domain 0.8 (?:released|placed|dedicated) (?:in ?to|in|to) the public domain
public-domain 0.7 no rights reserved
public-domain 0.7 (?:not|isn t) subject to copyright protection
public-domain 0.6 no known copyright restrictions
public-domain 0.7 (?:domaine public|dominio p[uú]blico|gemeinfrei)
some-rights-reserved 0.5 some rights reserved
proprietary 0.5 all rights reserved
proprietary 0.5 (?:alle rechte vorbehalten|tous droits r[ée]serv[ée]s|todos los derechos reservados)
proprietary 0.9 proprietary and confidential
proprietary 0.9 confidential and proprietary information of
proprietary 0.9 unauthorized copying of this file via any medium is strictly prohibited
proprietary 0.8 no part of this (?:publication|book|work|document|website) may be reproduced
proprietary 0.8 without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) of the (?:copyright )?(?:owner|publisher|author|holder)
proprietary 0.8 unauthorized (?:reproduction|use|distribution|duplication)(?: or (?:reproduction|use|distribution|duplication))? is (?:strictly )?prohibited
eula 0.7 end user licen[sc]e agreement
shareware 0.6 shareware version
freeware 0.6 (?:is|as) freeware
non-commercial 0.7 (?:for )?non commercial (?:use|purposes) only
non-commercial 0.7 (?:not for|no) commercial use
non-commercial 0.7 commercial use is (?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))
non-commercial 0.6 for personal use only
non-commercial 0.6 (?:for )?(?:academic|research|educational)(?: (?:and|or) (?:academic|research|educational))? (?:use|purposes) only
"""
#: What stands before a name, points of priority, score; tried in order.
BEFORE = (
    (r"spdx licen[sc]e identifier", 50, 1.0),
    (r"(?:dual )?licen[sc]ed under (?:(?:the|a|an|both|either) )*(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )*", 45, 1.0),
    (r"(?:re)?distributed under (?:(?:the|a|an) )*(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )*", 40, 0.95),
    (r"(?:made )?(?:available|released|published|provided|used|offered|shared) under (?:(?:the|a|an) )*(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )*", 40, 0.95),
    (r"(?:subject to|governed by|covered by|pursuant to|in accordance with) (?:(?:the|a|an) )*(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )*", 35, 0.9),
    (r"(?:unter|sous|bajo) (?:(?:der|einer|la|une|una|licence|licencia|lizenz) )*", 35, 0.9),
    (r"under (?:(?:the|a|an) )*(?:terms (?:and conditions )?of )?(?:(?:the|a|an) )*", 30, 0.85),
    (r"(?:see|read|consult) (?:(?:the|a|an) )*", 25, 0.8),
    (r"licen[sc]e", 25, 0.8),
    (r"(?:copy|text|version) of (?:(?:the|a|an) )*", 20, 0.7),
)
#: Points of a bare name, and of a sentence.
NAME, NAME_SCORE, SENTENCE = 40, 0.5, 95
VERSION = r"(?: v(?:ersion)? ?\d+(?: \d+)*| \d+(?: \d+)*)?(?: or(?: at your option)?(?: any)? later(?: version)?| only)?"
#: Longest text before a name that is looked at.
REACH = 160
#: Words in the sense of the module's contract, in UTF-8 with A-Z in lower case.
_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
OUT = "doc_id long, no_id boolean, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


@dataclass(frozen=True)
class Signature:
    """One rule; source is its pattern without the edges of words, named tells a name from a sentence."""

    label: str
    source: str
    score: float
    named: bool
    pattern: re.Pattern

    @property
    def keys(self) -> frozenset[str]:
        """Strings of which every match holds one; empty: there are none of three characters or more."""
        best = max(literals(self.source), key=lambda strings: min(map(len, strings)), default={""})
        return frozenset(best) if min(map(len, best)) >= 3 else frozenset()


def _bounded(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")


@lru_cache(maxsize=1)
def rules() -> tuple[Signature, ...]:
    names = (line.split(" ", 1) for line in NAMES.strip().split("\n"))
    texts = (line.split(" ", 2) for line in TEXTS.strip().split("\n"))
    return (*(Signature(label, x, NAME_SCORE, True, _bounded(f"(?:{x}){VERSION}")) for label, x in names), *(Signature(label, x, float(score), False, _bounded(x)) for label, score, x in texts))


@lru_cache(maxsize=1)
def _gate():
    """The automaton of all rules' keys, the rules that every text needs, the base phrases, what stands before names."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()):
        for key in rule.keys:
            of.setdefault(key, []).append(k)
    automaton = ahocorasick.Automaton()
    for key, ks in of.items():
        automaton.add_word(key, ks)
    automaton.make_automaton()
    base = tuple((_bounded(phrase), label, phrase) for phrase, label in BASE)
    before = tuple((re.compile(rf"(?<![^ ]){x.rstrip(' ')} ?$"), points, score) for x, points, score in BEFORE)
    return automaton, tuple(k for k, rule in enumerate(rules()) if not rule.keys), base, before


def gated(joined: str) -> list[int]:
    """Rules that run over a text: words joined by single spaces."""
    automaton, always, *_ = _gate()
    return sorted({*always, *(k for _, ks in automaton.iter(joined) for k in ks)})


def begins(words: list[str]) -> list[int]:
    """Where each word begins in the words joined by spaces."""
    return [0, *accumulate(len(w) + 1 for w in words[:-1])] if words else []


def detect(words: list[str], run: list[int] | None = None) -> list[tuple[int, int, str, float]]:
    """(first word, end word, label, score) of the detections that stand, over the words of one text; run: the rules to run, or all."""
    joined, starts = " ".join(words), begins(words)
    before = _gate()[3]
    found = []
    for k in range(len(rules())) if run is None else run:
        rule = rules()[k]
        for m in rule.pattern.finditer(joined):
            at, points, score = m.start(), SENTENCE, rule.score
            if rule.named:
                points, held = NAME, joined[max(0, at - REACH) : at]
                for pattern, more, said in before:
                    if c := pattern.search(held):
                        at, points, score = at - len(held) + c.start(), NAME + more, said
                        break
            a, b = bisect_right(starts, at) - 1, bisect_right(starts, m.end() - 1)
            found.append((-points, a - b, k, a, b, rule.label, score))
    kept: list[tuple[int, int, str, float]] = []
    outer: list[tuple[int, int]] = []  # intervals kept that lie in no other: both ends ascend
    for _, _, _, a, b, label, score in sorted(found):
        at = bisect_right(outer, a, key=lambda x: x[0])
        if at and outer[at - 1][1] >= b:
            continue
        kept.append((a, b, label, score))
        end = at
        while end < len(outer) and outer[end][1] <= b:
            end += 1
        outer[at - (at > 0 and outer[at - 1][0] == a) : end] = [(a, b)]
    return sorted(kept)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base = _gate()[2]
    columns = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        rows = []
        for doc, no_id, text in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
            raw = _words((text or "").encode("utf-8", "surrogatepass").lower())
            joined = b" ".join(raw).decode("utf-8", "replace")
            places, base_labels, labels, score, spans = [], set(), set(), 0.0, ""
            if run := gated(joined):
                words = joined.split(" ")
                starts = begins(words)
                for pattern, label, phrase in base:
                    if phrase in joined:
                        hits = [bisect_right(starts, m.start()) - 1 for m in pattern.finditer(joined)]
                        places += hits
                        base_labels |= {label} if hits else set()
                found = detect(words, run)
                labels = base_labels | {x[2] for x in found}
                score = max([NAME_SCORE if base_labels else 0.0, *(x[3] for x in found)])
                spans = ",".join(f"{label}:{a}:{b}" for a, b, label, _ in found)
            rows.append((doc, no_id, len(raw), len(places), min(places, default=-1), max(places, default=-1), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans))
        yield pd.DataFrame(rows, columns=columns)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Words, base places, labels, score and spans (label:first word:end word) of every text of docs (doc_id, text)."""
    out = rows_of(docs).mapInPandas(_scan, OUT)
    some = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return out.select(own_id(), "n_words", "n_base", some("first_word"), some("last_word"), "base_labels", "labels", "score", "spans")


def op10(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
