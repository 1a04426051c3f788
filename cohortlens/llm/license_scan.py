"""License recognition by sentences and rules.

A text is read sentence by sentence; a normalised sentence (lower case, no
punctuation, British spelling of "licence" unified) is looked up among known
licence sentences and becomes an identifier.  The sequence of identifiers is then
matched against ordered rules: the first rule that fits at a place names the
licence.  Sentences that speak of licences but are not known are counted as
unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches, slices

# FIXED VALUES: sentences of public licence texts and notices.  "*" stands for up
# to eight words (names, years), "?" before a word makes it optional, and "|"
# stands between words of which one is there.
LEAD = ("?this|the|all|our ?source|original|following ?file|files|work|works|software|program|library|project|package|code|module"
        "|document|content|material|repository ?is|are ?free ?software ?and|made|dual"
        " licensed|licenced|released|distributed|published|provided|available|redistributable"
        " ?to ?you under ?the ?terms|conditions ?and ?conditions ?of ?the")
#: Names of licences that follow the lead, which is not optional as a whole: identifier, words.
NAMED: tuple[tuple[str, str], ...] = (
    ("apache2", "apache ?software ?license|licence ?public ?license ?version|v|- 2|2.0|v2|v2.0 ?the ?license"),
    ("apache2", "apache-2.0 ?license"),
    ("mit-name", "mit|expat ?open ?source ?license ?terms"),
    ("isc-name", "isc ?license"),
    *((f"bsd{n}-name", f"{wording} ?license") for n, words in ((2, "simplified|freebsd"), (3, "new|modified|revised"))
      for wording in (f"bsd {n}-clause|{n}clause", f"bsd {n} clause", f"{n}-clause bsd", f"{n} clause bsd", f"bsd-{n}-clause", f"{words} bsd")),
    *((f"{short}{version}{'+' if later else ''}", f"{name} {number} {tail}".strip())
      for short, names, versions in (
          ("gpl", ("gnu general public license|licence", "gnu gpl", "gpl"), ("2", "3")),
          ("lgpl", ("gnu lesser|library general public license|licence", "gnu lgpl", "lgpl"), ("2", "2.1", "3")),
          ("agpl", ("gnu affero general public license|licence", "gnu agpl", "agpl"), ("3",)))
      for name in names for version in versions
      for number in ({"2": "?license ?version|v 2|2.0|v2|v2.0", "2.1": "?license ?version|v 2.1|v2.1", "3": "?license ?version|v 3|3.0|v3|v3.0"}[version],)
      for later, tail in ((False, "?only ?license ?as ?published ?by ?the ?free ?software ?foundation"),
                          (True, "?of ?the ?license ?as ?published ?by ?the ?free ?software ?foundation"
                                 " or|and ?at ?your ?option ?any later|newer|above|higher|greater ?version"))),
    *((f"{family}{version}{'+' if later else ''}", f"{family}{mark}{version}{'+' if later else ''} ?license")
      for family, versions in (("gpl", ("2", "3", "2.0", "3.0")), ("lgpl", ("2", "2.1", "3", "2.0", "3.0")), ("agpl", ("3", "3.0")))
      for version in versions for mark in ("v", "-") for later in (False, True)),
    ("mpl2", "mozilla public license|licence ?version|v 2|2.0|v2|v2.0"),
    ("mpl2", "mpl ?version|v 2|2.0|v2|v2.0"),
    ("mpl2", "mpl-2.0|mplv2|mplv2.0"),
    *((f"epl{n}", f"{name} ?license ?version|v {n}|{n}.0|v{n}|v{n}.0 {tail}".strip()) for n in (1, 2)
      for name in ("eclipse public license", "epl") for tail in (
          "", "which accompanies this distribution ?and ?is ?available ?at ?http ?https *", "which ?is available at ?http ?https *")),
    ("bsl1", "boost software license ?version|v 1|1.0|v1|v1.0"),
    ("bsl1", "boost software license ?version|v 1.0 see ?the accompanying file *"),
    ("zlib-name", "zlib ?libpng ?license"),
    ("unlicense", "unlicense ?license"),
    ("cc0", "cc0 ?license ?version ?1.0 ?universal ?license"),
    ("cc0", "cc0-1.0 ?license"),
    ("wtfpl", "wtfpl ?license ?version ?2"),
    ("artistic2", "artistic license ?version|v 2|2.0"),
    ("eupl1.2", "european union public license|licence ?version|v 1.2"),
    ("eupl1.2", "eupl ?version|v 1.2"),
    *((f"cddl{v}", f"{name} ?version|v {v}") for v in ("1.0", "1.1") for name in ("common development and distribution license ?cddl", "cddl")),
    *((f"cc-{code}-{version}", f"{wording} {version} {tail}".strip())
      for version in ("2.0", "2.5", "3.0", "4.0") for code, long in (
          ("by", "attribution"), ("by-sa", "attribution-sharealike|attribution-share-alike"), ("by-nd", "attribution-noderivatives|attribution-noderivs"),
          ("by-nc", "attribution-noncommercial"), ("by-nc-sa", "attribution-noncommercial-sharealike"),
          ("by-nc-nd", "attribution-noncommercial-noderivatives|attribution-noncommercial-noderivs"))
      for wording, tail in ((f"?a cc {code}", "?international|unported|generic ?public ?license"), (f"?a cc-{code}", "?international ?license"),
                            (f"?a creative commons {code}|{long}", "?international|unported|generic ?public ?license"))),
)
_GNU_NAMES = (("gpl", "general"), ("lgpl", "lesser|library general"), ("agpl", "affero general"))
_PROGRAM = "program|library|software|file|package|code|module|project"
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache-not-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at ?http ?https www.apache.org/licenses/license-2.0"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is"
                     " distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
                  " documentation files the software to deal in the software without restriction including without"
                  " limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of"
                  " the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial"
                   " portions of the software"),
    ("as-is-mit", "the software is provided as is without warranty of any kind express or implied including but not limited to"
                  " the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("liability-mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"
                      " whether in an action of contract tort or otherwise arising from out of or in connection with the"
                      " software or the use or other dealings in the software"),
    ("isc-grant", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby"
                  " granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that"
                  " the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the"
                   " following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
                   " following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived"
                    " from this software without specific prior written permission"),
    *((f"{short}-notice-{version}{'+' if later else ''}", f"{lead} gnu {name} public license {tail}")
      for short, name in _GNU_NAMES for version in ("2", "2.1", "3")
      for lead in (f"?this|the ?{_PROGRAM} ?is ?free ?software you can redistribute it and/or modify it under the terms of the",)
      for later, tail in (
          (True, f"as published by the free software foundation either version {version} of the license or at your option any later version"),
          (False, f"as published by the free software foundation ?either version {version} ?of ?the ?license ?only"),
          (False, f"version {version} ?only as published by the free software foundation"))),
    ("gpl-hope", f"?this|the ?{_PROGRAM} is distributed in the hope that it will be useful but without any warranty"
                 " without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu ?lesser ?library ?affero general public license for more details"),
    ("gpl-received", "you should have received a copy of the gnu ?lesser ?library ?affero general public license along with"
                     f" this|the|* ?{_PROGRAM} ?if ?not ?see ?http ?https ?www.gnu.org/licenses"),
    *((f"epl{n}", "?this ?program ?and ?the accompanying materials are made available under the terms of the eclipse public license"
                  f" ?version|v {n}|{n}.0|v{n}|v{n}.0 {tail}".strip()) for n in (1, 2) for tail in (
          "", "which accompanies this distribution ?and ?is ?available ?at ?http ?https *", "which ?is available at ?http ?https *")),
    ("bsl1-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and"
                   " accompanying documentation covered by this license the software to use reproduce display distribute execute and"
                   " transmit the software and to prepare derivative works of the software and to permit third-parties to whom the"
                   " software is furnished to do so all subject to the following"),
    ("zlib-as-is", "this software is provided as-is|as ?is without any express or implied warranty"),
    ("zlib-liability", "in no event will the authors|author be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter"
                   " it and redistribute it freely subject to the following restrictions"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at ?http ?https mozilla.org/mpl/2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law * has waived all copyright and related or neighboring rights to this work"),
    ("rights", "all rights reserved"),
    ("copyright", "copyright *"),
)
#: Rules in order: the first whose identifiers stand at a place, one after another, names the licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2", "apache-not-use", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache2", "apache-not-use", "apache-copy")),
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is-mit", "liability-mit")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    *((f"{short.upper()}-{number}{'-or-later' if later else '-only'}", (f"{short}-notice-{version}{'+' if later else ''}", *rest))
      for rest in (("gpl-hope", "gpl-details", "gpl-received"), ("gpl-hope", "gpl-details"), ())
      for short in ("gpl", "lgpl", "agpl") for version, number in (("2", "2.0"), ("2.1", "2.1"), ("3", "3.0")) for later in (True, False)),
    *((f"{short.upper()}-{number}{'-or-later' if later else ''}", (f"{short}{version}{'+' if later else ''}",))
      for short in ("gpl", "lgpl", "agpl") for version, number in (("2", "2.0"), ("2.0", "2.0"), ("2.1", "2.1"), ("3", "3.0"), ("3.0", "3.0"))
      for later in (True, False)),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("ISC", ("isc-name",)),
    ("EPL-1.0", ("epl1",)),
    ("EPL-2.0", ("epl2",)),
    ("BSL-1.0", ("bsl1",)),
    ("BSL-1.0", ("bsl1-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Zlib", ("zlib-name",)),
    ("WTFPL", ("wtfpl",)),
    ("Artistic-2.0", ("artistic2",)),
    ("EUPL-1.2", ("eupl1.2",)),
    ("CDDL-1.0", ("cddl1.0",)),
    ("CDDL-1.1", ("cddl1.1",)),
    ("MPL-2.0", ("mpl2", "mpl-copy")),
    ("MPL-2.0", ("mpl2",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    *((f"CC-{code.upper()}-{version}", (f"cc-{code}-{version}",)) for version in ("2.0", "2.5", "3.0", "4.0")
      for code in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
)
#: SPDX identifiers that are plain words; all others are known by a digit or hyphen in them.
SPDX_WORDS = ("MIT ISC Zlib Unlicense X11 NCSA WTFPL PostgreSQL Python Ruby PHP Vim TCL curl Beerware OpenSSL JSON NTP ICU IJG FTL"
              " Libpng OpenLDAP Sleepycat Intel SGI-B HPND Naumen Xnet libtiff bzip2 psutils Fair Glide Info-ZIP SISSL Zed NLPL").split()
#: The usual spelling of identifiers, which may be written in any case.
SPDX_SPELLING = {x.lower(): x for x in (*SPDX_WORDS, *(name for name, _ in RULES), *(
    "MIT-0 0BSD GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-3.0-only LGPL-2.0-only LGPL-2.1-only LGPL-3.0-only AGPL-3.0-only"
    " AGPL-1.0-only BSD-4-Clause BSD-3-Clause-Clear MPL-1.1 MPL-2.0-no-copyleft-exception OFL-1.1 AFL-3.0 OSL-3.0 MS-PL MS-RL"
    " PSF-2.0 Python-2.0 CDLA-Permissive-2.0 BUSL-1.1 Elastic-2.0 SSPL-1.0 Classpath-exception-2.0 LLVM-exception GCC-exception-3.1"
    " Linux-syscall-note Autoconf-exception-3.0 Bison-exception-2.2 Font-exception-2.0 OpenSSL-exception").split())}
# end of fixed values

SPEAKS = re.compile(r"licen[cs]|copyright|spdx", re.I)
#: Words: letters and digits, joined by marks within; marks at the ends are dropped.
WORD = re.compile(r"[A-Za-z0-9]+(?:[.+/_-]+[A-Za-z0-9]+)*\+?")
#: Where a sentence may begin or end: after a full stop, at a line's end, after a colon or list mark.
BREAK = re.compile(r"[.!?;:](?=\s|$)|\n|(?<=\n)\s*(?:[*#/-]|\d+\.|\(\w\))+")
#: Words that a slot takes whatever stands between them; beyond, it ends with the sentence.
SLOT = 8
SPDX_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*", re.I)
SPDX_TOKEN = re.compile(r"[ \t]*(\(|\)|(?:DocumentRef-[A-Za-z0-9.-]+:)?[A-Za-z0-9]+(?:[.-]+[A-Za-z0-9]+)*\+?)")


class Sentence(NamedTuple):
    name: str
    start: int
    end: int


def _normal(word: str) -> str:
    return word.lower().replace("licence", "license")


class Item(NamedTuple):
    """One place of a pattern; ``any_words`` is a slot for any words up to the end of the sentence."""

    words: frozenset[str]
    optional: bool
    any_words: bool


def _items(text: str) -> tuple[Item, ...]:
    return tuple(Item(frozenset(map(_normal, w.lstrip("?").split("|"))), w.startswith("?"), "*" in w.split("|")) for w in text.split())


def _index(sentences: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, tuple[Item, ...]]]]:
    """Known sentences by their possible first words."""
    index: dict[str, dict[tuple[str, tuple[Item, ...]], None]] = {}
    for name, text in sentences:
        items = _items(text)
        for i, item in enumerate(items):
            for word in item.words - {"*"}:
                index.setdefault(word, {})[name, items] = None
            if not item.optional:
                break
    return {word: list(patterns) for word, patterns in index.items()}


_INDEX = _index(SENTENCES)
_LEAD = _items(LEAD)
_LEAD_WORDS = frozenset().union(*(item.words for item in _LEAD))
_NAMED = _index((*NAMED, *((f"spdx {x}", f"{low} ?license") for low, x in SPDX_SPELLING.items() if re.search("[0-9]", x))))


def _hint() -> str:
    """An expression that matches every text with a known sentence or one that speaks of a licence:
    of each pattern one word that it cannot do without, and what ``SPEAKS`` looks for."""
    def needed(items: tuple[Item, ...]) -> frozenset[str]:
        fixed = (item.words for item in items if not item.optional and not item.any_words)
        return max(fixed, key=lambda words: min(map(len, words)), default=frozenset())

    wanted = {needed(items) for patterns in _INDEX.values() for _, items in patterns} | {needed(_LEAD)}
    if frozenset() in wanted:
        return "(?s).*"
    words = sorted(frozenset().union(*wanted))
    return "(?i)licen[cs]|copyright|spdx|" + "|".join(re.escape(w).replace("license", "licen[cs]e") for w in words)


HINT = _hint()


class Line(NamedTuple):
    """The words of a text; which ones begin and end a sentence or line, and which end a whole sentence."""

    words: list[str]
    begins: list[bool]
    ends: list[bool]
    stops: list[bool]


def _slot(line: Line, at: int, rest: tuple[Item, ...], first: str) -> set[int]:
    """Where a slot that begins at a word may end: after up to ``SLOT`` words, and beyond these,
    as long as the sentence goes on and ``first`` does not begin another one, before a word that
    the rest of the pattern may go on with, or at the first end if it may be done."""
    words, n = line.words, len(line.words)
    out = set(range(at + 1, min(at + SLOT, n) + 1))
    wanted: set[str] = set()
    for item in rest:
        wanted |= item.words
        if not item.optional:
            break
    done = all(item.optional for item in rest)
    for p in range(at + SLOT + 1, n + 1):
        if line.stops[p - 2] or line.begins[p - 1] and words[p - 1] == first:
            break
        if done and line.ends[p - 1]:
            out.add(p)
            break
        if p < n and words[p] in wanted:
            out.add(p)
    return out


def _ends(pattern: tuple[Item, ...], line: Line, at: int) -> list[int]:
    """Numbers of words after which the pattern is complete, the longest first."""
    words, places = line.words, {at}
    for i, item in enumerate(pattern):
        if item.any_words:
            after = set().union(*(_slot(line, p, pattern[i + 1:], words[at]) for p in places))
        else:
            after = {p + 1 for p in places if p < len(words) and words[p] in item.words}
        places = after | places if item.optional else after
        if not places:
            return []
    return sorted(places, reverse=True)


def _known(line: Line, at: int) -> Iterator[tuple[str, tuple[Item, ...], int]]:
    """Sentences that may begin at a word, and where the rest of each is to be looked for."""
    words = line.words
    for name, pattern in _INDEX.get(words[at], ()):
        yield name, pattern, at
    if words[at] in _LEAD_WORDS:
        for begin in _ends(_LEAD, line, at):
            for name, pattern in _NAMED.get(words[begin], ()) if begin < len(words) else ():
                yield name, pattern, begin


def _spdx_id(word: str) -> str | None:
    """The identifier in its usual spelling; None for a word that is none."""
    plain = word.rstrip("+")
    if plain.lower() in SPDX_SPELLING:
        return SPDX_SPELLING[plain.lower()] + word[len(plain):]
    named = re.match(r"(DocumentRef-.+:)?LicenseRef-.", word)
    return word if named or re.search(r"[A-Za-z]", word) and re.search(r"[0-9-]", word) else None


def spdx(text: str, at: int) -> tuple[str, int] | None:
    """The SPDX expression at a place, and its end.

    ``a OR (b AND c WITH d)``: operators between identifiers, parentheses in
    pairs; what goes on beyond a whole expression is no part of it.
    """
    out, depth, want, whole, exception = [], 0, True, None, False
    while m := SPDX_TOKEN.match(text, at):
        word, at = m[1], m.end()
        if want and word == "(" and not exception:
            depth += 1
            out.append("(")
        elif want:
            name = _spdx_id(word) if word not in "()" else None
            if name is None:
                break
            out.append(name)
            want = False
        elif word == ")" and depth:
            depth -= 1
            out.append(")")
        elif word.upper() in ("AND", "OR", "WITH"):
            out.append(f" {word.upper()} ")
            want, exception = True, word.upper() == "WITH"
            continue
        else:
            break
        if not want and not depth:
            whole = "".join(out), at
    return whole


def sentences(text: str) -> tuple[list[Sentence], int]:
    """The known licence sentences of a text in order, and the number of unknown ones.

    A sentence begins and ends at a break or at the ends of the text; line ends
    within it do not matter.  An SPDX tag with its expression stands anywhere and
    is a sentence named by the expression.
    """
    tags = {m.start(): (m.end(), *e) for m in SPDX_TAG.finditer(text) if (e := spdx(text, m.end()))}
    found = list(WORD.finditer(text))
    words = [_normal(m.group(0)) for m in found]
    breaks = [m.start() for m in BREAK.finditer(text)]
    begins, ends, stops, b = [i == 0 for i in range(len(words))], [False] * len(words), [False] * len(words), 0
    for i, m in enumerate(found):
        lines = 0
        while b < len(breaks) and breaks[b] < m.start():
            begins[i] = True
            lines += text[breaks[b]] == "\n"
            if i:
                ends[i - 1] = True
                stops[i - 1] = stops[i - 1] or lines > 1 or text[breaks[b]] in ".!?"
            b += 1
    if words:
        ends[-1] = stops[-1] = True
    line = Line(words, begins, ends, stops)
    out, unknown, i, begun, speaks = [], 0, 0, 0, False
    while i < len(words):
        if tag := tags.get(found[i].start()):
            _, name, end = tag
            out.append(Sentence(f"spdx {name}", found[i].start(), end))
            unknown += speaks
            speaks = False
            while i < len(words) and found[i].start() < end:
                i += 1
            continue
        best = None
        if begins[i]:
            for name, pattern, begin in _known(line, i):
                end = next((e for e in _ends(pattern, line, begin) if ends[e - 1]), None)
                if end is not None and (best is None or end > best[1]):
                    best = name, end
        if best is not None:
            out.append(Sentence(best[0], found[i].start(), found[best[1] - 1].end()))
            i = best[1]
            continue
        speaks = speaks or bool(SPEAKS.search(words[i]))
        if ends[i]:
            unknown += speaks
            speaks = False
        i += 1
    return out, unknown


def licenses(known: list[Sentence]) -> list[Sentence]:
    """The licences that the sequence of identifiers names, by the first rule that fits at each place.

    Copyright lines and reservations stand between sentences without breaking a sequence.
    """
    line = [s for s in known if s.name not in ("copyright", "rights")]
    out, i = [], 0
    while i < len(line):
        if line[i].name.startswith("spdx "):
            out.append(line[i]._replace(name=line[i].name[5:]))
            i += 1
            continue
        for name, ids in RULES:
            if tuple(s.name for s in line[i:i + len(ids)]) == ids:
                out.append(Sentence(name, line[i].start, line[i + len(ids) - 1].end))
                i += len(ids)
                break
        else:
            i += 1
    return out


FOUND = "array<struct<name:string,start:bigint,end:bigint>>"
_FOUND = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, ``found`` (licences with their places in code points, in
    order), n_sentences (known ones) and n_unknown (others that speak of a licence).

    A null or empty text has none; repeated rows are scanned alike; other columns
    are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = part.num_rows
            found, known, unknown = [[] for _ in range(n)], [0] * n, [0] * n
            texts = pc.fill_null(part.column("text"), "")
            hinted = pc.indices_nonzero(pc.match_substring_regex(texts, HINT))
            for i in hinted.to_pylist():
                seen, unknown[i] = sentences(texts[i].as_py())
                known[i] = len(seen)
                found[i] = [s._asdict() for s in licenses(seen)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found, _FOUND), pa.array(known, pa.int64()), pa.array(unknown, pa.int64())],
                ["doc_id", "found", "n_sentences", "n_unknown"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       run, f"doc_id bigint, found {FOUND}, n_sentences bigint, n_unknown bigint")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, licenses (names in order, once each), spans as name:start:end, and the counts."""
    return found.select(
        "doc_id", F.array_join(F.array_distinct("found.name"), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",").alias("spans"),
        "n_sentences", "n_unknown")
