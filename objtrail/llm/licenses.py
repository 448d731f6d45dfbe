"""Licence recognition by sentence rules.

A text is cut into sentences at full stops and blank lines, and each normalised.
Known licence sentences are looked for within a sentence, over its line breaks,
semicolons and colons; one sentence may hold several.  All of them are found in one
pass of an Aho-Corasick automaton over the words, so time grows with the text and
not with its square.  A bare short name counts only in a context that speaks of
licences.  The sequence of identifiers is matched against ordered rules.  Earlier
rules are more specific, and the sentences they use are not used again.  Sentences
that are not known may stand between those of a rule, up to ``MAX_GAP`` of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GAP = 2

# fixed values: known licence sentences, normalised (lower case, words only; * is any words)
SENTENCES = (
    ("mit-ref", "* mit license *"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files *"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *"),
    ("isc-ref", "* isc license *"),
    ("as-is", "* software is provided as is *"),
    ("no-liability", "in no event shall * be liable for any *"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met *"),
    ("bsd-source", "* redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "* redistributions in binary form must reproduce the above copyright notice *"),
    ("bsd-endorse", "* neither the name of * may be used to endorse or promote products *"),
    ("bsd-ref", "* bsd license *"),
    ("bsd2-ref", "* bsd 2 clause license *"),
    ("bsd3-ref", "* bsd 3 clause license *"),
    ("bsd2-ref", "* 2 clause bsd license *"),
    ("bsd3-ref", "* 3 clause bsd license *"),
    ("apache2-ref", "* apache license version 2 0 *"),
    ("apache2-comply", "you may not use this file except in compliance with the license"),
    ("apache2-ref", "* apache 2 0 license *"),
    ("apache2-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache2-terms", "* terms and conditions for use reproduction and distribution *"),
    ("gplv3-ref", "* gnu general public license version 3 *"),
    ("gplv2-ref", "* gnu general public license version 2 *"),
    ("gplv3-ref", "* version 3 of the gnu general public license *"),
    ("gplv2-ref", "* version 2 of the gnu general public license *"),
    ("gplv3-only", "* gnu general public license version 3 only *"),
    ("gplv2-only", "* gnu general public license version 2 only *"),
    ("agplv3-ref", "* gnu affero general public license version 3 *"),
    ("agpl-ref", "* gnu affero general public license *"),
    ("agpl-free", "* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license *"),
    ("lgplv21-ref", "* gnu lesser general public license version 2 1 *"),
    ("lgplv3-ref", "* gnu lesser general public license version 3 *"),
    ("lgpl-ref", "* gnu lesser general public license *"),
    ("lgpl-ref", "* gnu library general public license *"),
    ("lgpl-free", "* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license *"),
    ("lgpl-v21-either", "* either version 2 1 of the license or at your option any later version"),
    ("gpl-free", "* is free software you can redistribute it and or modify it under the terms of the gnu general public license *"),
    ("gpl-v3-either", "* either version 3 of the license or at your option any later version"),
    ("gpl-v2-either", "* either version 2 of the license or at your option any later version"),
    ("gpl-ref", "* gnu general public license *"),
    ("gpl-warranty", "* is distributed in the hope that it will be useful but without any warranty *"),
    ("mpl2-ref", "* mozilla public license version 2 0 *"),
    ("mpl2-ref", "* mozilla public license 2 0 *"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license *"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at *"),
    ("epl2-ref", "* eclipse public license v 2 0 *"),
    ("epl2-ref", "* eclipse public license version 2 0 *"),
    ("epl1-ref", "* eclipse public license v1 0 *"),
    ("epl1-ref", "* eclipse public license version 1 0 *"),
    ("epl-ref", "* eclipse public license *"),
    ("artistic2-ref", "* artistic license 2 0 *"),
    ("artistic-ref", "* the artistic license *"),
    ("bsl1-ref", "* boost software license version 1 0 *"),
    ("bsl1-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license *"),
    ("zlib-ref", "* zlib license *"),
    ("zlib-liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely *"),
    ("zlib-origin", "* the origin of this software must not be misrepresented *"),
    ("zlib-altered", "* altered source versions must be plainly marked as such *"),
    ("zlib-notice", "* this notice may not be removed or altered from any source distribution"),
    ("ofl-ref", "* sil open font license *"),
    ("cddl-ref", "* common development and distribution license *"),
    ("cc-by-nc-sa-ref", "* cc by nc sa *"),
    ("cc-by-nc-nd-ref", "* cc by nc nd *"),
    ("cc-by-nc-ref", "* cc by nc *"),
    ("cc-by-sa-ref", "* cc by sa *"),
    ("cc-by-nd-ref", "* cc by nd *"),
    ("cc-by-ref", "* cc by *"),
    ("cc-by-nc-sa-ref", "* creative commons attribution noncommercial sharealike *"),
    ("cc-by-nc-nd-ref", "* creative commons attribution noncommercial noderivatives *"),
    ("cc-by-nd-ref", "* creative commons attribution noderivatives *"),
    ("cc-by-nc-ref", "* creative commons attribution noncommercial *"),
    ("cc-by-sa-ref", "* creative commons attribution sharealike *"),
    ("cc-by-ref", "* creative commons attribution *"),
    ("cc0-ref", "* cc0 *"),
    ("cc0-waiver", "* to the extent possible under law * waived all copyright and related or neighboring rights *"),
    ("unlicense-grant", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "* dedicated to the public domain *"),
    ("all-rights", "* all rights reserved *"),
    ("spdx", "spdx license identifier *"),
)
# fixed values: short names, which need a context that speaks of licences
WEAK = frozenset(
    ["mit-ref", "isc-ref", "bsd-ref", "zlib-ref", "artistic-ref", "cc-by-nc-sa-ref", "cc-by-nc-nd-ref", "cc-by-nc-ref", "cc-by-sa-ref", "cc-by-nd-ref", "cc-by-ref"]
)
LEADS = frozenset("under license licence licensed licenced licenses licences terms dual spdx".split())
#: words before a short name that may hold a lead, and words that may stand around it in a heading
LEAD_WORDS = 6
HEADING_WORDS = 3
# fixed values: licences and the sentence identifiers that make them, most specific first
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "as-is")),
    ("Zlib", ("zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("bsl1-grant", "as-is")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-basis")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply")),
    ("Apache-2.0", ("apache2-ref", "apache2-terms")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-v3-either")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-v21-either")),
    ("LGPL-3.0-or-later", ("lgpl-free", "gpl-v3-either")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-v3-either")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-v2-either")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-ref",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-ref",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-basis", "apache2-see")),
    ("GPL-3.0-only", ("gplv3-only",)),
    ("GPL-2.0-only", ("gplv2-only",)),
    ("GPL-3.0", ("gplv3-ref",)),
    ("GPL-2.0", ("gplv2-ref",)),
    ("AGPL-3.0", ("agplv3-ref",)),
    ("AGPL", ("agpl-free",)),
    ("AGPL", ("agpl-ref",)),
    ("LGPL-2.1", ("lgplv21-ref",)),
    ("LGPL-3.0", ("lgplv3-ref",)),
    ("LGPL", ("lgpl-free",)),
    ("LGPL", ("lgpl-ref",)),
    ("GPL", ("gpl-free",)),
    ("GPL", ("gpl-ref",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("EPL-1.0", ("epl1-ref",)),
    ("EPL", ("epl-ref",)),
    ("Artistic-2.0", ("artistic2-ref",)),
    ("Artistic", ("artistic-ref",)),
    ("BSL-1.0", ("bsl1-grant",)),
    ("BSL-1.0", ("bsl1-ref",)),
    ("Zlib", ("zlib-grant",)),
    ("Zlib", ("zlib-ref",)),
    ("OFL-1.1", ("ofl-ref",)),
    ("CDDL", ("cddl-ref",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa-ref",)),
    ("CC-BY-NC-ND", ("cc-by-nc-nd-ref",)),
    ("CC-BY-NC", ("cc-by-nc-ref",)),
    ("CC-BY-SA", ("cc-by-sa-ref",)),
    ("CC-BY-ND", ("cc-by-nd-ref",)),
    ("CC-BY", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("all-rights",)),
)
# the longest word of every known sentence: a text without any of them holds none
_CUES = tuple({max(p.replace("*", "").split(), key=len) for _, p in SENTENCES})
# a line without words is blank, so that comment marks do not hide it
_END = re.compile(r"\n(?:[^\w\n]|_)*\n|[.;:](?=\s|\Z)|\n")
_WORD = re.compile(r"[^\W_]+")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)")


def _chunks(pattern: str) -> tuple[list[str], bool, bool]:
    """Literal word runs of a pattern, and whether words may stand before and after them."""
    runs = [f" {c.strip()} " for c in pattern.split("*") if c.strip()]
    return runs, pattern.startswith("*"), pattern.endswith("*")


# most literal words first, so that a reference does not hide a sentence that holds it
_KNOWN = tuple(
    (name, *_chunks(p)) for name, p in sorted(SENTENCES, key=lambda x: -len(x[1].replace("*", "").split()))
)


class Words:
    """A text's words in lower case, a line feed between sentences, and its segments.

    A segment is what stands between two line breaks or marks [.;:]; ``at`` and
    ``till`` are its places in ``plain``, ``spans`` its places in the text, ``count`` its words.
    """

    __slots__ = ("at", "count", "plain", "sentence", "spans", "till")

    def __init__(self, text: str) -> None:
        self.at, self.till, self.spans, self.sentence, self.count = [], [], [], [], []
        pieces, size, number, start, fresh = [" "], 1, 0, 0, False
        ends = [*((m.start(), m.end(), m.group()) for m in _END.finditer(text)), (len(text), len(text), "")]
        for stop, following, mark in ends:
            listed = _WORD.findall(text[start:stop])
            words = " ".join(listed).lower()
            if words:
                if fresh:
                    pieces.append("\n ")
                    size, number, fresh = size + 2, number + 1, False
                pieces.append(words + " ")
                self.at.append(size)
                self.till.append(size + len(words))
                self.spans.append((start, stop))
                self.sentence.append(number)
                self.count.append(len(listed))
                size += len(words) + 1
            fresh |= bool(self.at) and (mark == "." or len(mark) > 1)
            start = following
        self.plain = "".join(pieces)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """All word runs of the known sentences."""
    made = ahocorasick.Automaton()
    for run in {run for _, runs, _, _ in _KNOWN for run in runs}:
        made.add_word(run, run)
    made.make_automaton()
    return made


class _Hits:
    """Where the word runs stand: starts of each in order."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.starts: dict[str, list[int]] = {}
        for end, run in _automaton().iter(words.plain):
            self.starts.setdefault(run, []).append(end - len(run) + 1)
        self.breaks = [i for i, c in enumerate(words.plain) if c == "\n"] if "\n" in words.plain else []
        self.at, self.till = set(words.at), set(words.till)

    def places(self, runs: list[str], before: bool, after: bool) -> Iterator[list[tuple[int, int]]]:
        """Places of a known sentence's runs, each time within one sentence and as near as
        can be; every list of starts is walked once."""
        if not all(r in self.starts for r in runs):
            return
        first, at = self.starts[runs[0]], 0
        next_of = [0] * len(runs)
        k = 0
        while k < len(first):
            p = first[k]
            k += 1
            if p < at or (not before and p + 1 not in self.at):
                continue
            i = bisect_right(self.breaks, p)
            limit = self.breaks[i] if i < len(self.breaks) else len(self.words.plain)
            found = [(p + 1, p + len(runs[0]) - 1)]
            for n, run in enumerate(runs[1:], 1):
                starts = self.starts[run]
                j = bisect_left(starts, found[-1][1], next_of[n])
                next_of[n] = j
                if n == len(runs) - 1 and not after:
                    while j < len(starts) and starts[j] < limit and starts[j] + len(run) - 1 not in self.till:
                        j += 1
                if j == len(starts) or starts[j] >= limit:
                    break
                found.append((starts[j] + 1, starts[j] + len(run) - 1))
            if len(found) < len(runs):
                # nothing of this sentence can do
                k = max(k, bisect_left(first, limit, k))
                continue
            if len(runs) == 1:
                if not after and found[0][1] not in self.till:
                    continue
            else:
                at = found[-1][1]
                if before:
                    near = first[bisect_left(first, found[1][0], k - 1) - 1]
                    found[0] = (near + 1, near + len(runs[0]) - 1)
            yield found

    def speaks_of_licences(self, begin: int, end: int) -> bool:
        """Whether a short name stands in a heading, after a word that leads to it, or before its version."""
        plain, words = self.words.plain, self.words
        if plain[end : end + 2].strip()[:1].isdigit():
            return True
        k = bisect_right(words.at, begin) - 1
        if words.count[k] - 1 - plain.count(" ", begin, end) <= HEADING_WORDS:
            return True
        i = bisect_right(self.breaks, begin) - 1
        start = max(begin - 20 * LEAD_WORDS, self.breaks[i] + 1 if i >= 0 else 0)
        return not LEADS.isdisjoint(plain[start:begin].split()[-LEAD_WORDS:])


def known_sentences(text: str) -> list[tuple[str, int, int, int]]:
    """(identifier, number of its sentence, start, end) of the known sentences, in page order.

    One whose words belong to longer ones is left out; so is one joined from
    several lines as soon as a word of it belongs to another.
    """
    words = Words(text)
    hits = _Hits(words)
    taken = bytearray(len(words.plain))
    listed = []
    for name, runs, before, after in _KNOWN:
        for found in hits.places(runs, before, after):
            first = bisect_right(words.at, found[0][0]) - 1
            last = bisect_right(words.at, found[-1][0]) - 1
            last = max(last, bisect_right(words.at, found[-1][1] - 1) - 1)
            if first < last:
                if any(taken.find(1, a, b) >= 0 for a, b in found):
                    continue
            elif all(taken.find(0, a, b) < 0 for a, b in found):
                continue
            if name in WEAK and len(runs) == 1 and not hits.speaks_of_licences(*found[0]):
                continue
            for a, b in found:
                taken[a:b] = b"\x01" * (b - a)
            listed.append((found[0][0], name, words.sentence[first], words.spans[first][0], words.spans[last][1]))
    return [x[1:] for x in sorted(listed)]


def scan(text: str) -> tuple[list[str], list[dict]]:
    """Sentence identifiers in order, and matches (license, start, end) in page order."""
    lower = text.lower()
    if not any(cue in lower for cue in _CUES):
        return [], []
    listed = known_sentences(text)
    matches = []
    for license_name, chain in rule_chains([(name, sentence) for name, sentence, _, _ in listed]):
        end = max(listed[c][3] for c in chain)
        matches.append({"license": license_name, "start": listed[chain[0]][2], "end": end})
    for m in _SPDX.finditer(text):
        matches.append({"license": m.group(1), "start": m.start(), "end": m.end()})
    matches.sort(key=lambda m: (m["start"], m["end"], m["license"]))
    return [x[0] for x in listed], matches


def rule_chains(listed: list[tuple[str, int]]) -> list[tuple[str, list[int]]]:
    """(licence, places of its identifiers) by the ordered rules over (identifier, number of sentence).

    Each rule starts at every place of its first identifier in turn and takes the next
    free place of each following one, if it comes no more than ``MAX_GAP`` sentences later.
    """
    places: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(listed):
        places.setdefault(name, []).append(k)
    # per identifier, the index of the next free place at or after each
    free = {name: list(range(len(at) + 1)) for name, at in places.items()}

    def next_free(name: str, i: int) -> int:
        up = free[name]
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    found = []
    for license_name, rule in RULES:
        if not all(name in places for name in rule):
            continue
        starts, i = places[rule[0]], next_free(rule[0], 0)
        while i < len(starts):
            chain, taken = [starts[i]], [(rule[0], i)]
            for wanted in rule[1:]:
                at = places[wanted]
                j = next_free(wanted, bisect_right(at, chain[-1]))
                if j == len(at) or listed[at[j]][1] - listed[chain[-1]][1] > MAX_GAP + 1:
                    break
                chain.append(at[j])
                taken.append((wanted, j))
            if len(chain) == len(rule):
                found.append((license_name, chain))
                for name, j in taken:
                    free[name][j] = j + 1
            i = next_free(rule[0], i + 1)
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids, licenses and spans (license, start, end) of every row.

    ``licenses`` are the distinct names in order of first appearance; spans are
    code points of the whole text.  Up to ``MAX_GAP`` unknown sentences may stand
    between two of a rule; texts of any length are read whole.  Null, empty and other texts without licence
    sentences have empty arrays.  Repeated rows give repeated results; an empty
    table gives an empty result; other columns are ignored.
    """
    span = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("sentence_ids", pa.list_(pa.string())), ("licenses", pa.list_(pa.string())), ("spans", pa.list_(span))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([ids for ids, _ in found], type=schema.field(1).type),
                    pa.array([list(dict.fromkeys(m["license"] for m in ms)) for _, ms in found], type=schema.field(2).type),
                    pa.array([ms for _, ms in found], type=schema.field(3).type),
                ],
                schema=schema,
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run,
        "doc_id long, sentence_ids array<string>, licenses array<string>, spans array<struct<license:string,start:long,end:long>>",
    )
