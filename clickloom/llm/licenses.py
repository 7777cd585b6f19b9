"""License scan with a generalised suffix automaton of licence words.

All template texts and fixed phrases form one automaton over word numbers.  A
document streams through it: at every word the automaton knows the longest run of
words ending there that occurs in some template (the matching statistic).  Runs
that cannot be extended and have `LEAST_MATCH` words are chained, per template, if
they follow each other in both the document and the template; a chain that covers
enough of its template is a licence span.  Templates with near neighbours (other
versions, NC, ND, SA) have telling words, which one match must hold in full, and of
chains over the same words only the one that covers most stays.  Phrases are found on the way, since a
phrase ends at a word exactly if its state is that word's state or above it.

Defined cases: null and empty texts have no words, places or labels; repeated
rows are scanned alike; an empty table gives no rows; extra columns are ignored.
"""

import pyarrow as pa
from pyspark.sql import DataFrame

from clickloom.llm.common import kind, over_texts
from clickloom.llm.decontaminate import words_of

#: Phrases that name a licence, with their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public licence notices (fixed values), each with its label and, if neighbours differ in few words, its telling words.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "terms of the GNU General Public License",
    ),
    *(
        (
            "lgpl",
            f"This {noun} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
            f"Public License as published by the Free Software Foundation; either version {version} of the License, or (at your "
            f"option) any later version. This {noun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "terms of the GNU Lesser General Public License",
        )
        for noun in ("library", "program")
        for version in ("2.1", "3")
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "terms of the GNU Affero General Public License",
    ),
    ("gpl", "licensed under the GNU General Public License", "GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License", "GNU Affero General Public License"),
    *(
        (f"gpl-{n}", f"licensed under the GNU General Public License, {version}", f"GNU General Public License {version}")
        for n in (1, 2, 3)
        for version in (f"version {n}", f"v{n}", f"v. {n}")
    ),
    *(
        (
            f"mpl-{version[0]}",
            f"This Source Code Form is subject to the terms of the Mozilla Public License, {v} {version}.",
            f"Mozilla Public License {v} {version}",
        )
        for version in ("2.0", "1.1", "1.0")
        for v in ("v.", "version")
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    # Each kind under its names, with each version and without one.
    *(
        (label, f"This work is licensed under a Creative Commons Attribution{name} {kind} License.", f"Attribution{name} {kind[:3] or 'License'}")
        for label, names in {
            "cc-by": [""],
            "cc-by-sa": ["-ShareAlike", "-Share Alike"],
            "cc-by-nc": ["-NonCommercial", "-Non-Commercial"],
            "cc-by-nd": ["-NoDerivatives", "-NoDerivs", "-No Derivatives", "-No Derivative Works"],
            "cc-by-nc-sa": [f"-{nc}-{sa}" for nc in ("NonCommercial", "Non-Commercial") for sa in ("ShareAlike", "Share Alike")],
            "cc-by-nc-nd": [
                f"-{nc}-{nd}"
                for nc in ("NonCommercial", "Non-Commercial")
                for nd in ("NoDerivatives", "NoDerivs", "No Derivatives", "No Derivative Works")
            ],
        }.items()
        for name in names
        for kind in ("4.0 International", "3.0 Unported", "2.5 Generic", "2.0 Generic", "1.0 Generic", "")
    ),
]
#: Words of a match that is chained, words between matches of a chain, and the share of a template that labels.
LEAST_MATCH, MOST_GAP, LEAST_SHARE = 5, 24, 0.6


class Automaton:
    """A generalised suffix automaton over the words of several texts."""

    def __init__(self, texts: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.texts = [[self.number.setdefault(w, len(self.number)) for w in text] for text in texts]
        for t, ids in enumerate(self.texts):
            last = 0
            for i, c in enumerate(ids):
                last = self._extend(last, c)
                self.ends[last].append((t, i + 1))
        # A state's runs end wherever those of the states below it end.
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] = sorted({*self.ends[self.link[v]], *self.ends[v]})

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the runs that reach it from p."""
        copy = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def state(self, ids: list[int]) -> int:
        v = 0
        for c in ids:
            v = self.next[v][c]
        return v


class Scanner:
    """The automaton of phrases and templates, and what a document's walk through it finds."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple] | None = None):
        phrases = PHRASES if phrases is None else phrases
        self.templates = TEMPLATES if templates is None else templates
        self.labels = list(phrases.values())
        texts = [words_of(text.encode()) for _, text, *_ in self.templates]
        # For each template, where its telling words start and stop; (0, 0) if it has none.
        self.telling = []
        for text, (_, _, *told) in zip(texts, self.templates):
            own = words_of(told[0].encode()) if told else []
            at = next(i for i in range(len(text) + 1) if text[i : i + len(own)] == own)
            self.telling.append((at, at + len(own)))
        spoken = [words_of(p.encode()) for p in phrases]
        self.sizes = [len(t) for t in texts]
        self.auto = auto = Automaton(texts + spoken)
        # For each state, the phrases that end with its runs: (words needed, phrase).
        own = {}
        for k, words in enumerate(spoken):
            ids = [auto.number[w] for w in words]
            own.setdefault(auto.state(ids), []).append((len(ids), k))
        self.said: list[list[tuple[int, int]]] = [[] for _ in auto.link]
        for v in sorted(range(1, len(auto.link)), key=auto.length.__getitem__):
            self.said[v] = self.said[auto.link[v]] + own.get(v, [])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (first word, phrase) of phrases, and chains (template, first, stop, words covered)."""
        auto = self.auto
        number, moves, link, lengths, said = auto.number.get, auto.next, auto.link, auto.length, self.said
        places, matches = [], []
        v = n = 0
        for i, word in enumerate(words):
            c = number(word)
            before, had = v, n
            if c is None:
                v = n = 0
            else:
                while v and c not in moves[v]:
                    v = link[v]
                    n = lengths[v]
                if c in moves[v]:
                    v = moves[v][c]
                    n += 1
                else:
                    n = 0
            if had >= LEAST_MATCH and n != had + 1:
                matches.append((i - had, had, before))
            for need, phrase in said[v]:
                if n >= need:
                    places.append((i + 1 - need, phrase))
        if n >= LEAST_MATCH:
            matches.append((len(words) - n, n, v))
        return places, self.chained(matches)

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains of matches that advance in document and template alike, the best of those over the same words."""
        # A chain is its first word, stop, words covered, stop in the template, whether it told, and its runs of words.
        open_: dict[int, list] = {}
        done = []
        for first, n, state in matches:
            for t, end in self.auto.ends[state]:
                if t >= len(self.templates):
                    continue
                start = end - n
                low, high = self.telling[t]
                told = low == high or start <= low and high <= end
                chain = open_.get(t)
                if chain:
                    # Words that the chain has already, in the document or in the template.
                    skip = max(0, chain[1] - first, chain[3] - start)
                    if skip < n and first + skip - chain[1] <= MOST_GAP and start + skip - chain[3] <= MOST_GAP:
                        chain[1], chain[2], chain[3] = first + n, chain[2] + n - skip, end
                        chain[4] |= told
                        chain[5].append((first + skip, first + n))
                        continue
                    if first < chain[1]:
                        continue
                    done.append((t, chain))
                open_[t] = [first, first + n, n, end, told, [(first, first + n)]]
        done += open_.items()
        able = [(t, c) for t, c in done if c[4] and c[2] >= LEAST_SHARE * self.sizes[t]]
        able.sort(key=lambda x: (-x[1][2], -x[1][2] / self.sizes[x[0]], x[1][0], x[0]))
        best, taken = [], set()
        for t, chain in able:
            own = {i for a, b in chain[5] for i in range(a, b)}
            # A few words at the edge may belong to two notices; half of a notice may not.
            if 2 * len(own & taken) < len(own):
                best.append((t, *chain[:3]))
                taken |= own
        return sorted(best)


SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])
)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Kept columns, n_words, n_base, first_word, last_word, base_labels, labels, score and license_spans."""
    keep = keep or [id_col]
    scanner = scanner or Scanner()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]

    def run(slices):
        for batch in slices:
            rows = []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                places, chains = scanner.scan(words)
                base = {scanner.labels[k] for _, k in places}
                spans = [
                    {"label": scanner.templates[t][0], "first": a, "stop": b, "share": n / scanner.sizes[t]} for t, a, b, n in chains
                ]
                first = [p for p, _ in places]
                rows.append((
                    len(words), len(places), min(first, default=None), max(first, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {s["label"] for s in spans})),
                    1.0 if places else max((s["share"] for s in spans), default=0.0), spans,
                ))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), SPANS]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *names])

    fields = ", ".join(f"`{c}` {kind(docs, c)}" for c in keep)
    schema = (
        f"{fields}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, license_spans array<struct<label: string, first: bigint, stop: bigint, share: double>>"
    )
    return over_texts(docs, text_col, keep, run, schema)
