"""Licence scan by sentence rules.

A text is cut into pieces at sentence ends and line feeds; each is normalised (lower case, comment
marks, quotes and punctuation gone, spaces collapsed). Pieces in a row are mapped to the identifier
of a known licence sentence, if they are one: a sentence may be wrapped over lines of a paragraph,
and those in ACROSS may hold a stop (`v. 2.0`, `free software;`). A line that is a known sentence by
itself is never joined to the line before. A known sentence with a free ending reaches to its stop
or its paragraph's end, those in SHORT to the end of the line. The
sequence of identifiers is matched against licence rules in order: at each place the first rule
whose identifiers follow there without an unknown sentence between them wins, and the scan goes on
behind it. Known sentences that no rule takes are reported as `unclassified`. A tag
`SPDX-License-Identifier:` is read first, as its own sentence; each known identifier of its expression is
a find, an expression without one is `unclassified`.

Null and empty texts have no licence. Every row is scanned, repeated rows too; a null doc_id is
carried along. An empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import column

#: Known sentences as patterns over normalised text, by identifier.
SENTENCES = {
    "mit-name": r"(?:this (?:work|software|project|code) is )?(?:released|licensed|distributed|available)? ?(?:under )?the mit licen[sc]e",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": r"(?:the|this) software is provided as is.*",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": r"(?:\d )?redistributions of source code must retain the above copyright notice.*",
    "bsd-binary": r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*",
    "bsd-endorse": r"(?:\d )?neither the name of .* may be used to endorse or promote products.*",
    "isc-grant": r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted.*",
    "apache2-name": r"(?:this (?:work|software|project|file) is )?(?:licensed|released|distributed) under the apache licen[sc]e version 2(?:\.0)?(?: the license)?",
    "apache2-use": r"you may not use this file except in compliance with the license",
    "gpl3-free": r"this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3.*",
    "gpl2-free": r"this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2.*",
    "gpl-free": r"this (?:program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*",
    "lgpl3-free": r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3.*",
    "lgpl21-free": r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2\.1.*",
    "lgpl-free": r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation.*",
    "agpl-free": r"this (?:program|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation.*",
    "gnu-warranty": r"this (?:program|library) is distributed in the hope that it will be useful but without any warranty.*",
    "gpl2-name": r"(?:this (?:work|software|program|project) is )?(?:licensed|released|distributed) under the gnu general public licen[sc]e(?: gpl)? version 2(?:\.0)?( only| or later)?",
    "gpl3-name": r"(?:this (?:work|software|program|project) is )?(?:licensed|released|distributed) under the gnu general public licen[sc]e(?: gpl)? version 3(?:\.0)?( only| or later)?",
    "lgpl-name": r"(?:this (?:work|software|program|project) is )?(?:licensed|released|distributed) under the gnu lesser general public licen[sc]e.*",
    "agpl-name": r"(?:this (?:work|software|program|project) is )?(?:licensed|released|distributed) under the gnu affero general public licen[sc]e.*",
    "mpl2-name": r"this source code form is subject to the terms of the mozilla public license v 2(?:\.0)?",
    "cc0": r"(?:this (?:work|document|text) is )?(?:licensed|released|dedicated) (?:under|to) (?:cc0|the public domain).*",
    "mpl2-copy": r"if a copy of the mpl was not distributed with this file you can obtain one at.*",
    "epl2-name": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2(?:\.0)?.*",
    "epl1-name": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1(?:\.0)?.*",
    "bsl-name": r"(?:distributed under the )?boost software license version 1\.0.*",
    "bsl-grant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "unlicense-use": r"anyone is free to copy modify publish use compile sell or distribute this software.*",
    "no-liability": r"in no event (?:will|shall) the (?:authors?|copyright holders?).*",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd-advertise": r"(?:\d )?all advertising materials mentioning features or use of this software must display the following acknowledgement.*",
    "bsd-product": r"this product includes software developed by.*",
    "wtfpl": r"(?:licensed under the )?do what the fuck you want to public license.*",
    "artistic2-name": r"(?:this (?:work|software|program|project) is )?(?:licensed|released|distributed) under the artistic licen[sc]e version 2(?:\.0)?",
    "all-rights": r"(?:copyright .* )?all rights reserved",
}
#: Creative Commons licences by code, with their long names, and versions.
CREATIVE = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
SENTENCES |= {
    f"cc-{code}-{v}": rf"(?:this (?:work|document|text|page) is )?(?:licensed|released|available|distributed) under (?:a |the )?(?:cc |creative commons )(?:{code.replace('-', ' ')}|{name}) {re.escape(v)}(?: international| unported| generic)?(?: licen[sc]e)?"
    for code, name in CREATIVE.items()
    for v in VERSIONS
}
#: Identifiers of the software package data exchange list that are known in tags.
SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA OFL-1.1
OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL Zlib""".split()
SPDX += [f"CC-{code.upper()}-{v}" for code in CREATIVE for v in VERSIONS]

#: Licence rules, tried in this order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-product", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-name", "apache2-use"]),
    ("Apache-2.0", ["apache2-name"]),
    ("MIT", ["mit-name"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-2.0", ["gpl2-name"]),
    *((licence, [sentence, *rest]) for licence, sentence in (("GPL-3.0", "gpl3-free"), ("GPL-2.0", "gpl2-free"), ("GPL", "gpl-free"), ("LGPL-3.0", "lgpl3-free"), ("LGPL-2.1", "lgpl21-free"), ("LGPL", "lgpl-free"), ("AGPL-3.0", "agpl-free")) for rest in (["gnu-warranty"], [])),
    ("LGPL", ["lgpl-name"]),
    ("AGPL", ["agpl-name"]),
    ("MPL-2.0", ["mpl2-name", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("EPL-2.0", ["epl2-name"]),
    ("EPL-1.0", ["epl1-name"]),
    ("BSL-1.0", ["bsl-name", "bsl-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSL-1.0", ["bsl-name"]),
    ("Unlicense", ["unlicense", "unlicense-use"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["as-is", "no-liability", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("WTFPL", ["wtfpl"]),
    ("Artistic-2.0", ["artistic2-name"]),
    *((f"CC-{code.upper()}-{v}", [f"cc-{code}-{v}"]) for code in CREATIVE for v in VERSIONS),
    ("CC0-1.0", ["cc0"]),
    ("Proprietary", ["all-rights"]),
]
#: Every known sentence holds one of these words or word groups.
MARKS = [
    *["licen[sc]e", "permission", "redistribution", "warrant", "public domain", "cc0", "free software", "all rights reserved", "software is provided", "conditions are met", "copyright", "endorse", "mpl was not"],
    *["attribution", "creative commons", r"\bcc\b", "distributed in the hope", "advertising", "free to copy", "in no event", "product includes"],
]
WORTH = re.compile("|".join(m.replace(" ", r"[\W_]+") for m in MARKS), re.I)

_SENTENCE = re.compile(r"[^\n]*?(?:[.!?;:](?=\s|$)|(?=\n)|$)", re.S)
_NUMBER = re.compile(r"[^\w\n]*\d{1,3}[.:;]")
_ITEM = re.compile(_NUMBER.pattern + r"\s")
_DROP = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)|_")
_KNOWN = [(name, re.compile(p)) for name, p in SENTENCES.items()]
#: Words that known sentences begin with (or a digit).
FIRST = frozenset("this released licensed distributed dedicated available under the permission redistribution redistributions neither you copyright all if in boost do anyone".split())
ACROSS = frozenset(["mpl2-name", "epl1-name", "epl2-name", "gpl-free", "gpl2-free", "gpl3-free", "lgpl-free", "lgpl21-free", "lgpl3-free", "agpl-free", "gnu-warranty"])
SHORT = frozenset(["lgpl-name", "agpl-name", "cc0", "wtfpl", "bsl-name"])
#: Patterns for joined pieces, which can tell that a text may still become a match.
_JOINED = {name: regex.compile(p) for name, p in SENTENCES.items()}
#: Head and closing of the patterns with any words in between.
_AROUND = {"bsd-endorse": (regex.compile(r"(?:\d )?neither the name of "), regex.compile(r"may be used to endorse or promote products")), "all-rights": (regex.compile("copyright "), regex.compile(r"all rights reserved\b"))}
_OPEN = frozenset(name for name, p in SENTENCES.items() if p.endswith(".*"))
_STOP = re.compile(r"[.!?;:]\s*\Z")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(?:\n[^\w\n(]*)?([^\n]*?)[ \t]*(?:\*/|-->|$)", re.M)
_PART = re.compile(r"[A-Za-z0-9.+-]+")
_BLANK = re.compile(r"\n[^\w\n]*\n")


def normalised(sentence: str) -> str:
    return " ".join(_DROP.sub(" ", sentence.lower()).split())


def identifier(sentence: str) -> str | None:
    plain = normalised(sentence)
    return next((name for name, p in _KNOWN if p.fullmatch(plain)), None) if plain else None


def sentences(text: str) -> Iterator[tuple[int, int]]:
    start = None
    for m in _SENTENCE.finditer(text):
        if m.end() > m.start() and not m[0].isspace():
            start = m.start() if start is None else start
            if not _NUMBER.fullmatch(m[0]):  # the number of a list item belongs to its sentence
                yield start, m.end()
                start = None
    if start is not None:
        yield start, len(text)


def known_sentences(text: str) -> Iterator[tuple[str | None, int, int]]:
    """(identifier or None, start, end) for all pieces in order, those of a known sentence together."""
    worded = [(t, a, b) for a, b in sentences(text) for t in [normalised(text[a:b])] if t]
    plain, pieces = [w[0] for w in worded], [w[1:] for w in worded]
    alone = [next((name for name, p in _KNOWN if p.fullmatch(t)), None) if WORTH.search(text, a, b) else None for t, (a, b) in zip(plain, pieces, strict=True)]
    stops = [bool(_STOP.search(text, a, b)) for a, b in pieces]
    ends = [bool(_BLANK.search(text, b, a) or _ITEM.match(text, a)) for (_, b), (a, _) in zip(pieces, pieces[1:])] + [True]  # before a blank line or a list's number
    n = len(pieces)
    starts = np.cumsum([0, *(len(t) + 1 for t in plain)]).tolist()  # of each piece in the joined text
    joined, until = " ".join(plain), [at + len(t) for at, t in zip(starts, plain)]
    worth = [m.start() for m in WORTH.finditer(text)]
    closings = {name: [bisect_left(until, m.end()) for m in c.finditer(joined)] for name, (_, c) in _AROUND.items()}
    upto, stop = [n - 1] * n, [n - 1] * n  # the last piece that can follow; the first piece from here on that ends in a stop
    for i in range(n - 2, -1, -1):
        upto[i] = i if ends[i] or alone[i + 1] is not None else upto[i + 1]
        stop[i] = i if stops[i] else stop[i + 1]

    def wrapped(i: int) -> tuple[str | None, int]:
        """The known sentence that begins with piece i and goes over the fewest pieces, and its last piece."""
        first = plain[i].split(" ", 1)[0]
        at = bisect_left(worth, pieces[i][0])
        if not (first in FIRST or first.isdigit()) or at == len(worth) or worth[at] >= pieces[upto[i]][1]:
            return None, i
        name, last = None, upto[i] + 1
        for around, (head, _) in _AROUND.items():  # any number of words may stand in between: go to the next closing
            if head.match(joined, starts[i]):
                k = bisect_left(closings[around], i + 1)
                if k < len(closings[around]) and (j := closings[around][k]) < last and j <= stop[i] and _JOINED[around].fullmatch(joined, starts[i], until[j]):
                    name, last = around, j
        alive = [x for x in _JOINED if x not in _AROUND]
        for j in range(i + 1, last):  # ends when no pattern can go on: after as many pieces as a pattern has words
            alive = [x for x in alive if (x in ACROSS or j <= stop[i]) and _JOINED[x].fullmatch(joined, starts[i], until[j], partial=True)]
            if not alive:
                break
            if found := next((x for x in alive if not _JOINED[x].fullmatch(joined, starts[i], until[j], partial=True).partial), None):
                return found, j
        return (name, last) if name else (None, i)

    i = 0
    while i < n:
        name, last = (alone[i], i) if alone[i] else wrapped(i)
        if name in _OPEN and name not in SHORT:
            last = max(last, min(upto[last], stop[last]))
            whole = joined[starts[i] : until[last]]  # what follows may make it a more special one
            name = next(n for n, p in _KNOWN if p.fullmatch(whole))
        elif name and name not in SHORT and name not in _AROUND:
            j = last
            while j < upto[last] and not stops[j] and (m := _JOINED[name].fullmatch(joined, starts[i], until[j + 1], partial=True)):
                j += 1
                last = last if m.partial else j
        yield name, pieces[i][0], pieces[last][1]
        i = last + 1


def scan(text: str | None, rules=RULES) -> list[tuple[str, int, int]]:
    """(licence, start, end) in order, ends exclusive, in code points."""
    if not text or not WORTH.search(text):
        return []
    tags = list(_TAG.finditer(text))
    out, i = [], 0
    for tag in reversed(tags):
        ids = [x for x in _PART.findall(tag[1]) if x in SPDX] or ["unclassified"]
        out = [(x, tag.start(), tag.end(1)) for x in ids] + out
        text = text[: tag.start()] + "\n" * (tag.end() - tag.start()) + text[tag.end() :]
    known = list(known_sentences(text))
    while i < len(known):
        if known[i][0] is None:
            i += 1
            continue
        for licence, wanted in [*rules, ("unclassified", [known[i][0]])]:
            if [k[0] for k in known[i : i + len(wanted)]] == wanted:
                start, end = known[i][1], known[i + len(wanted) - 1][2]
                out.append((licence, start + len(text[start:end]) - len(text[start:end].lstrip()), end))
                i += len(wanted)
                break
    return sorted(out, key=lambda f: f[1:]) if tags else out


def licences(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, licences (distinct, sorted, comma-joined), n_found, spans (licence:start:end, comma-joined) for every row of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, rules) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([",".join(sorted({f[0] for f in one})) for one in found], pa.string()),
                    pa.array([len(one) for one in found], pa.int64()),
                    pa.array([",".join(f"{n}:{a}:{b}" for n, a, b in one) for one in found], pa.string()),
                ],
                names=["doc_id", "licences", "n_found", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, licences string, n_found long, spans string")
