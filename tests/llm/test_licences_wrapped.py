"""Each licence rule on its canonical text, wrapped as licence files and headers are."""

import textwrap
import time

import pytest

from graphtide.llm import licences

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
CASES = [
    ("MIT", [MIT, NOTICE, AS_IS]),
    ("ISC", [ISC, AS_IS]),
    ("BSD-2-Clause", [BSD, SOURCE, BINARY]),
    ("BSD-3-Clause", [BSD, SOURCE, BINARY, ENDORSE]),
    ("Apache-2.0", [APACHE]),
    ("GPL-3.0", [GPL.format(":")]),
    ("GPL-3.0", [GPL.format(";"), WARRANTY]),
    ("GPL", [GPL.format(":").split(", either")[0] + "."]),
    ("LGPL-2.1", [GPL.format(";").replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")]),
    ("AGPL-3.0", [GPL.format(":").replace("GNU General", "GNU Affero General"), WARRANTY]),
    ("BSD-4-Clause", [BSD, SOURCE, BINARY, "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the Institute.", ENDORSE.replace("3.", "4.")]),
    ("EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."]),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003"]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    ("Zlib", ["This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
    ("CC-BY-NC-ND-3.0", ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License."]),
    ("BSD-3-Clause", ["SPDX-License-Identifier: BSD-3-Clause"]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
    ("MIT", ["SPDX-License-Identifier: MIT"]),
    ("Apache-2.0", ["SPDX-License-Identifier: Apache-2.0"]),
    ("GPL-3.0-or-later", ["SPDX-License-Identifier: GPL-3.0-or-later"]),
    ("GPL-2.0", ["This program is licensed under the GNU General Public License, version 2 or later."]),
    ("CC-BY-SA-4.0", ["This document is licensed under the Creative Commons BY-SA 4.0 International License."]),
    ("Proprietary", ["Copyright 2020 Some Company, All rights reserved."]),
]


@pytest.mark.parametrize("width", [40, 60, 72, 80, 10_000])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_canonical_texts(width, mark):
    for licence, parts in CASES:
        lines = []
        for part in parts:
            lines += [*textwrap.wrap(part, width, break_on_hyphens=False), ""]
        text = "\n".join(mark + line for line in ["Some prose of the file.", "", *lines, "More prose follows."])
        assert [f[0] for f in licences.scan(text)] == [licence], (licence, width, text)
        _, a, b = licences.scan(text)[0]
        assert "prose" not in text[a:b]


def test_lines_stay_sentences():
    text = "prose without a stop\nReleased under the MIT License\nmore prose\nCopyright 2020 Foo\nAll rights reserved\nend"
    assert [(n, text[a:b]) for n, a, b in licences.scan(text)] == [("MIT", "Released under the MIT License"), ("Proprietary", "All rights reserved")]
    text = "Dedicated to the public domain\nReleased under the MIT License\nprose"
    assert [n for n, _, _ in licences.scan(text)] == ["CC0-1.0", "MIT"]


def test_tags():
    text = "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-2-Clause */\nint x;\n<!-- SPDX-License-Identifier: Foo-1 -->\nReleased under the MIT License.\n"
    assert [(n, text[a:b]) for n, a, b in licences.scan(text)] == [
        ("MIT", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-2-Clause"),
        ("Apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-2-Clause"),
        ("BSD-2-Clause", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-2-Clause"),
        ("unclassified", "SPDX-License-Identifier: Foo-1"),
        ("MIT", "Released under the MIT License."),
    ]


def test_rules_against_brute_force():
    """Rules over identifier sequences: at each place the first rule that fits, else unclassified."""
    import random

    rng = random.Random(2)
    said = {"mit-grant": MIT, "mit-notice": NOTICE, "as-is": AS_IS, "bsd-grant": BSD, "bsd-source": SOURCE, "bsd-binary": BINARY, "bsd-endorse": ENDORSE, None: "Nothing of note is said in this one.", "isc-grant": ISC}
    for _ in range(300):
        names = [rng.choice(list(said)) for _ in range(rng.randint(1, 8))]
        text = "\n\n".join(textwrap.fill(said[n], 70, break_on_hyphens=False) for n in names)
        assert [k[0] for k in licences.known_sentences(text)] == names
        want, i = [], 0
        while i < len(names):
            fit = [(lic, len(r)) for lic, r in licences.RULES if names[i : i + len(r)] == r] or ([("unclassified", 1)] if names[i] else [])
            if fit:
                want.append(fit[0][0])
            i += fit[0][1] if fit else 1
        assert [f[0] for f in licences.scan(text)] == want
def test_a_sentence_in_any_number_of_pieces():
    one_word_a_line = "\n\n".join("\n".join(part.split()) for part in (MIT, NOTICE, AS_IS))
    assert [f[0] for f in licences.scan(one_word_a_line)] == ["MIT"]
    holder = "\n".join(f"Holder{i}" for i in range(300))
    assert [f[0] for f in licences.scan(f"Neither the name of\n{holder}\nnor of others may be\nused to endorse or promote products")] == [f[0] for f in licences.scan("Neither the name of X may be used to endorse or promote products")]
    assert [f[0] for f in licences.scan(f"Copyright\n{holder}\nall rights\nreserved")] == ["Proprietary"]
    assert licences.scan(f"Copyright {holder}. And then\nall rights") == []


def test_long_licensed_texts_in_time():
    began = time.time()
    many = "\n".join(["Copyright of a line that begins like a known one", "this software is mine", "neither the name of it"] * 10_000)
    assert licences.scan(many + "\nall rights unreserved") == []
    assert [f[0] for f in licences.scan("\n\n".join(["\n".join(ISC.split()), "prose."] * 300))] == ["ISC"] * 300
    assert time.time() - began < 60


def test_rows_that_repeat_and_rules_that_tie(spark):
    text = "\n\n".join([MIT, NOTICE, AS_IS, "Some prose.", MIT, "Licensed under the MIT License."])
    rows = licences.licences(spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")).collect()
    found = licences.scan(text)
    assert len(found) >= 2 and len(rows) == 4
    assert {(r.doc_id, r.n_found, r.spans) for r in rows} == {(2, 0, ""), *((i, len(found), ",".join(f"{n}:{a}:{b}" for n, a, b in found)) for i in (1, None))}
