"""Each test fails where an operator does less than its whole job."""

import zlib

import numpy as np
import pytest

from docloom.llm import language, licenses, packing


def test_language_models_words_beyond_the_commonest_thousand(spark):
    rng = np.random.default_rng(7)
    text = lambda pairs, shift=0: " ".join([f"f{i}" for i in rng.integers(0, 1000, 100)] + [f"a{i} b{(i + shift) % 1500}" for i in pairs])
    out = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, text(rng.integers(0, 1500, 40))) for i in range(2000) if i not in out]
    pairs = rng.integers(0, 1500, 400)
    rows += [(out[0], text(pairs)), (out[1], text(pairs, 700))]
    got = {r.doc_id: r for r in language.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true, false = (got[i].score - got[i].base_score for i in out)
    assert true > false + 40


def test_language_vocabulary_and_passes_grow():
    assert language.classes(10**6) < language.classes(10**8) < language.classes(10**9)
    n = np.full(50, 1000)
    m = language.start(n)
    tok = np.random.default_rng(1).integers(0, 50, 30_000)
    moved = language.train(m, [(np.concatenate([[50], tok[:-1]]), tok)])
    assert moved["c"].sum() == len(tok)
    z = language.normalisers(m, m["c"])
    assert np.allclose(np.exp(m["c"] @ m["r"].T + m["b"] - z[:, None]).sum(1), 1, atol=1e-4)


def test_packing_gives_the_added_tokens_ids():
    import public_tokenizers
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.encode("a <|endoftext|> b", ranks).tolist() == [64, 220, 50256, 275, packing.END]
    e = "<|endoftext|>"
    for t in ("", e, e + e, f"x{e}y", f"  {e}\n\n{e}  z", f"é {e[:-1]} {e}'s", "<|endoftext |> a", f"<{e}>", f"a  {e}  b" * 300):
        assert packing.encode(t, ranks).tolist() == [*whole.encode(t, add_special_tokens=False).ids, packing.END]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
NOTICES = [
    (APACHE, "Apache-2.0", "apache-by,apache-you-may-not,apache-copy,apache-as-is,apache-see"), (GPL, "GPL-3.0-or-later", "gpl-free,gpl-no-warranty,gpl-see"), (MPL, "MPL-2.0", "mpl-terms"),
    (MIT, "MIT", "mit-grant,mit-notice,mit-as-is"), (BSD, "BSD-3-Clause", "bsd-grant,bsd-source,bsd-binary,bsd-endorse"), (ISC, "ISC", "isc-grant"),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", ";; ", "dnl "])
def test_licences_of_whole_notices_inside_comments(mark):
    for text, name, ids in NOTICES:
        body = "\n".join(mark + x for x in ["Copyright 2020 Some One", "", *text.split("\n"), ""])
        got = licenses.scan(("/*\n" if mark == " * " else "") + body + ("\n */" if mark == " * " else "") + "\nint main() { return 0; }")
        assert got == ([name], ids.split(",")), (mark, name)


def test_licences_stand_at_edges_of_sentences_or_lines():
    assert licenses.scan("It is not licensed under the MIT license here") == ([], [])
    assert licenses.scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC")[0] == ["MIT", "ISC"]


FREE = """This {what} is free software; you can redistribute it and/or modify it under the
terms of the GNU {name}General Public License as published by the Free Software
Foundation; either version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE.  See the GNU {name}General Public License for more details."""
BSD_AS_IS = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:"""
MORE = [
    (FREE.format(what="program", name="", v=2), ["GPL-2.0-or-later"]), (FREE.format(what="library", name="Lesser ", v="2.1"), ["LGPL-2.1-or-later"]), (FREE.format(what="program", name="Lesser ", v=3), ["LGPL-3.0-or-later"]),
    (FREE.format(what="program", name="Affero ", v=3), ["AGPL-3.0-or-later"]), ("All rights reserved.\n\n" + BSD + BSD_AS_IS, ["BSD-3-Clause"]), (BSD.split("3. ")[0] + BSD_AS_IS, ["BSD-2-Clause"]), (ZLIB, ["Zlib"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", ["GPL-3.0"]), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n", ["GPL-2.0"]), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", ["Apache-2.0"]),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", ["BSL-1.0"]), ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause"]), ("(c) Some One. All rights reserved.", ["LicenseRef-Proprietary"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", ["GPL-2.0-only"]),
    (MIT + "\n\n" + APACHE, ["MIT", "Apache-2.0"]), (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), ["0BSD"]),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_licences_of_more_notices(mark):
    for text, names in MORE:
        assert licenses.scan("\n".join(mark + x for x in ["", *text.split("\n"), ""]))[0] == names, text[:40]


def test_licences_over_a_table(spark):
    rows = [(1, MIT, "x"), (1, MIT, "x"), (None, APACHE, "y"), (2, None, None), (3, "", ""), (4, "word " * 50_000 + "\n" + GPL, "z")]
    got = sorted(((r.doc_id, r.licenses) for r in licenses.scans(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()), key=str)
    assert got == sorted([(1, "MIT"), (1, "MIT"), (None, "Apache-2.0"), (2, ""), (3, ""), (4, "GPL-3.0-or-later")], key=str)
