"""License scans by sentence rules.

Known licence sentences are looked for in the words of a text: they begin and end where a sentence or a line does, and may run over
line ends, comment signs and punctuation in between. The longest counts. Ordered rules over their identifiers then name licences:
all of a rule's sentences must follow in order, at most GAP unknown sentences between two of them. Rules are tried longest first
(of equal length: in the order given), and a sentence serves one rule. "All rights reserved" names a licence only in a text without
another. SPDX lines may hold expressions: each licence counts, with its exception. Nulls and empty texts have none; rows without an id and repeated rows come back each.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 3
#: Normalised licence sentences (public licence texts); {v} is a version.
SENTENCES = {
    "apache-by": "licensed under the apache license version {v}",
    "apache-you-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-name": "the mit license",
    "mit-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-work": "this work is licensed under the gnu general public license version {v}",
    "gpl-by": "licensed under the gnu general public license version {v}",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "lgpl-by": "licensed under the gnu lesser general public license version {v}",
    "agpl-by": "licensed under the gnu affero general public license version {v}",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v {v}",
    "mpl-by": "licensed under the mozilla public license version {v}",
    "cc-by-nc": "licensed under cc by nc {v}",
    "cc-by-sa": "licensed under cc by sa {v}",
    "cc-by-nd": "licensed under cc by nd {v}",
    "cc-by": "licensed under cc by {v}",
    "cc0": "licensed under cc0 {v}",
    "cc-by-long": "this work is licensed under a creative commons attribution {v} international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike {v} international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial {v} international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "apache-title": "apache license version {v} january {v}",
    "mpl-title": "mozilla public license version {v}",
    "gpl-title": "gnu general public license version {v}",
    "gpl-2-title": "gnu general public license version {v} june {v}",
    "gpl-3-title": "gnu general public license version {v} {v} june {v}",
    "lgpl-title": "gnu lesser general public license version {v}",
    "lgpl-2-title": "gnu lesser general public license version {v} february {v}",
    "lgpl-3-title": "gnu lesser general public license version {v} {v} june {v}",
    "agpl-title": "gnu affero general public license version {v}",
    "agpl-3-title": "gnu affero general public license version {v} {v} november {v}",
    "gpl-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version {v} as published by the free software foundation",
    "gpl-only-long": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version {v} of the license",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "lgpl-free-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "lgpl-no-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "bsd-by": "licensed under the bsd {v} clause license",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-by": "distributed under the boost software license version {v}",
    "boost-title": "boost software license version {v}",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license {v} which is available at",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "mit-no-attribution": "mit no attribution",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mit-project": "this project is licensed under the mit license",
    "apache-project": "this project is licensed under the apache license version {v}",
    "dual-mit-apache": "dual licensed under the mit license and the apache license version {v}",
    "dual-mit-or-apache": "dual licensed under the mit license or the apache license version {v}",
    "dual-apache-mit": "licensed under either of the apache license version {v} or the mit license",
    "artistic-title": "the artistic license {v}",
    "artistic-short": "artistic license {v}",
    "artistic-by": "licensed under the artistic license {v}",
    "cddl-title": "common development and distribution license cddl version {v}",
    "cddl-terms": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "cddl-by": "licensed under the common development and distribution license version {v}",
}
#: Ordered rules; {v} is the version that their sentences name, and a comma parts the licences that one sentence gives.
RULES = [
    ("Apache-{v}", "apache-by apache-you-may-not apache-copy apache-as-is apache-see"), ("Apache-{v}", "apache-by apache-you-may-not apache-as-is"), ("Apache-{v}", "apache-by"),
    ("MIT", "mit-grant mit-notice mit-as-is"), ("MIT", "mit-grant mit-notice"), ("MIT", "mit-grant"), ("MIT", "mit-released"), ("MIT", "mit-licensed"), ("MIT", "mit-name"), ("MIT", "mit-short"), ("ISC", "isc-grant"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse"), ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary"),
    ("GPL-{v}", "gpl-work"), ("GPL-{v}", "gpl-by"), ("GPL-{v}-or-later", "gpl-free gpl-no-warranty"), ("GPL-{v}-or-later", "gpl-free"), ("LGPL-{v}", "lgpl-by"), ("AGPL-{v}", "agpl-by"),
    ("MPL-{v}", "mpl-terms"), ("MPL-{v}", "mpl-by"), ("CC-BY-NC-{v}", "cc-by-nc"), ("CC-BY-SA-{v}", "cc-by-sa"), ("CC-BY-ND-{v}", "cc-by-nd"), ("CC-BY-{v}", "cc-by"), ("CC0-{v}", "cc0"),
    ("CC-BY-{v}", "cc-by-long"), ("CC-BY-SA-{v}", "cc-by-sa-long"), ("CC-BY-NC-{v}", "cc-by-nc-long"), ("Unlicense", "unlicense"),
    ("Apache-{v}", "apache-title"), ("MPL-{v}", "mpl-title"), ("GPL-{v}", "gpl-title"), ("GPL-{v}", "gpl-2-title"), ("GPL-{v}", "gpl-3-title"), ("LGPL-{v}", "lgpl-title"), ("LGPL-{v}", "lgpl-2-title"), ("LGPL-{v}", "lgpl-3-title"),
    ("AGPL-{v}", "agpl-title"), ("AGPL-{v}", "agpl-3-title"), ("GPL-{v}-or-later", "gpl-free gpl-no-warranty gpl-see"), ("GPL-{v}-only", "gpl-only gpl-no-warranty gpl-see"), ("GPL-{v}-only", "gpl-only gpl-no-warranty"), ("GPL-{v}-only", "gpl-only"),
    ("GPL-{v}-only", "gpl-only-long gpl-no-warranty"), ("GPL-{v}-only", "gpl-only-long"), ("LGPL-{v}-or-later", "lgpl-free lgpl-no-warranty"), ("LGPL-{v}-or-later", "lgpl-free"), ("LGPL-{v}-or-later", "lgpl-free-program gpl-no-warranty"),
    ("LGPL-{v}-or-later", "lgpl-free-program"), ("AGPL-{v}-or-later", "agpl-free gpl-no-warranty"), ("AGPL-{v}-or-later", "agpl-free"), ("BSD-{v}-Clause", "bsd-by"), ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is"), ("ISC", "isc-grant isc-as-is"), ("0BSD", "0bsd-grant"), ("Zlib", "zlib-as-is zlib-grant"), ("Zlib", "zlib-grant"), ("BSL-{v}", "boost-by"), ("BSL-{v}", "boost-title"),
    ("EPL-{v}", "epl-terms"), ("WTFPL", "wtfpl"), ("MIT-0", "mit-no-attribution"),
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse bsd-as-is"), ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse"), ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert"),
    ("BSD-4-Clause-UC", "bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse-university bsd-as-is"), ("BSD-4-Clause-UC", "bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse-university"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse-university bsd-as-is"), ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse-university"),
    ("MIT", "mit-project"), ("Apache-{v}", "apache-project"),
    ("MIT,Apache-{v}", "dual-mit-apache"), ("MIT,Apache-{v}", "dual-mit-or-apache"), ("Apache-{v},MIT", "dual-apache-mit"), ("Artistic-{v}", "artistic-title"), ("Artistic-{v}", "artistic-short"), ("Artistic-{v}", "artistic-by"),
    ("CDDL-{v}", "cddl-title"), ("CDDL-{v}", "cddl-terms"), ("CDDL-{v}", "cddl-by"), ("LicenseRef-Proprietary", "reserved"),
]
_HINT = re.compile(r"licen[sc]e|permission|redistribution|warrant|free software|advertising|unencumbered|rights reserved|spdx|public license|everyone is permitted|no attribution|boost software", re.I)
_STOP = re.compile(r"""[.;:!?]["'”’)\]]*\s""")
_REMARK = re.compile(r"^[ \t]*(?:dnl|REM)\b", re.M)
_VERSION = re.compile(r"\b\d+(?:\.\d+)*\b")
_TOKEN = re.compile(r"\b\d+(?:\.\d+)*\b|[^\W_]+")
_WORD = re.compile(r"[^\W_]+|\{v\}")
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
#: An SPDX expression: names joined by AND, OR and WITH, in brackets or not.
_ID = re.compile(rf"(?i:SPDX-License-Identifier):\s*(\(*[ \t]*{_NAME}(?:[ \t)]*[ \t)](?:AND|OR|WITH)[ \t(]+{_NAME})*)")
#: Spellings of one word.
_SPELT = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
#: What a notice may add to "licensed under the ... license version {v}".
_TAIL = " the license"
#: What a notice may add to "this project is licensed under ...": the file by name, or as a Markdown link.
_SEE = ("", *(f" see the {name} file{more}" for name in ("license", "license license", "license md", "license md license md", "license txt") for more in ("", " for details")))


def _starts() -> dict[str, list[tuple[list[str], str]]]:
    """By first word, the words of known sentences and their identifiers, longest first."""
    out: dict = {}
    for k, t in SENTENCES.items():
        for x in [t + more for more in _SEE] if k.endswith("-project") else (t, t + _TAIL) if k.endswith("-by") else (t,):
            words = _WORD.findall(x)
            out.setdefault(words[0], []).append((words, k))
    return {k: sorted(x, key=lambda y: -len(y[0])) for k, x in out.items()}


_STARTS = _starts()


def known(text: str) -> list[tuple[int, str, str]]:
    """Place in the order of sentences, identifier, and last version (or SPDX identifier) of the known sentences."""
    text = _REMARK.sub("", text)
    at = list(_TOKEN.finditer(text))
    raw = [_SPELT.get(w, w) for w in (m[0].lower() for m in at)]
    words = ["{v}" if _VERSION.fullmatch(w) else w for w in raw]
    gaps = [text[a.end() : b.start()] for a, b in zip(at, at[1:])]
    stop = [bool(_STOP.search(g)) for g in gaps]
    edge = [True, *(x or "\n" in g for x, g in zip(stop, gaps)), True]
    unit = [0]
    for x, g in zip(stop, gaps):
        unit.append(unit[-1] + (x or g.count("\n") > 1))
    spdx = {m.start(): (m.end(), m[1]) for m in _ID.finditer(text)}
    seq, i, place, last = [], 0, 0, 0
    while i < len(words):
        hit = None
        if at[i].start() in spdx:
            end, name = spdx[at[i].start()]
            n = i + 1
            while n < len(at) and at[n].start() < end:
                n += 1
            hit = n, "spdx", name
        elif edge[i]:
            for want, k in _STARTS.get(words[i], ()):
                n = i + len(want)
                if n <= len(words) and edge[n] and words[i:n] == want:
                    hit = n, k, next((v for w, v in zip(want, raw[i:n]) if w == "{v}"), "")
                    break
        if hit:
            place += max(unit[i] - last, 1)
            seq.append((place, hit[1], hit[2]))
            last = unit[hit[0] - 1]
        i = hit[0] if hit else i + 1
    return seq


def operands(expression: str) -> list[str]:
    """The licences of an SPDX expression in order, each with the exception that it is given WITH."""
    return [" ".join(x.split()) for x in re.split(r"[()\s]+(?:AND|OR)[()\s]+", expression.strip("() \t")) if x.strip("() ")]


def _versioned(name: str, v: str) -> str:
    """A rule's name with the version of its sentences; numbered licences without a point get one, and nothing is left where none is."""
    pointed = "." in v or not name.startswith(("Apache", "CC", "MPL", "GPL", "LGPL", "AGPL", "BSL", "EPL", "Artistic", "CDDL"))
    return name.replace("{v}", v if pointed else v + ".0").replace("-.0", "")


def scan(text: str | None) -> tuple[list[str], list[str]]:
    """Licences in order of their first sentence, and the identifiers of known sentences in order."""
    if not text or not _HINT.search(text):
        return [], []
    seq = known(text)
    used, found = set(), []
    for name, rule in sorted(RULES, key=lambda r: -r[1].count(" ")):
        ids = rule.split()
        for a in range(len(seq)):
            got, at = [], a
            for want in ids:
                while at < len(seq) and (at in used or seq[at][1] != want) and (not got or seq[at][0] - seq[got[-1]][0] <= GAP):
                    if not got:
                        break
                    at += 1
                if at < len(seq) and at not in used and seq[at][1] == want and (not got or seq[at][0] - seq[got[-1]][0] <= GAP + 1):
                    got.append(at)
                    at += 1
                else:
                    break
            if len(got) == len(ids):
                used |= set(got)
                v = next((seq[i][2] for i in got if seq[i][2]), "")
                found.append((seq[got[0]][0], [_versioned(n, v) for n in name.split(",")]))
    found += [(k, operands(v)) for k, i, v in seq if i == "spdx"]
    names = list(dict.fromkeys(n for _, each in sorted(found, key=lambda x: x[0]) for n in each))
    return [n for n in names if n != "LicenseRef-Proprietary" or len(names) == 1], [i for _, i, _ in seq]


def scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (comma-joined, in order) for every row."""

    def run(batches):
        for pdf in batches:
            found = [scan(t) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["i"], "n_sentences": [len(s) for _, s in found], "sentence_ids": [",".join(s) for _, s in found], "licenses": [",".join(x) for x, _ in found]})

    out = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id string, n_sentences long, sentence_ids string, licenses string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
