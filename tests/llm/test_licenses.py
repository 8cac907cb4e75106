from __future__ import annotations

import math
import re
from collections import Counter

from cases import SF_DIR, table
from pyspark.sql import functions as F

from querytide.llm import licenses, queries
from querytide.llm.license_texts import TEMPLATES

TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
NOTICE = r"(?i)(?:copyright[ \t]*(?:\(c\)|©)?|\(c\)|©)[ \t]*[0-9]{4}[^\n]*?(?=all rights reserved|\n|\Z)"


def cut(text):
    return re.findall(TERM, text.lower())


def split_lines(text):
    return [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]


def runs(lines, belongs):
    found, run = [], []
    for line in [*lines, None]:
        if line is not None and belongs(line):
            run.append(line)
        else:
            found.append(run)
            run = []
    return [run for run in found if len(run) > 1]


def brute_force(texts):
    """(license, score, license lines) of each text; every unit against every template."""
    every = [set(cut(x)) for t in texts for x in split_lines(t)]
    frequency = Counter(t for s in every for t in s)

    def vector(text):
        return {t: c * (math.log((1 + len(every)) / (1 + frequency[t])) + 1) for t, c in Counter(cut(text)).items()}

    def length(v):
        return math.sqrt(sum(x * x for x in v.values()))

    vectors = [(name, v, length(v)) for name, v in ((name, vector(text)) for name, text in TEMPLATES)]
    vocabulary = {t for _, v, _ in vectors for t in v}
    for text in texts:
        lines = re.sub(NOTICE, "", text or "").split("\n")
        worded = [x for x in lines if cut(x)]
        of_licenses = lambda x: sum(t in vocabulary for t in cut(x)) >= 0.7 * len(cut(x))
        units = [[x] for x in worded] + runs(lines, lambda x: bool(cut(x))) + runs(worded, of_licenses)
        best, single, longest = None, 0, 0
        for unit in units:
            v = vector("\n".join(unit))
            own = length(v)
            score, name = max((round(sum(x * w.get(t, 0) for t, x in v.items()) / own / n, 9), name) for name, w, n in vectors)
            if score >= 0.8:
                single, longest = single + (len(unit) == 1), max(longest, len(unit))
                rank = (name != "proprietary", score, len(unit), name)
                best = max(best or rank, rank)
        yield best and best[3], best and best[1], max(single, longest)


def test_query_equals_brute_force(spark):
    docs = table("documents", "doc_id, text")
    rows = {r["doc_id"]: r for r in queries.op8_license_scans(spark, SF_DIR).collect()}
    assert rows.keys() == {i for i, _ in docs}
    found = 0
    for (i, _), (name, score, lines) in zip(docs, brute_force([t for _, t in docs])):
        row = rows[i]
        assert row["license_lines"] == lines
        if name:
            found += 1
            assert (row["license"], row["origin"]) == (name, "own") and abs(row["score"] - score) < 1e-6
        else:
            assert row["origin"] != "own" and row["score"] is None
    assert found


def test_pages_inherit_from_the_pieces_of_their_folder(spark):
    sf_dir = "/root/testdata/sf0.01"
    files = []
    for page, url, html in table("pages", "page_id, url, html", sf_dir):
        host, path = re.fullmatch(r"\w+://([^/?#]*)/?([^?#]*).*", url).groups()
        folder = "/".join([*reversed(host.lower().split(".")), *([path.strip("/")] if path.strip("/") else [])])
        pieces = [x for x in re.split("<[^>]*>", html) if split_lines(x)]
        files += [(page, folder, f"{folder}/{k}", x) for k, x in enumerate(pieces)]
    own, speaks = {}, {}
    for (page, folder, path, text), (name, score, lines) in zip(files, brute_force([f[3] for f in files])):
        if name:
            own[page, path] = name
            if 2 * lines > len(split_lines(text)):
                rank = (name != "proprietary", score, len(text), name)
                speaks[folder] = max(speaks.get(folder, rank), rank)
    expected = []
    for page, folder, path, _ in files:
        parts = folder.split("/")
        above = [speaks[f][3] for f in ("/".join(parts[:n]) for n in range(len(parts), 0, -1)) if f in speaks]
        name = own.get((page, path))
        expected.append((page, path, name or (above[0] if above else None), "own" if name else "inherited" if above else None))
    rows = queries.license_pages(spark, sf_dir).select("page_id", "path", "license", "origin").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert {"own", "inherited", None} <= {r["origin"] for r in rows}


def test_pages_without_a_host_license_nothing_else(spark, tmp_path):
    notice = "<p>Released under the MIT License.</p>"
    rows = [(1, None, notice), (2, "no host", notice), (3, "https://a.example/x", "<p>some words</p>"), (4, "https://a.example/x", None), (5, "https://b.example", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.license_pages(spark, str(tmp_path)).select("page_id", "path", "license", "origin").collect()
    assert sorted(map(tuple, found)) == [(1, None, "MIT", "own"), (2, None, "MIT", "own"), (3, "example/a/x/0", None, None)]


# Headers and license files as they are found in the wild, with names, marks and line breaks of their own.
GPL3 = """This file is part of Frobnicate.

Frobnicate is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Frobnicate is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with Frobnicate.  If not, see <https://www.gnu.org/licenses/>."""

APACHE = """Copyright 2014 The Gizmo Authors. All rights reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

MIT = """The MIT License (MIT)

Copyright (c) 2011-2019 Jo Doe and the widget contributors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""

ISC = """ISC License

Copyright (c) 2018, Jo Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD = """Copyright (c) 2009, Gadget Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

* Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

NAMES = """* Neither the name of Gadget Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""

WILD = {
    "GPL-3.0": [GPL3, "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"],
    "GPL-2.0": [GPL3.replace("version 3 of", "version 2 of")],
    "LGPL-3.0": [GPL3.replace("GNU General", "GNU Lesser General").replace("GNU\nGeneral", "GNU\nLesser General")],
    "AGPL-3.0": [GPL3.replace("GNU General", "GNU Affero General")],
    "Apache-2.0": [APACHE, "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/"],
    "MIT": [MIT, "SPDX-License-Identifier: MIT"],
    "ISC": [ISC],
    "BSD-2-Clause": [BSD % ""],
    "BSD-3-Clause": [BSD % NAMES],
    "MIT OR Apache-2.0": ["SPDX-License-Identifier: (MIT OR Apache-2.0)"],
    "proprietary": ["Copyright (c) 2020 Foo Inc. All rights reserved.", "(c) 1999-2004 Foo & Sons, all rights reserved"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed "
        "with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
}

CODE = """import sys

class Reader:
    def __init__(self, path, mode='r', version=2):
        self.path = path  # the name of the file, with or without a suffix
        self.mode = mode

    def lines(self):
        # Read the file and give its lines in the order of the source.
        with open(self.path, self.mode) as source:
            for line in source:
                yield line.rstrip()"""

CLEAN = [
    CODE,
    "The software of the office is old. You may use the copy machine, subject to the rights of others.",
    "A license to drive is granted by the state, without which no person may drive a car in public.",
    "He published a general notice of the terms under which the work was to be distributed to the public.",
    "Version 3 of the program was released in June 2007 and is still in use.",
    "LICENSE = read('LICENSE')\nsetup(name='x', license=LICENSE, version='3.0')",
    "Warranty: two years on all parts. See the manual for details of the conditions and of liability.",
]


def test_headers_and_files_from_the_wild(spark):
    """As a file, as a comment over code, and in the middle of one."""
    planted, texts = {}, []
    for name, notices in WILD.items():
        for notice in notices:
            for mark in ("", "# ", "// ", " * "):
                marked = "\n".join((mark + line).rstrip() for line in notice.split("\n"))
                planted[len(texts)] = name
                texts.append(marked if mark == "" else f"{CODE}\n\n{marked}\n{CODE}" if mark == "// " else f"{marked}\n\n{CODE}")
    texts += CLEAN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan(docs, F.lit(None).cast("string")).collect()}
    assert len(found) == len(texts) and len(planted) == 64
    assert {texts[k][:80]: v for k, v in found.items() if v != planted.get(k)} == {}


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("LICENSE", mit + "\nsome other words\nand more words"), ("a/x.py", "print"), ("a/b/COPYING.txt", gpl), ("a/b/y.py", None),
        ("a/b/c/z.py", "code code"), ("a/b/c/own.py", "code\n# Licensed under CC BY 4.0\nmore\nmore"), ("a/b2/w.py", ""), (None, "text"),
        ("v/LICENSE.txt", BSD % ""), ("v/src/deep/x.c", CODE), ("w/NOTICE", ISC), ("w/x.c", CODE),
    ]
    docs = spark.createDataFrame([(k, p, t, "x") for k, (p, t) in enumerate(files)], "doc_id long, path string, text string, license string")
    rows = licenses.scan(docs, F.col("path")).collect()
    assert {r["path"]: (r["license"], r["origin"]) for r in rows} == {
        "LICENSE": ("MIT", "own"), "a/x.py": ("MIT", "inherited"), "a/b/COPYING.txt": ("GPL-3.0", "own"), "a/b/y.py": ("GPL-3.0", "inherited"),
        "a/b/c/z.py": ("GPL-3.0", "inherited"), "a/b/c/own.py": ("CC-BY-4.0", "own"), "a/b2/w.py": ("MIT", "inherited"), None: (None, None),
        "v/LICENSE.txt": ("BSD-2-Clause", "own"), "v/src/deep/x.c": ("BSD-2-Clause", "inherited"), "w/NOTICE": ("ISC", "own"), "w/x.c": ("ISC", "inherited"),
    }
