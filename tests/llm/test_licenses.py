import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quietlog.llm import licenses

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
TEXT = dict(licenses.TEXTS)


def scan(spark, rows, **kwargs):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, unit string, n int").repartition(3)
    return {
        r["doc_id"]: (r["license"], r["found_in"], r["license_path"]) for r in licenses.scan(df, **kwargs).collect()
    }


def test_notices_files_and_nearest_directories(spark):
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", "Some prose. " + GPL + " More."), (4, "a/y.py", None),
        (5, "z/y.py", ""), (6, "a/b/own.py", "first line\n" + MIT.upper() + "\nrest"), (7, "a/b/q/LICENSE", "no notice here"),
        (8, "ab/x.py", "code"), (9, "a/b/q/r.py", "the licence of nothing at all that we know"), (10, None, "text"), (11, "a/b", "dir-like name"),
    ]
    got = scan(spark, rows)
    assert got == {
        1: ("MIT", "file", "a/LICENSE"), 2: ("GPL-3.0", "inherited", "a/b/COPYING.txt"), 3: ("GPL-3.0", "file", "a/b/COPYING.txt"),
        4: ("MIT", "inherited", "a/LICENSE"), 5: (None, "none", None), 6: ("MIT", "notice", "a/b/own.py"),
        7: ("GPL-3.0", "inherited", "a/b/COPYING.txt"), 8: (None, "none", None), 9: ("GPL-3.0", "inherited", "a/b/COPYING.txt"),
        10: (None, "none", None), 11: ("MIT", "inherited", "a/LICENSE"),
    }


def test_ties_repeats_long_texts_and_the_top_directory(spark):
    rows = [
        (1, "LICENSE", MIT), (2, "COPYING", MIT), (3, "deep/er/x", "word " * 50000), (4, "k", MIT + "\n" + GPL), (4, "k", MIT + "\n" + GPL),
        (5, "k2", " ".join([GPL] * 500)),
    ]
    got = scan(spark, rows)
    assert got[3] == ("MIT", "inherited", "COPYING")
    assert got[4][0] == "GPL-3.0" and got[5][1] == "notice"
    assert scan(spark, []) == {}


def test_every_template_finds_its_licence(spark):
    rows = [(i, f"d{i}/f", text) for i, (_, _, text) in enumerate(licenses.TEMPLATES)]
    assert [x[0] for _, x in sorted(scan(spark, rows).items())] == [name for name, _, _ in licenses.TEMPLATES]


def wrapped(text, mark="", width=60):
    """Lines of about `width` characters behind a comment mark."""
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += (" " if line else "") + word
    return "\n".join(mark + x for x in [*lines, line])


def test_real_texts_and_headers_that_are_no_templates(spark):
    """Wrapped, commented, with holders' names, other addresses and other wordings."""
    gpl = ("Copyright (C) 2009 A. Person <a@b.org>\n\nThis file is part of Thing.\n\nThing is free software: you can redistribute it and/or modify it "
           "under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or "
           "(at your option) any later version.\n\nThing is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
           "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.\n\nYou "
           "should have received a copy of the GNU {0}General Public License along with Thing. If not, see <https://www.gnu.org/licenses/>.")
    bsd = TEXT["BSD-3-Clause"].replace("copyright holder nor", "The Institute nor").replace("THE COPYRIGHT HOLDERS", "THE REGENTS")
    cases = [
        ("COPYING", "GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software "
         "Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n\n                            Preamble\n\n  The licenses "
         "for most software are designed to take away your freedom to share and change it."),
        ("COPYING", "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"),
        ("a.c", "GPL-2.0", "/*\n" + wrapped(gpl.format("", "2").replace("\n\n", " "), " * ") + "\n */\nint main() {}\n"),
        ("b.py", "GPL-3.0", "\n".join("# " + x for x in gpl.format("", "3").split("\n")) + "\nimport os\n"),
        ("c.py", "AGPL-3.0", wrapped(gpl.format("Affero ", "3").replace("\n\n", " "), "# ")),
        ("d.h", "LGPL-2.1", wrapped(gpl.format("Lesser ", "2.1").replace("\n\n", " "), "// ") + "\nclass X;"),
        ("LICENSE", "MIT", "The MIT License\n\nCopyright (c) 2011 Somebody Else\n\n" + wrapped(TEXT["MIT"])),
        ("e.js", "MIT", "/* SPDX-License-Identifier: MIT */\nlet x;"),
        ("f.rs", "Apache-2.0", wrapped("Copyright 2020 The Authors. " + TEXT["Apache-2.0"], "// ") + "\nfn main() {}"),
        ("LICENSE.txt", "BSD-3-Clause", "Copyright (c) 1993, All rights reserved.\n\n" + wrapped(bsd)),
        ("LICENSE.md", "BSD-2-Clause", "BSD\n\n" + wrapped(TEXT["BSD-2-Clause"].replace("CONTRIBUTORS", "OWNERS"))),
        ("LICENSE", "ISC", "Copyright (c) 2004 by Some Consortium\n\n" + wrapped(TEXT["ISC"].replace("THE AUTHOR", "SOME CONSORTIUM"))),
        ("g.ts", "MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not "
         "distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nx = 1"),
        ("h.md", "CC-BY-SA-4.0", "This text is available under Creative Commons Attribution-ShareAlike 4.0 International."),
        ("i.md", "CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("j.go", "Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\n"),
        ("k.txt", "GPL-2.0", "It is under the GNU General Public License, version 2."),
        ("l.txt", None, "Mit. License. The software of the public work, version 9, may be free."), ("m.txt", None, "All rights reserved. Copyright 2020."),
        ("n.txt", None, "This work is licensed under the GNU General Public License, version 9."),
    ]
    got = scan(spark, [(i, f"t{i}/{name}", text) for i, (name, _, text) in enumerate(cases)])
    assert {i: x[0] for i, x in got.items()} == {i: name for i, (_, name, _) in enumerate(cases)}


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_no_text_without_an_anchor_reaches_the_least_cosine(least):
    """Texts made of all terms that are no anchors, in the proportions that come nearest to a template."""
    found = set(licenses.anchors(licenses.TEMPLATES, least))
    counted = [Counter(t for t in re.findall(licenses.TERM, text.lower()) if t not in licenses.STOP_WORDS) for _, _, text in licenses.TEMPLATES]
    frequency = Counter(t for c in counted for t in c)

    def vector(c):
        return {t: (1 + math.log(n)) * math.log((1 + len(counted)) / frequency[t]) for t, n in c.items()}

    rng = random.Random(5)
    for c in counted:
        v = vector(c)
        norm = math.sqrt(sum(w * w for w in v.values()))
        rest = {t: w for t, w in v.items() if t not in found}
        assert math.sqrt(sum(w * w for w in rest.values())) / norm < least
        for _ in range(20):
            own = vector(Counter(rng.choices(sorted(rest), k=rng.randrange(1, 30)))) if rest else {}
            size = math.sqrt(sum(w * w for w in own.values()))
            assert not own or sum(w * v.get(t, 0) for t, w in own.items()) / size / norm < least


def test_units_near_the_least_cosine_are_never_dropped(spark):
    """Parts of templates between other words, repeated and mixed: what reaches the cosine passes both gates."""
    rng = random.Random(11)
    counted = [Counter(t for t in re.findall(licenses.TERM, text.lower()) if t not in licenses.STOP_WORDS) for _, _, text in licenses.TEMPLATES]
    frequency = Counter(t for c in counted for t in c)
    unknown = math.log(1 + len(counted))

    def vector(c):
        w = {t: (1 + math.log(n)) * (math.log((1 + len(counted)) / frequency[t]) if t in frequency else unknown) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    templates = [vector(c) for c in counted]
    units = []
    for _ in range(600):
        terms = list(rng.choice(counted).elements())
        part = rng.sample(terms, rng.randrange(1, len(terms) + 1)) * rng.choice([1, 1, 2, 9])
        units.append(" ".join(part + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(2 * len(part) + 2))]))
    near = set()
    for i, unit in enumerate(units):
        own = vector(Counter(unit.split()))
        if any(len(own.keys() & t.keys()) >= 2 and sum(w * t.get(x, 0) for x, w in own.items()) >= 0.6 for t in templates):
            near.add(i)
    df = spark.createDataFrame(list(enumerate(units)), "i int, unit string")
    gates = F.col("unit").rlike(licenses.anchor_pattern(licenses.anchors())) & licenses.may_match(F.col("unit"), sorted(frequency), 0.6)
    passed = {r["i"] for r in df.where(gates).collect()}
    assert near and near <= passed and len(passed) < len(units)
