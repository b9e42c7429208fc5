"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

In Spark SQL functions only. What is compared of a file are its units: the whole text if its name is a
licence file's, its header (the leading lines that open with a comment mark), its paragraphs and its sentences. Only
letters and digits count, so comment marks and line breaks don't matter. Equal units are one row from the start: a
notice that a third of all files carry costs one comparison.

A template weighs its terms by their rarity among the templates. Common words, then light ones, are set aside as long as
all of them together are too light for the least cosine; the terms that are left are its anchors. So a unit
without any anchor is dropped before its terms are counted; so is one with too many terms that no template knows
(`may_match`). Neither loses a match. A template with a version
matches only units that name this version, and one shared term alone is no match.

A file without a match of its own takes the licence of the licence file in the nearest directory
above it. That is worked out once per directory, by a join of its ancestors with the
directories that hold a licence file, and joined back to the files.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlog.session import as_lookup, cut

# fixed values: SPDX ids and the version a text has to name
VERSIONS = {
    "MIT": None, "Apache-2.0": "2", "GPL-2.0": "2", "GPL-3.0": "3", "LGPL-2.1": "2.1", "LGPL-3.0": "3", "AGPL-3.0": "3",
    "BSD-2-Clause": None, "BSD-3-Clause": None, "ISC": None, "MPL-2.0": "2", "CC-BY-4.0": "4", "CC-BY-SA-4.0": "4",
    "CC-BY-NC-4.0": "4", "CC0-1.0": "1",
}
# fixed values: usual notices in one sentence
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistributed under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Redistributed under the 3-Clause BSD License."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 licence."),
]
# fixed values: titles of licence texts
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
]
# fixed values: whole texts of short licences and the headers that long ones prescribe
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as "
    "published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This "
    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details. You should have "
    "received a copy of the GNU {name}General Public License along with this program."
)
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
     "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
     "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _TWO_CLAUSES + _DISCLAIMER),
    ("BSD-3-Clause", _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission. " + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
     "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
     "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
     "PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
     "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU_HEADER.format(name="", version="2")),
    ("GPL-3.0", _GNU_HEADER.format(name="", version="3")),
    ("LGPL-2.1", _GNU_HEADER.format(name="Lesser ", version="2.1")),
    ("LGPL-3.0", _GNU_HEADER.format(name="Lesser ", version="3")),
    ("AGPL-3.0", _GNU_HEADER.format(name="Affero ", version="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
     "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
# (license, version or None, text)
TEMPLATES = [
    (name, VERSIONS[name], text)
    for name, text in [*NOTICES, *TITLES, *TEXTS, *((name, f"SPDX-License-Identifier: {name}") for name in VERSIONS)]
]
# fixed values: words that don't count
STOP_WORDS = (
    "a an and any are as at be been but can do for from had has have he if in is it its no nor of on one or other our out shall she so such "
    "than that the their them then there these they this to us was were which who will with would you your "
    "aux dans de des du en est et la le les pour que qui un une con del el las los para por una y das dem den der die ein eine im ist und "
    "von zu"
).split()
# fixed values: words of many texts, set aside first where anchors are chosen
COMMON = frozenset("1 2 3 4 by code copy file files form general including may mit must not public source terms under use version work".split())
SENTENCE_END = r"\n|(?<=[.!?])[ \t\r]+"
PARAGRAPH_END = r"\n(?:[^A-Za-z0-9\n]*\n)+"
HEADER = r"^(?:[ \t]*(?://|/\*|\*|#|--|;|%|<!--)[^\n]*(?:\n|$))+"
TERM = r"[a-z0-9]+"
NUMBER = r"[0-9]+(?:\.[0-9]+)*"
LEAST_COSINE = 0.6
# A name alone ("MIT", or the German "mit") is no notice.
LEAST_TERMS = 2
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"


def anchors(templates: list[tuple] = TEMPLATES, least: float = LEAST_COSINE) -> list[str]:
    """Terms of which every unit that reaches `least` with a template has one at least."""
    counted = [Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS) for _, _, text in templates]
    frequency = Counter(term for terms in counted for term in terms)
    out: set[str] = set()
    for terms in counted:
        weight = {t: (1 + math.log(n)) * math.log((1 + len(templates)) / frequency[t]) for t, n in terms.items()}
        room = (least * least - 1e-6) * sum(w * w for w in weight.values())
        for term in sorted(weight, key=lambda t: (t not in COMMON, weight[t], t)):
            if weight[term] ** 2 < room:
                room -= weight[term] ** 2
            else:
                out.add(term)
    return sorted(out)


def _branches(words: list[str]) -> str:
    """One pattern for some words, with common beginnings written once."""
    out = []
    for head in sorted({w[:1] for w in words}):
        rest = [w[1:] for w in words if w[:1] == head]
        out.append(head + (_branches(rest) if any(rest) else "") if head else "")
    return out[0] if len(out) == 1 else "(?:" + "|".join(sorted(out, reverse=True)) + ")"


def anchor_pattern(found: list[str]) -> str:
    return "(?:^|[^a-z0-9])" + _branches(found) + "(?![a-z0-9])"


# (1 + ln n) ** 2 / n is never larger for a whole n.
_GROWTH = 1.47


def may_match(unit: Column, vocabulary: list[str], least: float) -> Column:
    """Whether a unit's terms leave room for the least cosine with any template; native and exact.

    With s terms (repeats counted) that templates know and d different other ones, the cosine's square is at
    most A / (A + B): A, the weight of the known terms, is at most 1.47 s u ** 2, and B at least d u ** 2, where u is the weight of an
    unknown term, which no known one exceeds.
    """
    terms = _terms(unit)
    known = F.size(F.filter(terms, lambda t: t.isin(vocabulary)))
    other = F.size(F.array_distinct(F.filter(terms, lambda t: ~t.isin(vocabulary))))
    return (known >= LEAST_TERMS) & (_GROWTH * known * (1 - least * least) >= least * least * other)


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


def _numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"(?:\.0)+$", "")))


def _match_units(spark: SparkSession, units: DataFrame, templates: list[tuple], least: float) -> DataFrame:
    """(unit_key, license, cosine): the best template of every distinct unit (unit_key, unit)."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(x).alias("license"), F.lit(v).cast("string").alias("version"), F.lit(t).alias("text"))
            for i, (x, v, t) in enumerate(templates)]
    listed = spark.range(1).select(F.inline(F.array(*rows)))
    known = listed.select("template", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    # as many rows as the templates have terms
    idf = cut(known.groupBy("term").agg(F.log((1 + F.lit(len(templates))) / F.count(F.lit(1))).alias("idf")), "idf")
    unknown = math.log(1 + len(templates))

    def weighted(rows: DataFrame, key: str) -> DataFrame:
        weight = (1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown))
        return rows.join(as_lookup(idf), "term", "left").select(key, "term", weight.alias("w"))

    def norms(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"{key}_norm"))

    vectors = weighted(known, "template")
    of_templates = cut(vectors.join(norms(vectors, "template"), "template").join(listed.select("template", "license", "version"), "template").select(
        "template", "license", "version", "term", (F.col("w") / F.col("template_norm")).alias("v")
    ), "template-vectors")
    spread = units.select("unit_key", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit_key", "term").agg(F.count(F.lit(1)).alias("tf"))
    of_units = cut(weighted(spread, "unit_key"), "unit-vectors")
    # one row per unit with its norm and its products with every template that shares a term
    products = of_units.join(as_lookup(of_templates), "term").groupBy("unit_key", "license", "version", "template").agg(
        F.sum(F.col("w") * F.col("v")).alias("product"), F.count(F.lit(1)).alias("shared")
    ).where(F.col("shared") >= LEAST_TERMS)
    cosine = products.join(norms(of_units, "unit_key"), "unit_key").withColumn("cosine", F.round(F.col("product") / F.col("unit_key_norm"), 6))
    near = cosine.where(F.col("cosine") >= least).join(units.select("unit_key", _numbers(F.col("unit")).alias("numbers")), "unit_key")
    agreed = near.where(F.col("version").isNull() | F.array_contains("numbers", F.col("version")))
    first = F.row_number().over(Window.partitionBy("unit_key").orderBy(F.col("cosine").desc(), "license"))
    return agreed.withColumn("k", first).where("k = 1").select("unit_key", "license", "cosine")


def _parent(path: Column) -> Column:
    """Directory of a path; '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def scan(files: DataFrame, templates: list[tuple] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of `files` (path, text, and a key column `doc_id`): doc_id, path, license,
    cosine, found_in (notice, file, inherited or none) and license_path (where it was found).

    Of several units of a text that match, the one with the largest cosine counts, then the smallest licence name.
    Of several licence files in a directory: the largest cosine, then the smallest path. Null or
    empty text: no match of its own. Null path: read as the top directory's file ''.
    Repeated rows: one result each. Empty table: no rows.
    """
    spark = files.sparkSession
    files = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    pattern = anchor_pattern(anchors(templates, least))
    whole = F.when(_name(F.col("path")).rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(
        whole, F.array(F.regexp_extract("text", HEADER, 0)), F.split("text", PARAGRAPH_END), F.split("text", SENTENCE_END)
    ))
    anchored = F.filter(units, lambda u: F.lower(u).rlike(pattern))
    found = files.where(F.lower("text").rlike(pattern)).select("path", F.xxhash64("text").alias("text_key"), F.explode(anchored).alias("unit"))
    vocabulary = sorted({t for _, _, text in templates for t in re.findall(TERM, text.lower())} - set(STOP_WORDS))
    notices = cut(found.where(may_match(F.col("unit"), vocabulary, least)).withColumn("unit_key", F.md5("unit")), "notices")
    distinct = notices.groupBy("unit_key").agg(F.first("unit").alias("unit"))
    matched = cut(_match_units(spark, cut(distinct, "units"), templates, least), "matched")
    best = F.struct((-F.col("cosine")).alias("worst"), "license")
    own = cut(
        notices.select("path", "text_key", "unit_key").join(matched, "unit_key").groupBy("path", "text_key").agg(F.min(best).alias("best"))
        .select("path", "text_key", "best.license", (-F.col("best.worst")).alias("cosine")),
        "own",
    )
    licence_files = own.where(_name(F.col("path")).rlike(LICENCE_FILE)).groupBy(_parent(F.col("path")).alias("holder")).agg(
        F.min(F.struct((-F.col("cosine")).alias("worst"), "path", "license")).alias("best")
    ).select("holder", "best.license", (-F.col("best.worst")).alias("cosine"), F.col("best.path").alias("license_path"))

    directories = files.select(_parent(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    ancestors = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    )
    nearest = directories.select("directory", F.posexplode(ancestors).alias("depth", "holder")).join(licence_files, "holder").groupBy(
        "directory"
    ).agg(F.max(F.struct("depth", "license", "cosine", "license_path")).alias("above")).select("directory", "above")

    keyed = files.select("doc_id", "path", F.xxhash64("text").alias("text_key"), _parent(F.col("path")).alias("directory"))
    joined = keyed.join(own, ["path", "text_key"], "left").join(nearest, "directory", "left")
    has_own = F.col("license").isNotNull()
    return joined.select(
        "doc_id", "path",
        F.coalesce("license", "above.license").alias("license"),
        F.coalesce("cosine", "above.cosine").alias("cosine"),
        F.when(has_own & _name(F.col("path")).rlike(LICENCE_FILE), "file").when(has_own, "notice")
        .when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("found_in"),
        F.when(has_own, F.col("path")).otherwise(F.col("above.license_path")).alias("license_path"),
    )
