"""License scan (native: DataFrame and SQL functions only).

Texts are cut into units (sentences of lines and of paragraphs, lines, paragraphs, the whole text). Sentences of paragraphs
run on over line breaks and the comment marks after them, and lines without a word are blank there. A unit is normalised to lower-case words and
compared with licence templates by the Dice coefficient over sets of word bigrams. Two sound tests come first:

* size bounds: ``dice >= t`` needs ``t/(2-t) * n <= m <= (2-t)/t * n`` for bigram counts n, m;
* anchor words: a unit of ``dice >= t`` shares at least ``t/(2-t) * n`` bigrams with its template, so words that touch more
  than the rest of the template's bigrams cannot all be missing. One pattern of such words drops nearly all text unseen.

A unit stands for one licence, that of its best template: notices of one family (GPL, LGPL and AGPL of any version; the BSD
licences; the Creative Commons licences) are within the threshold of each other. For the same reason a unit inside a longer one
says nothing against it: of two units of one family, the one whose words the other holds is dropped, unless the longer unit has
more words than the size bound allows its template, as the text around several notices has.

No join and no shuffle: the templates are a constant of fixed size in the plan.

Defined results: every input row gives one row; a null or empty text has no licence; repeated rows and rows with equal or null ids
are each reported; templates of equal Dice for a unit go by the licence's name, the first wins; licences of a row are ordered by
Dice, the highest first, then by name, the last first; of equal Dice for a licence the greatest unit is shown; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Whole texts of short licences, the BSD ones with and without their third condition.
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{third} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."

#: Fixed values: (SPDX id, notice) of common public licence notices and short texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", _BSD.format(third=" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("Zlib", _ZLIB),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words too common in prose to serve as anchors.
_COMMON = set("a an and any are as at be by can copy for free from in is it not of on one or that the this to use was with you work".split())

#: Licences that are told apart within: what an id begins with, and the family's name.
FAMILIES = (("GPL", "GPL"), ("LGPL", "GPL"), ("AGPL", "GPL"), ("BSD", "BSD"), ("CC", "CC"))


def family_of(license: str) -> str:
    return next((f for start, f in FAMILIES if license.startswith(start + "-")), license)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit at the threshold holds at least one, whatever its template."""
    chosen: set[str] = set()
    for _, text in TEMPLATES:
        grams = [set(g.split()) for g in bigrams_of(words_of(text))]
        needed = threshold / (2 - threshold) * len(grams)
        left = [g for g in grams if not g & chosen]
        while len(left) >= needed:
            rank = {w: (w not in _COMMON, sum(w in g for g in left), len(w), w) for g in left for w in g}
            best = max(rank, key=rank.get)
            chosen.add(best)
            left = [g for g in left if best not in g]
    return sorted(chosen)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, licenses array<struct<license, dice, unit>>): the best unit for each licence found, highest Dice first."""
    pattern = r"(?i)\b(?:" + "|".join(anchors(threshold)) + r")\b"
    text = F.col("t")
    lines = F.split(text, r"\R")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?:;])\s+")))
    paragraphs = F.split(text, r"\R\s*\R")
    # wrapped: lines without a word part paragraphs, other line breaks are spaces with the marks that begin the next line
    broken = F.regexp_replace(text, r"\R", "\n")
    blocks = F.split(F.regexp_replace(broken, r"(?m)^[^\p{L}\p{N}\n]+$", ""), r"\n\s*\n")
    joined = F.transform(blocks, lambda x: F.regexp_replace(x, r"\n[^\p{L}\p{N}\n]*", " "))
    wrapped = F.flatten(F.transform(joined, lambda x: F.split(x, r"(?<=[.!?:;])\s+")))
    units = F.array_distinct(F.filter(F.concat(sentences, lines, paragraphs, joined, wrapped, F.array(text)), lambda u: u.rlike(pattern)))
    units = F.when(text.rlike(pattern), units).otherwise(F.array().cast("array<string>"))
    templates = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(family_of(k)).alias("family"), F.lit(len(words_of(t))).alias("k"), F.array(*map(F.lit, bigrams_of(words_of(t)))).alias("g")) for k, t in sorted(TEMPLATES)))

    def hits(u: Column) -> Column:
        near = F.filter(templates, lambda t: (F.size(t["g"]) * threshold <= F.size(u["g"]) * (2 - threshold)) & (F.size(u["g"]) * threshold <= F.size(t["g"]) * (2 - threshold)))
        scored = F.transform(near, lambda t: F.struct((F.size(F.array_intersect(u["g"], t["g"])) * F.lit(2.0) / (F.size(u["g"]) + F.size(t["g"]))).alias("dice"), t["license"].alias("license"), t["family"].alias("family"), u["u"].alias("unit"), u["n"].alias("n"), (u["k"] * threshold <= t["k"] * (2 - threshold)).alias("tight")))
        scored = F.filter(scored, lambda s: s["dice"] >= threshold)
        best = F.array_max(F.transform(scored, lambda s: s["dice"]))
        # templates are in order of their names
        return F.slice(F.filter(scored, lambda s: s["dice"] == best), 1, 1)

    words = lambda u: F.regexp_extract_all(F.lower(u), F.lit("[a-z0-9]+"), F.lit(0))
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
    tokenised = F.transform(units, lambda u: F.struct(u.alias("u"), words(u).alias("w")))
    # a template has two bigrams at least, and no unit longer than the largest template allows can match
    longest = max(len(words_of(t)) for _, t in TEMPLATES) * (2 - threshold) / threshold
    sized = F.filter(tokenised, lambda x: (F.size(x["w"]) >= 2))
    paired = F.filter(F.transform(sized, lambda x: F.struct(x["u"].alias("u"), grams(x["w"]).alias("g"), F.concat(F.lit(" "), F.array_join(x["w"], " "), F.lit(" ")).alias("n"), F.size(x["w"]).alias("k"))), lambda x: F.size(x["g"]) <= longest)
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("id", paired.alias("p"))
    found = found.select("id", F.flatten(F.transform("p", hits)).alias("all"))
    inside = lambda s, o: o["tight"] & (o["family"] == s["family"]) & (o["license"] != s["license"]) & (F.length(o["n"]) > F.length(s["n"])) & F.contains(o["n"], s["n"])
    outer = F.filter("all", lambda s: ~F.exists("all", lambda o: inside(s, o)))
    found = found.select("id", F.transform(outer, lambda s: F.struct(s["dice"].alias("dice"), s["license"].alias("license"), s["unit"].alias("unit"))).alias("h"))
    names = F.array_distinct(F.transform("h", lambda s: s["license"]))
    best = F.transform(names, lambda k: F.array_max(F.filter("h", lambda s: s["license"] == k)))
    ordered = F.reverse(F.array_sort(best))
    return found.select(F.col("id").alias(id_col), F.transform(ordered, lambda s: F.struct(s["license"].alias("license"), s["dice"].alias("dice"), s["unit"].alias("unit"))).alias("licenses"))


def op9_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_licenses(docs)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.transform("licenses", lambda s: s["license"])), ",").alias("license_ids"),
        F.round(F.coalesce(F.array_max(F.transform("licenses", lambda s: s["dice"])), F.lit(0.0)), 6).alias("best_dice"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """The query in SQL: every unit against every template, without the tests that save work."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(family_of(k))}, {len(words_of(t))}, [{', '.join(map(quoted, bigrams_of(words_of(t))))}])" for k, t in TEMPLATES)
    cut = lambda x: f"flatten(list_transform({x}, lambda y: string_split(regexp_replace(y, '([.!?:;])\\s+', '\\1' || chr(1), 'g'), chr(1))))"
    blocks = r"regexp_split_to_array(regexp_replace(x, '(?m)^[^\p{L}\p{N}\n]+$', '', 'g'), '\n\s*\n')"
    joined = rf"list_transform({blocks}, lambda y: regexp_replace(y, '\n[^\p{{L}}\p{{N}}\n]*', ' ', 'g'))"
    units = f"[{cut('string_split(x, chr(10))')}, string_split(x, chr(10)), regexp_split_to_array(x, '\\n\\s*\\n'), {joined}, {cut(joined)}, [x]]"
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(license, family, k, g)),
d AS MATERIALIZED (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n|[\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') AS x, row_number() OVER () AS rid FROM documents),
u AS (SELECT rid, unnest(list_distinct(flatten({units}))) AS u FROM d),
w AS (SELECT DISTINCT rid, regexp_extract_all(lower(u), '[a-z0-9]+') AS w FROM u),
b AS (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS n, len(w) AS k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) BETWEEN 2 AND 1000),
m AS (SELECT b.rid, b.n, t.license, t.family, b.k * {threshold} <= t.k * {2 - threshold} AS tight, 2.0::DOUBLE * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS dice FROM b JOIN t ON len(t.g) * {threshold} <= len(b.g) * {2 - threshold} AND len(b.g) * {threshold} <= len(t.g) * {2 - threshold}),
o AS MATERIALIZED (SELECT rid, n, license, family, tight, dice FROM m WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY rid, n ORDER BY dice DESC, license) = 1),
h AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.tight AND p.rid = o.rid AND p.family = o.family AND p.license <> o.license AND length(p.n) > length(o.n) AND contains(p.n, o.n)))
SELECT d.doc_id, count(DISTINCT h.license) AS n_licenses, coalesce(string_agg(DISTINCT h.license, ',' ORDER BY h.license), '') AS license_ids, round(coalesce(max(h.dice), 0), 6) AS best_dice
FROM d LEFT JOIN h ON h.rid = d.rid GROUP BY d.rid, d.doc_id
"""


OP9_SQL = oracle()
