"""License scan: normalised text against licence templates by the Dice coefficient of word bigrams.

A document is cut into units (its lines, its paragraphs if they have several lines, and the whole text if it has
several paragraphs). A unit or template is lower-cased, everything but a-z and 0-9 becomes a space, and its set of
bigrams of neighbouring words is taken. Dice = 2 * common / (size of one + size of the other). Sizes u and t allow
at most 2 * min(u, t) / (u + t), so a unit meets only those templates with t * s / (2 - s) <= u <= t * (2 - s) / s,
s being the least similarity.

A licence may also be any part of the text: for each template, the best of all windows, runs of at most
t * (2 - s) / s bigrams of the whole text's words, wherever its lines and paragraphs end. A bigram of the template next
to a window never lowers its score when it joins it, so only windows are scored that cannot grow by one: those from the
start of a run of the template's bigrams to the end of one, and those of full length. Before that, the template must
have t * s / (2 - s) bigrams in the text, and a window as many places with one. The templates are a constant of the query; there is no shuffle and no
join. Texts without any of the words of which every match has one (see gate_words) are not cut at all.

Defined results: null or empty text has no match; equal scores go to the template listed first; repeated rows give
repeated results; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lets, table

LEAST = 0.8

# Notices and texts of licences as their authors publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def bigrams(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def gate_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which every matching unit has at least one.

    A match shares at least least * (t + u) / 2 bigrams with the template's t, u being least / (2 - least) * t or
    more. So words that touch more bigrams than a match may lack are in every match; long words are taken first.
    """
    out: dict[str, None] = {}
    for text in templates.values():
        grams = [set(g.split()) for g in bigrams(text)]
        lacks = len(grams) - math.ceil(len(grams) * least / (2 - least) - 1e-9)
        words = sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w))
        chosen: set[str] = set()
        for w in words:
            if sum(bool(g & chosen) for g in grams) > lacks:
                break
            chosen.add(w)
        out |= dict.fromkeys(sorted(chosen))
    return list(out)


def units_sql(text: str) -> str:
    """Lines, paragraphs of several lines, the whole text of several paragraphs."""
    split = lambda by: f"split({text}, '{by}')"
    return lets(
        r"array_distinct(concat(lines, filter(paragraphs, p -> contains(p, '\n')), if(size(paragraphs) > 1, array(" + text + "), array())))",
        ("lines", split(r"\n")), ("paragraphs", split(r"\n[\\x20\\x09\\x0D]*\n")))


def windows_sql(templates: str, words: str, low: float, high: float, least: float) -> str:
    """Array of (name, rank, dice) of the best window of an array of words, for each template that has one."""
    few, most = f"cast(ceil(t.n * {low!r}D) as int)", f"cast(floor(t.n * {high!r}D) as int)"
    hit = lambda at: f"coalesce(get(hits, {at}), false)"
    full = f"if({hit(f'x.a + {most} - 1')}, array(x.a + {most} - 1), cast(array() as array<int>))"
    # starts a, with the place c up to which a window has enough hits
    starts = f"filter(transform(places, (a, j) -> struct(a as a, get(places, j + {few} - 1) as c)), x -> x.c < x.a + {most} and (not {hit('x.a - 1')} or {hit(f'x.a + {most} - 1')}))"
    ends = f"if({hit('x.a - 1')}, {full}, array_union(filter(stops, b -> b >= x.c and b < x.a + {most}), {full}))"
    dice = let("array_distinct(slice(g, x.a + 1, b - x.a + 1))", "d", "2D * size(array_intersect(t.grams, d)) / (t.n + size(d))")
    best = lets(
        f"array_max(flatten(transform({starts}, x -> transform({ends}, b -> {dice}))))",
        ("hits", "transform(g, y -> array_contains(t.grams, y))"),
        ("places", "filter(transform(hits, (h, i) -> if(h, i, -1)), i -> i >= 0)"),
        ("stops", f"filter(places, i -> not {hit('i + 1')})"))
    found = f"transform(filter({templates}, t -> size(array_intersect(t.grams, known)) >= {few}), t -> struct(t.name as name, t.rank as rank, {best} as dice))"
    return lets(
        f"filter({found}, m -> m.dice >= {least}D)",
        ("v", words),
        ("g", "if(size(v) < 2, cast(array() as array<string>), transform(slice(v, 2, size(v) - 1), (y, i) -> concat(v[i], ' ', y)))"),
        ("known", f"array_intersect(flatten(transform({templates}, t -> t.grams)), g)"))


def matches_sql(text: str, templates: dict[str, str], least: float) -> str:
    """Array of (name, rank, dice, counts) of the matches of all units, and of the best window of each template; that
    does not count if a unit matches the template."""
    grams = {k: bigrams(v) for k, v in templates.items()}
    sizes = [len(g) for g in grams.values()]
    rows = ", ".join(f"struct('{k}' as name, {i} as rank, {len(g)} as n, array({', '.join(repr(x) for x in g)}) as grams)" for i, (k, g) in enumerate(grams.items()))
    low, high = least / (2 - least) - 1e-9, (2 - least) / least + 1e-9
    words_of = lambda x: f"array_remove(split(regexp_replace(lower({x}), '[^a-z0-9]+', ' '), ' '), '')"
    pairs = lets("if(size(v) < 2, array(), array_distinct(transform(slice(v, 2, size(v) - 1), (y, i) -> concat(v[i], ' ', y))))", ("v", words_of("u")))
    score = ("filter(transform(filter(templates, t -> size(g) >= {low} * t.n and size(g) <= {high} * t.n), "
             "t -> struct(t.name as name, t.rank as rank, 2D * size(array_intersect(t.grams, g)) / (t.n + size(g)) as dice, true as counts)), m -> m.dice >= {least}D)").format(low=f"{low!r}D", high=f"{high!r}D", least=least)
    gate = f"lower({text}) rlike '(?<![a-z0-9])(?:{'|'.join(gate_words(templates, least))})(?![a-z0-9])'"
    none = "cast(array() as array<struct<name:string,rank:int,dice:double,counts:boolean>>)"
    units = f"flatten(transform(filter({units_sql(text)}, u -> length(u) >= {int(min(sizes) * low * 2)}), u -> {let(pairs, 'g', score)}))"
    windows = windows_sql("templates", words_of(text), low, high, least)
    both = f"concat(units, transform({windows}, m -> struct(m.name as name, m.rank as rank, m.dice as dice, not exists(units, x -> x.rank = m.rank) as counts)))"
    return f"if({gate}, {lets(both, ('templates', f'array({rows})'), ('units', units))}, {none})"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_matches (units that match a template, a unit counts for each, and
    templates that only a window matches), license (name of the best
    match, null if none), dice (its score) and licenses (all names, in the templates' order, comma-joined)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", F.expr(matches_sql("text", templates, least)).alias("m"))
    best = "element_at(array_sort(m, (a, b) -> case when a.dice > b.dice then -1 when a.dice < b.dice then 1 else a.rank - b.rank end), 1)"
    return d.select(
        "doc_id",
        F.expr("cast(size(filter(m, x -> x.counts)) as bigint)").alias("n_matches"),
        F.expr(f"if(size(m) = 0, null, {best}.name)").alias("license"),
        F.expr(f"if(size(m) = 0, null, {best}.dice)").alias("dice"),
        F.expr("array_join(transform(array_sort(array_distinct(transform(m, x -> struct(x.rank as rank, x.name as name)))), x -> x.name), ',')").alias("licenses"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The units, and all runs of words, in SQL."""
    low, high = LEAST / (2 - LEAST) - 1e-9, (2 - LEAST) / LEAST + 1e-9
    values = ", ".join("({}, {}, {})".format(repr(k), i, "[" + ", ".join(map(repr, bigrams(v))) + "]") for i, (k, v) in enumerate(TEMPLATES.items()))
    return rf"""
WITH t(name, rank, grams) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT DISTINCT doc_id, u FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM d
    UNION ALL SELECT doc_id, u FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[\x20\x09\x0D]*\n')) AS u FROM d) WHERE contains(u, chr(10))
    UNION ALL SELECT doc_id, text FROM d WHERE len(regexp_split_to_array(text, '\n[\x20\x09\x0D]*\n')) > 1)),
v AS (SELECT doc_id, u, list_filter(string_split(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM v WHERE len(w) > 1),
s AS (SELECT doc_id, name, rank, 2 * len(list_intersect(grams, g)) / (len(grams) + len(g))::DOUBLE AS dice FROM g, t),
-- runs of words: from each place of a bigram of the template, all lengths up to the bound
x AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, i, g, coalesce(lag(i) OVER (PARTITION BY doc_id, g ORDER BY i), -1) AS prev FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS g FROM x, unnest(range(1, len(w))) AS r(i))),
k AS (SELECT name, rank, len(grams) AS n, unnest(grams) AS g FROM t),
h AS (SELECT doc_id, name, rank, n, i, p.g FROM p JOIN k USING (g)),
c AS (SELECT doc_id, name, rank, n FROM h GROUP BY ALL HAVING count(DISTINCT g) >= ceil(n * {low!r})),
r AS (SELECT c.doc_id, c.name, c.rank, c.n, h.i AS a, p.i, (p.prev < h.i)::INTEGER AS new, (p.prev < h.i AND k.g IS NOT NULL)::INTEGER AS hit
      FROM c JOIN h USING (doc_id, name) JOIN p ON p.doc_id = c.doc_id AND p.i >= h.i AND p.i < h.i + floor(c.n * {high!r}) LEFT JOIN k ON k.name = c.name AND k.g = p.g),
e AS (SELECT doc_id, name, rank, 2 * sum(hit) OVER o / (n + sum(new) OVER o)::DOUBLE AS dice FROM r WINDOW o AS (PARTITION BY doc_id, name, a ORDER BY i)),
f AS (SELECT doc_id, name, rank, max(dice) AS dice FROM e GROUP BY ALL),
m AS (SELECT *, true AS counts FROM s WHERE dice >= {LEAST} UNION ALL
      SELECT f.*, NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = f.doc_id AND s.name = f.name AND s.dice >= {LEAST}) AS counts FROM f WHERE dice >= {LEAST}),
a AS (SELECT doc_id, count(*) FILTER (counts) AS n_matches, arg_max(name, (dice, -rank)) AS license, max(dice) AS dice FROM m GROUP BY doc_id),
n AS (SELECT doc_id, string_agg(name, ',' ORDER BY rank) AS licenses FROM (SELECT DISTINCT doc_id, name, rank FROM m) GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, license, dice, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN n USING (doc_id)
"""


OP7_SQL = oracle()
