"""Licence scan: units of normalised text against licence templates.

A unit is a line, a paragraph of several lines (between lines without letters and digits, so
that wrapped and commented notices count), the whole text, or a run of one to three sentences
of a line or paragraph, so that notices within other words count. Units and templates are
compared by the Dice coefficient of their sets of word bigrams; a template of b bigrams can only
reach the threshold t with units of t/(2-t)*b to (2-t)/t*b bigrams, so others are never
compared. Such a unit has t/(2-t)*b of the template's bigrams, so it has one of a few words that
occur in more of them than it may lack (`keys`): texts and units without such a word are left
out at once. A unit counts for the template most like it. Everything is a Catalyst expression;
the templates are one literal of fixed size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from kestrel.llm import common

THRESHOLD = 0.8
#: Words too common to tell a licence.
COMMON = set("a above all an and any are as at be but by can copy event file following for form free freely from get in including is it its list make made may modify name no not of on one or other out program purpose shall software source subject terms that the this to under use used version want was what will with without work you your 0 1 2 3 4".split())
# Short forms and paragraphs of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-paragraph": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-clause-1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-clause-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-clause-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "Apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense-permission": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Do what the fuck you want to public license",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def bigrams(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and the greatest number of bigrams with which a unit can reach the threshold; the least is also what it must share."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9), math.floor((2 - threshold) / threshold * n + 1e-9)


def keys(threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches the threshold has one: for each template they occur in more bigrams than a unit may lack."""
    chosen: list[str] = []
    for text in TEMPLATES.values():
        left = bigrams(text)
        spare = len(left) - _bounds(len(left), threshold)[0]
        words = {w for g in left for w in g.split()} - COMMON
        left = [g for g in left if not set(g.split()) & set(chosen)]
        while len(bigrams(text)) - len(left) <= spare:
            best = max(sorted(words), key=lambda w: (sum(w in g.split() for g in left), len(w)))
            chosen.append(best)
            left = [g for g in left if best not in g.split()]
    return sorted(chosen)


def _templates(threshold: float, array) -> tuple[list, int]:
    rows = []
    for name, text in TEMPLATES.items():
        b = bigrams(text)
        rows.append((name, *_bounds(len(b), threshold), len(b), array("'%s'" % x for x in b)))
    return rows, min(r[1] for r in rows)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_matches (different units), licenses (sorted ids, by comma), best_license, best_dice.

    Null, empty or unmatched texts give 0 matches, an empty list, and nulls; long texts are read in full. Of templates
    equally like a unit, and of equal best scores, the smallest id counts. Repeated rows give a result each.
    """
    rows, least = _templates(threshold, lambda xs: f"array({', '.join(xs)})")
    lits = ", ".join(f"named_struct('id', '{n}', 'lo', {lo}, 'hi', {hi}, 'n', {k}, 'grams', {a})" for n, lo, hi, k, a in rows)
    key = rf"'\\b(?:{'|'.join(keys(threshold))})\\b'"
    text = docs.selectExpr("doc_id", r"regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;]+[ \\t]+', '\u0001'), '[^a-z0-9\\n\\x01]+', ' ') AS marked")
    text = text.selectExpr("doc_id", f"CASE WHEN marked RLIKE {key} THEN marked ELSE '' END AS marked")
    lines = text.selectExpr("doc_id", "marked", r"split(marked, '\\n') AS lines", r"CASE WHEN replace(marked, '\u0001', ' ') RLIKE '\\n *\\n' THEN transform(filter(split(marked, '\\n[ \\x01]*\\n[ \\x01\\n]*'), p -> contains(p, '\n')), p -> replace(p, '\n', ' ')) ELSE array() END AS paragraphs")
    sentences = lines.selectExpr("doc_id", "marked", "lines", "paragraphs", rf"transform(filter(concat(lines, paragraphs), p -> contains(p, '\u0001') AND p RLIKE {key}), p -> split(p, '\\x01')) AS sents")
    runs = "flatten(transform(sents, s -> flatten(transform(array(1, 2, 3), k -> transform(sequence(1, size(s)), i -> array_join(slice(s, i, k), ' '))))))"
    units = sentences.selectExpr("doc_id", rf"concat(lines, paragraphs, CASE WHEN contains(marked, '\n') THEN array(replace(marked, '\n', ' ')) ELSE array() END, {runs}) AS units")
    clean = units.selectExpr("doc_id", rf"array_distinct(transform(filter(units, u -> u RLIKE {key}), u -> trim(regexp_replace(u, '[ \\x01]+', ' ')))) AS units")
    words = clean.selectExpr("doc_id", f"filter(transform(units, u -> split(u, ' ')), w -> size(w) > {least}) AS units")
    grams = words.selectExpr("doc_id", "transform(units, w -> array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b)))) AS units")
    most = max(r[2] for r in rows)
    sized = grams.selectExpr("doc_id", f"filter(units, g -> size(g) BETWEEN {least} AND {most}) AS units")
    order = "(x, y) -> CASE WHEN x.dice > y.dice THEN -1 WHEN x.dice < y.dice THEN 1 WHEN x.id < y.id THEN -1 WHEN x.id > y.id THEN 1 ELSE 0 END"
    hits = sized.selectExpr(
        "doc_id",
        f"""filter(transform(units, g -> get(array_sort(filter(transform(
              filter(array({lits}), t -> size(g) BETWEEN t.lo AND t.hi),
              t -> named_struct('dice', round(2.0D * size(array_intersect(g, t.grams)) / (size(g) + t.n), 6), 'id', t.id)),
            m -> m.dice >= {threshold}), {order}), 0)), h -> h IS NOT NULL) AS hits""",
    )
    best = hits.selectExpr("doc_id", "hits", f"get(array_sort(hits, {order}), 0) AS best")
    return best.selectExpr("doc_id", "CAST(size(hits) AS BIGINT) AS n_matches", "array_join(array_sort(array_distinct(hits.id)), ',') AS licenses", "best.id AS best_license", "best.dice AS best_dice")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in the lines, sentences, paragraphs and whole texts of every document."""
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL."""
    rows, _ = _templates(threshold, lambda xs: f"[{', '.join(xs)}]")
    values = ", ".join(f"('{n}', {lo}, {hi}, {k}, {a})" for n, lo, hi, k, a in rows)
    return rf"""
WITH templates(id, lo, hi, n, grams) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;]+[ \t]+', chr(1), 'g'), '[^a-z0-9\n\x01]+', ' ', 'g') AS marked FROM documents),
split AS (
  SELECT r, marked, string_split(marked, chr(10)) AS lines,
         CASE WHEN regexp_matches(replace(marked, chr(1), ' '), '\n *\n')
              THEN list_transform(list_filter(string_split_regex(marked, '\n[ \x01]*\n[ \x01\n]*'), lambda p: contains(p, chr(10))), lambda p: replace(p, chr(10), ' ')) ELSE [] END AS paragraphs
  FROM docs),
sentences AS (SELECT r, string_split(p, chr(1)) AS s FROM (SELECT r, unnest(list_concat(lines, paragraphs)) AS p FROM split) WHERE contains(p, chr(1))),
units AS (
  SELECT r, unnest(list_concat(lines, paragraphs, CASE WHEN contains(marked, chr(10)) THEN [replace(marked, chr(10), ' ')] ELSE [] END)) AS u FROM split
  UNION ALL SELECT r, unnest(list_concat(s, list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]), list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i + 1] || ' ' || s[i + 2]))) FROM sentences),
clean AS (SELECT DISTINCT r, trim(regexp_replace(u, '[ \x01]+', ' ', 'g')) AS u FROM units),
words AS (SELECT r, u, list_filter(string_split(u, ' '), lambda x: x <> '') AS w FROM clean),
grams AS (SELECT r, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
hits AS (
  SELECT r, u, t.id, round(2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + t.n), 6) AS dice
  FROM grams JOIN templates t ON len(g) BETWEEN t.lo AND t.hi),
good AS (SELECT r, dice, id FROM hits WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY r, u ORDER BY dice DESC, id) = 1),
per AS (
  SELECT r, count(*) AS n_matches, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses,
         first(id ORDER BY dice DESC, id) AS best_license, max(dice) AS best_dice
  FROM good GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM docs LEFT JOIN per USING (r)"""
