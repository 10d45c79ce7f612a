"""Licence scans: Dice coefficient over word bigrams against templates, in Spark expressions only.

Texts are put in lower case, with every stretch of other characters than a-z and 0-9 as one
blank. Their pieces are the sentences of their lines; units are all runs of consecutive pieces,
so lines, paragraphs, whole texts and licences inside longer texts are among them. The Dice
coefficient of the sets of word bigrams of unit and template is 2 |A and B| / (|A| + |B|).

With a bound t, a match has at least t/(2-t) b of the template's b bigrams and no more than
(2-t)/t b of its own. So it holds one of any b - t/(2-t) b + 1 bigrams: gate words that touch as
many of each template decide which texts are looked at, and of these a template is only compared
with texts that have t/(2-t) b of its bigrams. A unit's coefficient doesn't fall if a piece
without a bigram of the template is left out at its ends, so units begin and end with pieces that
have one. A unit has at most 2 b + 2 words: only units in which a quarter of the bigrams are
repeats are longer.

Null and empty texts match nothing. The best coefficient of an id's texts for each licence and
kind is given; rows without an id count as one. Columns besides id and text don't matter. An
empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import let

LEAST = 0.8
_NO_WARRANTY = """The software is provided "as is", without warranty of any kind, express or implied, including but not
limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall
the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract,
tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the
software."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_3RD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_END = """This software is provided by the copyright holders and contributors "as is" and any express or implied
warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose
are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental,
special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services;
loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in
contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this
software, even if advised of the possibility of such damage."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_ISC_END = """The software is provided "as is" and the author disclaims all warranties with regard to this software
including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special,
direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether
in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance
of this software."""
#: Fixed values: (licence, kind, template). Notices are what texts say of their licence.
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. """ + _NO_WARRANTY),
    ("GPL", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "notice", "This program is licensed under the GNU General Public License."),
    ("GPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""),
    ("LGPL", "notice", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD", "notice", "Released under the BSD License."),
    ("BSD-2-Clause", "text", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", "text", f"{_BSD_2} {_BSD_3RD} {_BSD_END}"),
    ("ISC", "text", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", "text", f"{_ISC}. {_ISC_END}"),
    ("Unlicense", "header", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
)


# Words so common in English texts that they make poor gate words.
COMMON = frozenset("a an and any are as at be by can do for from general in is it may not of on or public the this to under use with you".split())


def bigrams_of(template: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", template.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def gate_words(least: float = LEAST) -> list[str]:
    """Words such that each match of each template holds one of them (see above); common words last, then longest first for each template."""
    chosen: set[str] = set()
    for _, _, template in TEMPLATES:
        pairs = bigrams_of(template)
        need = len(pairs) - math.ceil(least / (2 - least) * len(pairs) - 1e-9) + 1
        for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if sum(bool(chosen & set(p.split())) for p in pairs) >= need:
                break
            chosen.add(word)
    return sorted(chosen)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def _gate(least: float) -> str:
    """Finds a gate word among the words of a normalised text, without normalising it: an underscore ends a word."""
    return "(?<![a-z0-9])(?:" + "|".join(gate_words(least)) + ")(?![a-z0-9])"


def pieces(lowered: Column) -> Column:
    """The normalised sentences of a text's lines; those without words go."""
    cut = F.flatten(F.transform(F.split(lowered, "\n", -1), lambda x: F.split(x, r"(?<=[.!?])[ \t]+", -1)))
    return F.filter(F.transform(cut, normalised), lambda p: p != "")


def _best(words: Column, pairs: Column, template: Column, n: Column) -> Column:
    """The greatest Dice coefficient of a template and a unit, given the words (with their piece) and bigrams of a text."""
    at = lambda k: F.element_at(words, k)["piece"]
    size = F.size(words)

    def dice(a: Column, b: Column) -> Column:
        return let(F.array_distinct(F.slice(pairs, a, b - a)), lambda own: F.round(2.0 * F.size(F.array_intersect(own, template)) / (n + F.size(own)), 6))

    def greatest(begins: Column, ends: Column) -> Column:
        each = lambda a: F.array_max(F.transform(F.filter(ends, lambda b: (b > a) & (b - a < 2 * n + 2)), lambda b: dice(a, b)))
        return F.array_max(F.transform(begins, each))

    def among(hits: Column) -> Column:
        every = F.sequence(F.lit(1), size)
        begins = let(F.array_distinct(F.transform(hits, at)), lambda own: F.filter(every, lambda k: F.when(k == 1, True).otherwise(at(F.greatest(k - 1, F.lit(1))) != at(k)) & F.array_contains(own, at(k))))
        ends = let(F.array_distinct(F.transform(hits, lambda k: at(k + 1))), lambda own: F.filter(every, lambda k: F.when(k == size, True).otherwise(at(F.least(k + 1, size)) != at(k)) & F.array_contains(own, at(k))))
        return let(begins, lambda x: let(ends, lambda y: greatest(x, y)))

    return let(F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda k: F.array_contains(template, F.element_at(pairs, k))), among)


def matches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """(id, licence, kind, dice): the best coefficient of each text's units for each licence that reaches the bound."""
    known = [(name, kind, bigrams_of(t)) for name, kind, t in TEMPLATES]
    listed = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(k).alias("kind"), listed(b).alias("pairs"), F.lit(len(b)).alias("n")) for n, k, b in known))
    some = listed(sorted({p for *_, b in known for p in b}))
    lowered = docs.select(F.col(id_column).alias("id"), F.lower(F.coalesce(F.col(text_column), F.lit(""))).alias("text")).where(F.col("text").rlike(_gate(least)))
    held = let(F.split(normalised(F.col("text")), " "), lambda w: F.array_intersect(bigrams(w), some))
    enough = let(held, lambda own: F.filter(table, lambda t: F.size(F.array_intersect(t["pairs"], own)) >= least / (2 - least) * t["n"] - 1e-9))
    able = lowered.select("id", "text", F.explode(enough).alias("t"))
    placed = F.flatten(F.transform(pieces(F.col("text")), lambda p, i: F.transform(F.split(p, " "), lambda w: F.struct(w.alias("w"), i.alias("piece")))))
    template = lambda words, pairs: _best(words, pairs, F.col("t.pairs"), F.col("t.n"))
    best = let(placed, lambda words: let(bigrams(F.transform(words, lambda x: x["w"])), lambda pairs: template(words, pairs)))
    found = able.select("id", "t.licence", "t.kind", best.alias("dice"))
    return found.where(F.col("dice") >= least).groupBy(F.col("id").alias(id_column), "licence", "kind").agg(F.max("dice").alias("dice"))


def oracle_sql(least: float = LEAST) -> str:
    """The same result as one DuckDB query: no gate words, units from rows of numbered words."""
    rows = ", ".join("({}, '{}', '{}', {}, [{}])".format(i, n, k, len(b), ", ".join(f"'{p}'" for p in b)) for i, (n, k, b) in enumerate((n, k, bigrams_of(t)) for n, k, t in TEMPLATES))
    return rf"""
WITH templates(tid, licence, kind, n, pairs) AS (VALUES {rows}),
parts AS MATERIALIZED (SELECT tid, n, unnest(pairs) AS pair FROM templates),
texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS text FROM documents),
lines AS (SELECT rid, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM texts)),
cut AS (SELECT rid, ln, generate_subscripts(ps, 1) AS pn, unnest(ps) AS piece FROM (SELECT rid, ln, string_split(regexp_replace(line, '([.!?])[ 	]+', '' || chr(1), 'g'), chr(1)) AS ps FROM lines)),
spelt AS (SELECT rid, ln, pn, string_split(trim(regexp_replace(piece, '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM cut WHERE regexp_matches(piece, '[a-z0-9]')),
words AS MATERIALIZED (
  SELECT rid, ln, pn, w, row_number() OVER (PARTITION BY rid ORDER BY ln, pn, i) AS k
  FROM (SELECT rid, ln, pn, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM spelt)
),
spans AS (SELECT rid, ln, pn, min(k) AS a, max(k) AS b FROM words GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT rid, k, a, next_b, w || ' ' || next_w AS pair
  FROM (SELECT rid, k, w, a, lead(w) OVER v AS next_w, lead(b) OVER v AS next_b FROM words JOIN spans USING (rid, ln, pn) WINDOW v AS (PARTITION BY rid ORDER BY k))
  WHERE next_w IS NOT NULL
),
hits AS MATERIALIZED (SELECT tid, n, rid, k, a, next_b, pair FROM pairs JOIN parts USING (pair)),
able AS (SELECT tid, rid, n FROM hits GROUP BY tid, rid, n HAVING count(DISTINCT pair) >= {least / (2 - least)}::DOUBLE * n - 1e-9),
units AS MATERIALIZED (
  SELECT tid, rid, n, a, next_b AS b FROM able JOIN (SELECT DISTINCT tid, rid, a FROM hits) USING (tid, rid) JOIN (SELECT DISTINCT tid, rid, next_b FROM hits) USING (tid, rid)
  WHERE next_b > a AND next_b - a < 2 * n + 2
),
scored AS (
  SELECT u.tid, u.rid, u.a, u.b, u.n, count(DISTINCT p.pair) AS own, count(DISTINCT h.pair) AS shared
  FROM units u JOIN pairs p ON p.rid = u.rid AND p.k >= u.a AND p.k < u.b LEFT JOIN parts h ON h.tid = u.tid AND h.pair = p.pair GROUP BY ALL
)
SELECT doc_id, licence, kind, max(round(2.0::DOUBLE * shared / (s.n + own), 6)) AS dice
FROM scored s JOIN templates t USING (tid) JOIN texts x USING (rid) WHERE round(2.0::DOUBLE * shared / (s.n + own), 6) >= {least} GROUP BY ALL
"""
