"""Operator 8 [native]: licence scans by Dice coefficient over word bigrams.

A text is lower-cased, all but a-z and digits becomes blanks, line ends too, and its words are compared
with licence templates in windows as long as the template, wherever they stand: wrapped over lines,
inside a longer line, after comment marks. A window matches where
``2 * |shared| / (|window| + |template|) >= threshold`` over sets of word bigrams.

A match shares at least ``b * t / (2 - t)`` of a template's b bigrams. A few long words are chosen so
that fewer bigrams than that are without any of them; so every match has a bigram with such a word,
and windows are laid only where such a bigram stands, as it stands (first) in the template. Windows
whose bigram sets are smaller or larger than a match can be (at a text's end, or of repeated words) are
passed over by these size bounds before sets are compared, and so are texts without any of the words.

Each licence is reported once, with its best window: the one with most shared bigrams, then the highest
Dice value, the first start, the template named first. A licence whose window overlaps that of a better
one (more shared bigrams, then Dice, then name) is left out, so GPL 2 and 3 do not answer for one notice.

The templates are a small table of fixed texts, given as a parameter and held in the plan as a
literal. Everything is a column expression on one row: no join, no shuffle. Licences of many pages
(Apache 2.0, the GPL family, MPL, CC) are known by the notices they tell authors to use.

Edge cases: a null or empty text, or one of a single word, matches nothing; repeated rows are repeated;
extra columns are dropped; an empty table gives an empty table; very long texts are searched whole.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import table

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public licence texts and notices, by their usual identifiers.
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
ISC_START = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
TEMPLATES = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + ISC_END,),
    "AGPL-3.0": (GNU.format("Affero General Public License", "3"),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{BSD_START} {BSD_END}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", f"{BSD_START} {BSD_THIRD} {BSD_END}"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", GNU.format("General Public License", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", GNU.format("General Public License", "3")),
    "ISC": (ISC_START, f"{ISC_START} {ISC_END}"),
    "LGPL-3.0": (GNU.format("Lesser General Public License", "3"),),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS,
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
}


def normalised_words(text: str) -> list[str]:
    """Words of a text, as the column expressions below see them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def known_templates(templates: dict[str, tuple[str, ...]]) -> list[dict]:
    """Each template's number, licence, word count, and distinct bigrams with the place of the first of each."""
    out = []
    for licence in sorted(templates):
        for text in templates[licence]:
            words = normalised_words(text)
            first: dict[str, int] = {}
            for i, (a, b) in enumerate(zip(words, words[1:], strict=False)):
                first.setdefault(f"{a} {b}", i)
            if first:
                out.append({"no": len(out), "licence": licence, "words": len(words), "grams": list(first), "places": list(first.values())})
    return out


def least_shared(n: int, threshold: float) -> float:
    return n * threshold / (2 - threshold)


def needed_words(known: list[dict], threshold: float) -> list[str]:
    """Words of which every match holds one, in a bigram that it shares.

    Words are taken, first those of six letters or more that stand in most bigrams, until each template's
    bigrams without any of them are too few for a match.
    """
    open_ = {t["no"]: [g.split() for g in t["grams"]] for t in known}
    out: set[str] = set()
    while True:
        open_ = {no: grams for no, grams in open_.items() if len(grams) >= least_shared(len(known[no]["grams"]), threshold)}
        if not open_:
            return sorted(out)
        counts = Counter(w for grams in open_.values() for g in grams for w in set(g))
        word = min(counts, key=lambda w: (len(w) < 6, len(w) < 4, -counts[w], w))
        out.add(word)
        open_ = {no: [g for g in grams if word not in g] for no, grams in open_.items()}


def anchor_bigrams(known: list[dict], needed: list[str]) -> list[str]:
    return sorted({g for t in known for g in t["grams"] if set(g.split()) & set(needed)})


def let(value: Column, use) -> Column:
    """``use(value)``, with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def listed(words: list[str]) -> Column:
    """An array of strings as one literal that is split."""
    return F.split(F.lit("|".join(words)), r"\|")


def licence_matches(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches: array<struct<licence, start, words, dice>> by licence; start counts words from 0."""
    known = known_templates(templates or TEMPLATES)
    needed = needed_words(known, threshold)
    anchors = listed(anchor_bigrams(known, needed))
    held = F.array(
        *(
            F.struct(F.lit(t["no"]).alias("no"), F.lit(t["licence"]).alias("licence"), F.lit(t["words"]).alias("words"), F.lit(len(t["grams"])).alias("n"), listed(t["grams"]).alias("grams"), listed([str(p) for p in t["places"]]).cast("array<int>").alias("places"))
            for t in known
        )
    )
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    holds = reduce(lambda a, b: a | b, [low.contains(w) for w in needed])

    def found(grams: Column) -> Column:
        """Windows of all bigrams of a text that match, one for each licence at least."""
        return let(F.array_intersect(grams, anchors), lambda here: F.when(F.size(here) > 0, matched(grams, here)).otherwise(none))

    def matched(grams: Column, here: Column) -> Column:
        hits = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(here, g), F.struct(i.alias("i"), g.alias("g")))), lambda x: x.isNotNull())
        at = lambda t, x: F.greatest(x["i"] - F.element_at(t["places"], F.array_position(t["grams"], x["g"]).cast("int")), F.lit(0))
        starts = lambda t: F.array_distinct(F.transform(F.filter(hits_(), lambda x: F.array_contains(t["grams"], x["g"])), lambda x: at(t, x)))
        hits_ = lambda: hits

        def scored(t: Column, start: Column) -> Column:
            window = F.array_distinct(F.slice(grams, start + 1, t["words"] - 1))
            able = lambda w: (F.size(w) >= t["n"] * threshold / (2 - threshold)) & (F.size(w) <= t["n"] * (2 - threshold) / threshold)
            sizes = lambda w: F.when(able(w), F.struct(F.size(F.array_intersect(w, t["grams"])).alias("shared"), F.size(w).alias("n")))
            judged = lambda x: F.struct(t["licence"].alias("licence"), (-x["shared"]).alias("fewer"), (-F.round(2.0 * x["shared"] / (x["n"] + t["n"]), 6)).alias("minus"), start.alias("start"), t["no"].alias("no"), t["words"].alias("words"))
            return let(let(window, sizes), judged)

        every = F.flatten(F.transform(held, lambda t: F.transform(starts(t), lambda s: scored(t, s))))
        return F.array_sort(F.filter(every, lambda x: -x["minus"] >= threshold))

    def reported(every: Column) -> Column:
        """Of each licence the best window, unless a better one of another licence overlaps it."""
        best = F.filter(every, lambda x, i: (i == 0) | (x["licence"] != F.get(every, i - 1)["licence"]))
        return let(best, apart)

    def apart(best: Column) -> Column:
        better = lambda o, x: F.struct(o["fewer"], o["minus"], o["licence"]) < F.struct(x["fewer"], x["minus"], x["licence"])
        over = lambda o, x: (o["start"] < x["start"] + x["words"]) & (x["start"] < o["start"] + o["words"])
        alone = F.filter(best, lambda x: ~F.exists(best, lambda o: better(o, x) & over(o, x)))
        return F.transform(alone, lambda x: F.struct(x["licence"].alias("licence"), x["start"].alias("start"), x["words"].alias("words"), (-x["minus"]).alias("dice")))

    none = F.array().cast("array<struct<licence:string,fewer:int,minus:double,start:int,no:int,words:int>>")
    words = F.filter(F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    bigrams = let(words, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    matches = let(let(bigrams, found), reported)
    nothing = F.array().cast("array<struct<licence:string,start:int,words:int,dice:double>>")
    return docs.select("doc_id", F.when(holds, matches).otherwise(nothing).alias("matches"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of licences found, their names, and the best Dice value (null: none)."""
    found = licence_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.transform("matches", lambda m: m["licence"]), ",")
    where = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["start"].cast("string"), m["words"].cast("string"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licences"), where.alias("windows"), F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"))


def licences_sql(templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same by joins: windows of every text laid by anchors, scored, and compared pairwise."""
    known = known_templates(templates or TEMPLATES)
    anchors = ", ".join(repr(g) for g in anchor_bigrams(known, needed_words(known, threshold)))
    rows = ", ".join(f"({t['no']}, '{t['licence']}', {t['words']}, [{', '.join(map(repr, t['grams']))}], {t['places']})" for t in known)
    return rf"""
WITH templates(no, licence, words, grams, places) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (
  SELECT row_no, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM docs),
bigrams AS (SELECT row_no, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM lists),
hits AS (
  SELECT row_no, i - 1 AS i, x FROM (SELECT row_no, generate_subscripts(g, 1) AS i, unnest(g) AS x FROM bigrams) WHERE x IN ({anchors})),
laid AS (
  SELECT DISTINCT row_no, no, greatest(i - places[list_position(grams, x)], 0) AS start
  FROM hits JOIN templates ON list_contains(grams, x)),
scored AS (
  SELECT row_no, no, licence, words, start, len(win) AS n, len(grams) AS b, len(list_intersect(win, grams)) AS shared
  FROM (SELECT l.*, t.licence, t.words, t.grams, list_distinct(g[start + 1 : start + t.words - 1]) AS win
        FROM laid l JOIN templates t USING (no) JOIN bigrams USING (row_no))),
able AS (
  SELECT *, round(2.0 * shared / (n + b), 6) AS dice FROM scored
  WHERE n >= b * {threshold}::DOUBLE / (2 - {threshold}::DOUBLE) AND n <= b * (2 - {threshold}::DOUBLE) / {threshold}::DOUBLE),
best AS (
  SELECT * FROM able WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY row_no, licence ORDER BY shared DESC, dice DESC, start, no) = 1),
apart AS (
  SELECT * FROM best x WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.row_no = x.row_no AND (-o.shared, -o.dice, o.licence) < (-x.shared, -x.dice, x.licence)
      AND o.start < x.start + x.words AND x.start < o.start + o.words))
SELECT d.doc_id, count(a.licence) AS n_matches, coalesce(string_agg(a.licence, ',' ORDER BY a.licence), '') AS licences,
       coalesce(string_agg(a.start || ':' || a.words, ',' ORDER BY a.licence), '') AS windows, max(a.dice)::DOUBLE AS best_dice
FROM docs d LEFT JOIN apart a USING (row_no) GROUP BY d.row_no, d.doc_id"""


def brute_force(text: str | None, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> dict[str, float]:
    """The best Dice value of each licence over every window of a text, laid by nothing, for tests."""
    words, out = normalised_words(text or ""), {}
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    for t in known_templates(templates or TEMPLATES):
        own = set(t["grams"])
        for start in range(max(1, len(words) - 1)):
            window = set(grams[start : start + t["words"] - 1])
            dice = round(2 * len(window & own) / (len(window) + len(own)), 6)
            if dice >= threshold and window:
                out[t["licence"]] = max(out.get(t["licence"], 0.0), dice)
    return out
