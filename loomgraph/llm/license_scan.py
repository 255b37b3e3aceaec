"""Licence scans: sentences, and whole texts, against licence templates by the
Dice coefficient of their word bigrams.  DataFrame functions only.

A unit matches a template if 2 * common / (|unit| + |template|) >= threshold,
over distinct bigrams of normalised words.  Two exact prunings come first:

* size bounds: |unit| is within threshold / (2 - threshold) of |template|; as a
  table of (size, template) it makes the comparison an equi-join on the size;
* key words: a match leaves fewer than (2 - 2 * threshold) / (2 - threshold) of
  a template's bigrams out, so it has one of some words that touch more than
  those.  Texts without any are passed over with one pattern.

With ``wrapped``, units are also the paragraphs of several lines and, rejoined
over line ends, their sentences.  Marks of comments are no words, so they fall
away, and a line of marks alone parts paragraphs as an empty one does.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: Notices and short texts of public licences, and the paragraphs
#: that their full texts have.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-copyright-grant": "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense-freedom": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-dedication": "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib-warranty": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "Zlib-notice": "This notice may not be removed or altered from any source distribution.",
}

#: The paragraphs that a licence's full text has; ``full`` texts have all of them.
FULL_TEXTS = {
    "Apache-2.0-notice": ("Apache-2.0-header", "Apache-2.0-obtain", "Apache-2.0-warranty"),
    "BSD-2-Clause-text": ("BSD-conditions", "BSD-source", "BSD-binary", "BSD-warranty"),
    "BSD-3-Clause-text": ("BSD-conditions", "BSD-source", "BSD-binary", "BSD-3-Clause-names", "BSD-warranty"),
    "ISC-text": ("ISC", "ISC-warranty"),
    "MIT-text": ("MIT-grant", "MIT-condition", "MIT-warranty"),
    "Unlicense-text": ("Unlicense", "Unlicense-freedom", "Unlicense-dedication"),
    "Zlib-text": ("Zlib-warranty", "Zlib-grant", "Zlib-origin", "Zlib-altered", "Zlib-notice"),
}

THRESHOLD = "0.8"


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def key_words(text: str, threshold: Fraction) -> list[str]:
    """Words of a template of which every match has at least one: the bigrams
    that none of them touches are fewer than a match has to share."""
    left, keys = template_bigrams(text), []
    least = len(left) * threshold / (2 - threshold)
    while left and len(left) >= least:
        counts = {w: sum(w in b.split() for b in left) for w in template_words(text)}
        best = max(counts, key=lambda w: (counts[w] > 0, len(w), counts[w], w))
        keys.append(best)
        left = [b for b in left if best not in b.split()]
    return keys


def _bigrams(unit: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(lower_ascii(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    # a lambda that names `words` would split the text anew for each word
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda v, w: F.concat_ws(" ", v, w))
    return F.array_distinct(pairs)


def _wrapped(text: Column, lines: bool = False) -> Column:
    """Paragraphs of several lines, unless they are the whole text, and their
    sentences that go over a line end; with ``lines``, paragraphs of one line
    and several sentences too."""
    paragraphs = F.split(F.regexp_replace(F.translate(text, "\1\2", "  "), "\n[^A-Za-z0-9]*\n", "\2"), "\2")
    ended = lambda p: F.regexp_replace(F.regexp_replace(p, "([.!?])[ \n]", "$1\1"), ":\n", ":\1")
    sentences = F.transform(paragraphs, lambda p: F.filter(F.split(ended(p), "\1"), lambda s: s.contains("\n") & (s != p)))
    several = lambda p: p.contains("\n") | p.rlike("[.!?] ") if lines else p.contains("\n")
    return F.concat(F.filter(paragraphs, lambda p: several(p) & (p != text)), F.flatten(sentences))


def licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: str = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False, lines: bool = False) -> DataFrame:
    """Licences that the sentences of each text, or it as a whole, state; with
    ``wrapped``, its paragraphs and sentences of several lines too, and with
    ``lines`` those paragraphs of one line that have several sentences.

    Returns one row per row of ``docs``: doc_id, n_matches (units that match a
    template), licences (ids, comma-joined in order), best_licence and
    best_dice (the highest; the first id of equals).  A unit counts for the
    template it is most like.  Defined results: null, empty and unmatched texts
    have n_matches 0, licences '' and nulls; rows that repeat an id or have
    none are scanned each; other columns are not read.
    """
    templates, t = templates or TEMPLATES, Fraction(threshold)
    grams = {name: template_bigrams(text) for name, text in templates.items()}
    table = []
    for name, g in grams.items():
        low, high = len(g) * t / (2 - t), len(g) * (2 - t) / t
        table += [(n, name, g) for n in range(max(1, -(-low.numerator // low.denominator)), high.numerator // high.denominator + 1)]
    spark = docs.sparkSession
    sizes = F.broadcast(spark.createDataFrame(table, "size int, licence string, template array<string>"))  # fixed by the templates
    keys = sorted({w for text in templates.values() for w in key_words(text, t)})
    pattern = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(keys) + ")(?![A-Za-z0-9])"

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.where(F.col("text").rlike(pattern)).withColumn("row", F.xxhash64("doc_id", "text"))
    sentences = F.split(F.regexp_replace("text", r"([.!?]) ", "$1\n"), "\n")
    pieces = F.array_append(sentences, F.col("text"))
    pieces = F.concat(pieces, _wrapped(F.col("text"), lines)) if wrapped else pieces
    units = found.select("row", "doc_id", F.posexplode(pieces).alias("unit", "piece"))
    units = units.where(F.col("piece").rlike(pattern))
    units = units.select("row", "doc_id", "unit", _bigrams(F.col("piece")).alias("grams")).withColumn("size", F.size("grams"))
    dice = (2.0 * F.size(F.array_intersect("grams", "template")) / (F.col("size") + F.size("template"))).alias("dice")
    near = units.join(sizes, "size").select("row", "doc_id", "unit", "licence", dice).where(F.col("dice") >= float(t))
    best = near.groupBy("row", "doc_id", "unit").agg(F.max("dice").alias("dice"), F.min_by("licence", F.struct(-F.col("dice"), "licence")).alias("licence"))
    # rows alike in id and text are scanned alike: units are counted once
    of = best.groupBy("row", "doc_id").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),  # at most one per template
        F.min_by("licence", F.struct(-F.col("dice"), "licence")).alias("best_licence"),
        F.max("dice").alias("best_dice"),
    )
    # the id is joined too: at many billions of rows two hashes can be alike
    of = of.withColumnRenamed("doc_id", "of_id")
    all_rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    out = all_rows.join(of, (all_rows.row == of.row) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
    return out.select("doc_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licences", F.lit("")).alias("licences"), "best_licence", F.round("best_dice", 6).alias("best_dice"))


def full_texts(found: DataFrame, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``found``, as ``licences`` returns it, with full: the names of the full
    texts all of whose paragraphs were found, in order, comma-joined ('' if
    there are none).  A text that another one goes beyond (BSD-3-Clause beyond
    BSD-2-Clause) is named too only if it stands for itself: the longer one is
    enough."""
    texts = FULL_TEXTS if texts is None else texts
    have = F.split("licences", ",")
    whole = {name: F.size(F.array_except(F.array(*[F.lit(p) for p in parts]), have)) == 0 for name, parts in sorted(texts.items())}
    beyond = {name: [m for m, parts in texts.items() if m != name and set(texts[name]) < set(parts)] for name in texts}
    named = []
    for name, hit in whole.items():
        for m in beyond[name]:
            hit = hit & ~whole[m]
        named.append(F.when(hit, F.lit(name)))
    return found.withColumn("full", F.concat_ws(",", *named))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "license-scan").result(licences(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op3_wrapped_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "license-scan").result(licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), wrapped=True))


def op3_full_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With units over several lines; full: the licences whose whole text is there."""
    return Scratch(spark, "license-scan").result(full_texts(licences(spark.read.parquet(f"{sf_dir}/documents.parquet"), wrapped=True, lines=True)))


_UNITS = """u0 AS (SELECT doc_id, unnest(list_append(string_split(regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), chr(10)), text)) AS piece,
              unnest(range(1 + len(string_split(regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), chr(10))))) AS unit FROM d)"""
_WRAPPED_UNITS = """p AS (SELECT doc_id, text, string_split(regexp_replace(translate(text, chr(1) || chr(2), '  '), '\\n[^A-Za-z0-9]*\\n', chr(2), 'g'), chr(2)) AS ps FROM d),
l AS (SELECT doc_id, list_concat(list_append(string_split(regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), chr(10)), text),
        list_filter(ps, lambda x: contains(x, chr(10)) AND x <> text),
        flatten(list_transform(ps, lambda x: list_filter(string_split(replace(regexp_replace(x, '([.!?])[ \\n]', '\\1' || chr(1), 'g'), ':' || chr(10), ':' || chr(1)), chr(1)), lambda y: contains(y, chr(10)) AND y <> x)))) AS ls FROM p),
u0 AS (SELECT doc_id, unnest(ls) AS piece, unnest(range(len(ls))) AS unit FROM l)"""


_ONE_LINE, _LINES = "lambda x: contains(x, chr(10)) AND x <> text", "lambda x: (contains(x, chr(10)) OR regexp_matches(x, '[.!?] ')) AND x <> text"


def sql(templates: dict[str, str] | None = None, threshold: str = THRESHOLD, wrapped: bool = False, full: bool = False) -> str:
    """DuckDB: every unit of every text against every template; ``full``: and
    whose whole text is there."""
    values = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in template_bigrams(text))) for n, text in (templates or TEMPLATES).items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(licence, g) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{(_WRAPPED_UNITS.replace(_ONE_LINE, _LINES) if full else _WRAPPED_UNITS) if wrapped else _UNITS},
u AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace({low.format('piece')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM u0),
b AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS a FROM u WHERE len(w) > 1),
s AS (SELECT doc_id, unit, licence, 2.0::DOUBLE * len(list_intersect(a, g)) / (len(a) + len(g)) AS dice FROM b, t
      WHERE 2.0 * least(len(a), len(g)) >= {threshold} * (len(a) + len(g))),
m AS (SELECT doc_id, unit, dice, licence FROM s WHERE dice >= {threshold}::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence) = 1),
r AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, arg_min(licence, (-dice, licence)) AS best_licence, max(dice) AS best_dice FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences, best_licence, round(best_dice, 6) AS best_dice{_full_sql() if full else ''} FROM d LEFT JOIN r USING (doc_id)
"""


def _full_sql() -> str:
    has = lambda name: "(" + " AND ".join(f"list_contains(string_split(licences, ','), '{p}')" for p in FULL_TEXTS[name]) + ")"
    longer = lambda name: [m for m, parts in FULL_TEXTS.items() if m != name and set(FULL_TEXTS[name]) < set(parts)]
    cases = ", ".join(f"CASE WHEN {' AND NOT '.join(has(m) for m in [name, *longer(name)])} THEN '{name}' END" for name in sorted(FULL_TEXTS))
    return f", concat_ws(',', {cases}) AS \"full\""
