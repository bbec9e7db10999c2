"""Licence texts and notices found by the Dice coefficient of word bigrams; DataFrame functions alone."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.decontaminate import NOT_WORD, folded, let

#: From so many thousandths on a line or a text counts as the template.
LEAST = 750
#: Texts of public licences and their usual notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-3.0-notice-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _split(text: str) -> list[str]:
    return [x for x in re.split(f"[{NOT_WORD}]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]


def bigrams(text: str) -> list[str]:
    """A template's distinct word bigrams; of one word, that word."""
    w = _split(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) if len(w) > 1 else w


def bounds(m: int, least: int = LEAST) -> tuple[int, int]:
    """The sizes n that can reach 2 * min(n, m) / (n + m) >= least / 1000."""
    return -(-least * m // (2000 - least)), (2000 - least) * m // least


def fewest_words(grams: list[str], common: int) -> int:
    """How many of a template's words a part at least has that has `common` of its bigrams.

    A word that is missing takes along all bigrams with it, and a bigram has two words at most.
    """
    own: dict[str, int] = {}
    for g in grams:
        for w in set(g.split(" ")):
            own[w] = own.get(w, 0) + 1
    missing, lost = 0, 0
    for n in sorted(own.values()):
        lost += n
        if lost > 2 * (len(grams) - common):
            break
        missing += 1
    return len(own) - missing


def _pairs(w: Column) -> Column:
    """The bigrams of an array of words; of one word, that word."""
    return F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))).otherwise(w)


def _spaced(text: Column) -> Column:
    """The text in lower case (A-Z alone) with a space in place of every character that is in no word."""
    other = "".join(c for c in map(chr, range(128)) if re.fullmatch(f"[{NOT_WORD}]", c) and not "A" <= c <= "Z")
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + other, string.ascii_lowercase + " " * len(other))


def _compared(docs: DataFrame, key: str, text: str, templates: dict[str, str] | None, least: int) -> DataFrame:
    """`matches` with row, a number of the text's own, and a row of nulls for each text without a match."""
    return _parts(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), templates, least)


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: int = LEAST) -> DataFrame:
    """key, line, last, licence, common, size, template_size: every part similar enough to a template.

    Parts are the text's lines (line and last are the same), if it has several the whole text (0, 0), and
    spans of lines, from `line` to `last`, whose words fit the template's bounds. Spans begin and end with a
    line that has a word of the template: others add nothing. A span counts unless a matching part of the same licence that
    overlaps it is more alike, or as alike and a line, the whole text or earlier. Sizes count distinct bigrams. A part
    that matches has so many of the template's bigrams that its text has them too, and the words they are
    made of: texts are compared with a template only if they do. No shuffle; templates are part of the plan.
    """
    rows = _compared(docs, key, text, templates, least)
    return rows.where("licence IS NOT NULL").drop("row").withColumnRenamed("key", key)


def _parts(docs: DataFrame, templates: dict[str, str] | None, least: int) -> DataFrame:
    known = {k: bigrams(t) for k, t in sorted((templates or TEMPLATES).items())}
    low = {k: bounds(len(g), least)[0] for k, g in known.items()}
    vocabulary = {k: sorted({w for x in g for w in x.split(" ")}) for k, g in known.items()}
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    lines = F.transform(F.split(folded(F.col("text")), "\n"), lambda x: F.regexp_extract_all(x, F.lit(f"[^{NOT_WORD}]+"), F.lit(0)))
    every = strings(sorted({w for v in vocabulary.values() for w in v}))

    def by_words(v: Column) -> Column:
        """The templates whose words a text has enough of, from those words of it that any template has."""
        enough = lambda k, w: (F.size(v) >= fewest_words(known[k], low[k])) & (F.size(F.array_intersect(v, strings(w))) >= fewest_words(known[k], low[k]))
        return F.array_compact(F.array(*[F.when(enough(k, w), F.lit(k)) for k, w in vocabulary.items()]))

    # Most texts end here: without their lines, by the same words, from a split at one character in place of a regular expression.
    met_words = let(F.array_intersect(F.split(_spaced(F.col("text")), " "), every), by_words)
    # A text without enough words has no lines from here on, and goes through the rest as a row of nulls.
    some = docs.select("key", "row", let(met_words, lambda m: F.when(F.size(m) > 0, F.struct(lines.alias("lines"), m.alias("met")))).alias("t")).select("key", "row", "t.lines", "t.met")

    def by_bigrams(g: Column) -> Column:
        one = [F.when(F.array_contains("met", k) & (F.size(F.array_intersect(g, strings(x))) >= low[k]), F.struct(F.lit(k).alias("licence"), strings(x).alias("template"))) for k, x in known.items()]
        return F.array_compact(F.array(*one))

    # A text of several words has no part's single word as a bigram: words are added to its bigrams.
    met = some.select("key", "row", "lines", F.inline_outer(let(let(F.flatten("lines"), lambda w: F.concat(_pairs(w), w)), by_bigrams)))

    share = lambda p: 2000 * p["common"] / (p["size"] + F.size("template"))

    def part(first: Column, last: Column, w: Column) -> Column:
        # Once each: _pairs asks for w at every word, and a part's words may have to be joined from lines.
        sized = lambda g: F.struct(first.cast("int").alias("line"), last.cast("int").alias("last"), F.size(F.array_intersect(g, F.col("template"))).alias("common"), F.size(g).alias("size"))
        return let(let(w, lambda v: F.array_distinct(_pairs(v))), sized)

    empty = F.array().cast("array<struct<line:int,last:int,common:int,size:int>>")
    alike = lambda parts: F.filter(parts, lambda p: 2000 * p["common"] >= least * (p["size"] + F.size("template")))
    own = F.split(F.array_join("template", " "), " ")
    a = F.col("lines")
    # Lines that a span can begin and end with, and the words of the text up to each line's end.
    ends = F.aggregate(a, F.array().cast("array<int>"), lambda n, w: F.concat(n, F.array(F.coalesce(F.try_element_at(n, F.lit(-1)), F.lit(0)) + F.size(w))))
    touched = lambda t: F.filter(F.transform(a, lambda w, i: F.when(F.arrays_overlap(w, t), i + 1)), lambda i: i.isNotNull())
    whole = F.when(F.size(a) > 1, F.array(part(F.lit(0), F.lit(0), F.flatten(a)))).otherwise(empty)
    met = met.select("key", "row", "licence", "template", "lines", ends.alias("ends"), let(own, touched).alias("touched"), alike(F.concat(whole, F.transform(a, lambda w, i: part(i + 1, i + 1, w)))).alias("single"))
    most = (2000 - least) * F.size("template") / least + 1

    def spans_from(i: Column, at: Column) -> Column:
        """Spans of two lines or more from line i, the at-th of those touched: each has a word of its own, so few can fit."""
        before = F.element_at("ends", i) - F.size(F.element_at("lines", i))
        later = F.slice(F.col("touched"), at + 2, F.ceil(most).cast("int"))
        return F.transform(F.filter(later, lambda j: F.element_at("ends", j) - before <= most), lambda j: part(i, j, F.flatten(F.slice(F.col("lines"), i, j - i + 1))))

    spans = F.flatten(F.transform("touched", lambda i, at: alike(spans_from(i, at))))
    met = met.select("key", "row", "licence", "template", "single", spans.alias("spans"))

    def best(p: Column) -> Column:
        over = lambda q: (q["line"] == 0) | ((q["line"] <= p["last"]) & (q["last"] >= p["line"]))
        first = lambda q: (q["line"] < p["line"]) | ((q["line"] == p["line"]) & (q["last"] < p["last"]))
        return ~F.exists("single", lambda q: over(q) & (share(q) >= share(p))) & ~F.exists("spans", lambda q: over(q) & ((share(q) > share(p)) | ((share(q) == share(p)) & first(q))))

    rows = met.select("key", "row", F.col("licence").alias("name"), F.size("template").alias("template_size"), F.inline_outer(F.concat("single", F.filter("spans", best))))
    ok = 2000 * F.col("common") >= least * (F.col("size") + F.col("template_size"))
    return rows.select("key", "row", "line", "last", F.when(ok, F.col("name")).alias("licence"), "common", "size", "template_size")


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: int = LEAST) -> DataFrame:
    """key, n_matches, licences (sorted, comma-joined), best and best_permille (its Dice coefficient, in thousandths, rounded down).

    Every row comes back with the matches of its own text, whether its key is null or repeated; without one, with 0, an
    empty string and nulls. Ties for the best go to the first name. Null and empty texts match nothing. One
    shuffle, of a small row per text and match.
    """
    found = _compared(docs, key, text, templates, least)
    there = F.col("licence").isNotNull()
    dice = F.floor(2000 * F.col("common") / (F.col("size") + F.col("template_size"))).cast("bigint")
    best = F.min(F.when(there, F.struct((-dice).alias("d"), "licence")))
    each = F.collect_set(F.when(there, F.struct("line", "last", "licence")))
    per = found.groupBy("row").agg(F.any_value("key").alias(key), F.size(each).cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), best.alias("b"))
    return per.select(key, "n_matches", "licences", F.col("b.licence").alias("best"), (-F.col("b.d")).alias("best_permille"))


def oracle(least: int = LEAST) -> str:
    """DuckDB SQL of `licences` over documents whose notices stand on one line or are the whole text: it has no spans of lines."""
    fold = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = f"regexp_extract_all({fold % 'part'}, '[^{NOT_WORD}]+')"
    known = ", ".join(f"('{name}', [{', '.join(repr(x) for x in bigrams(t))}])" for name, t in sorted(TEMPLATES.items()))
    return f"""
    WITH t(licence, g) AS (VALUES {known}),
    p AS (SELECT doc_id, i AS line, string_split(coalesce(text, ''), chr(10))[i] AS part FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)
          UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
    w AS (SELECT doc_id, line, {split} AS w FROM p),
    b AS (SELECT doc_id, line, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
    m AS (SELECT doc_id, line, licence, len(list_intersect(b.g, t.g)) AS common, len(b.g) AS size, len(t.g) AS template_size FROM b, t WHERE len(b.g) > 0 AND len(b.g) <= 2 * len(t.g)),
    f AS (SELECT doc_id, licence, CAST(floor(2000 * common / (size + template_size)) AS BIGINT) AS d FROM m WHERE 2000 * common >= {least} * (size + template_size)),
    a AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(d) AS d FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences,
           (SELECT min(licence) FROM f WHERE f.doc_id = documents.doc_id AND f.d = a.d) AS best, d AS best_permille
    FROM documents LEFT JOIN a USING (doc_id)"""
