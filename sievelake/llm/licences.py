"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

Method: texts are normalised to lower-case ASCII words, and passages are
compared to licence templates: twice the shared distinct word bigrams over the
sum of both counts. A passage of a bigrams can reach the coefficient t with a
template of b only if t / (2 - t) * b <= a <= (2 - t) / t * b, and it must
share t / (2 - t) * b; passages and templates outside these bounds are never
compared. Passages are

* the lines of the text, and
* for each template, windows of as many words as it has, which may begin
  anywhere, in the middle of a line or of a sentence: those that begin with the
  template's first bigram, and those at the start of each stretch in which
  enough of its bigrams lie within reach, up to their last such bigram.

So notices wrapped over lines, notices inside other prose and whole licences
are found. Of passages that overlap, the one that shares most bigrams with its
template counts, then the one of the higher coefficient, then the template
first by name, then the passage that begins first. Everything happens within
the row: no shuffle; templates are hashed bigrams in the plan. The work grows
with the number of words and passages, whatever one text has of them.

Results: null and empty texts, and texts without two words in a row, have no
licence, coefficient 0 and no matches. Equal coefficients go to the template
first by name. Repeated passages count each time, repeated rows get equal
results. Columns of the result's names are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

MIN_DICE = 0.8
#: Files of whole licences, named by licence.
TEXTS = Path(__file__).with_name("licence_texts")

# Licence notices and short licences in their public wording.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
]
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES += [(name, f"{text} {DISCLAIMER}") for name, text in TEMPLATES if name.startswith("BSD") and text.startswith("Redistribution")]


def whole_licences(folder: Path = TEXTS) -> list[tuple[str, str]]:
    """(name, text) of the files of a folder on the driver."""
    return [(f.stem, f.read_text(encoding="utf-8", errors="replace")) for f in sorted(folder.glob("*.txt"))]


WORD = "[a-z0-9]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def hashed(words: list[str]) -> list[int]:
    """The hash of each word bigram, in order: Spark's xxhash64 of the two words."""
    first = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    both = [xxhash.xxh64_intdigest(b.encode(), seed=a) for a, b in zip(first, words[1:])]
    return [h - (1 << 64) if h >> 63 else h for h in both]


class Template:
    def __init__(self, name: str, text: str) -> None:
        self.name, self.words = name, words_of(text)
        bigrams = hashed(self.words)
        self.first, self.bigrams = bigrams[:1], sorted(set(bigrams))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def _bigrams(words: Column) -> Column:
    """The hash of each bigram, in order."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _with(value: Column, then) -> Column:
    """then(value), with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


PASSAGE = "struct<c:int,dice:double,order:int,start:int,end:int>"


def _among(bigrams: list[int]) -> str:
    """SQL that tests whether h is one of them; as text, since there are thousands."""
    return f"h in ({', '.join(f'{b}L' for b in bigrams)})".replace("-9223372036854775808L", "cast(-9223372036854775808 as bigint)")


def _passage(c: Column, a: Column, n: int, order: int, start: Column, end: Column) -> Column:
    """A passage: shared bigrams, coefficient, place of the template, negated as less is better, and its words."""
    return F.struct(c.alias("c"), (2.0 * c / (a + n)).alias("dice"), F.lit(-order).alias("order"), start.cast("int").alias("start"), end.cast("int").alias("end"))


#: Passages that are looked over together for places where none goes on.
CHUNK = 256


def _free_of_overlaps(passages: Column) -> Column:
    """The passages, sorted by start, that count: best first, those that overlap none that counts before.

    They are cut into stretches at each passage that begins after all before it
    have ended, chunk by chunk, so the work grows with the number of passages
    and not with its square; only passages of one stretch can overlap.
    """
    none = F.array().cast(f"array<{PASSAGE}>")
    overlaps = lambda p, q: (q["start"] <= p["end"]) & (q["end"] >= p["start"])

    def best(stretch: Column) -> Column:
        order = F.transform(stretch, lambda p: F.struct(-p["c"], -p["dice"], -p["order"], p["start"], p["end"], p.alias("p")))
        ranked = F.transform(F.array_sort(order), lambda x: x["p"])
        return F.aggregate(ranked, none, lambda kept, p: F.when(F.exists(kept, lambda q: overlaps(p, q)), kept).otherwise(F.concat(kept, F.array(p))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(passages) - 1) / CHUNK).cast("int")), lambda k: F.slice(passages, k * CHUNK + 1, CHUNK))
    ends = lambda chunks: F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda p: p["end"])))
    before = lambda chunks: F.aggregate(ends(chunks), F.array(F.lit(-1)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))

    def heads(chunk: Column, end: Column) -> Column:
        """Whether each passage of a chunk begins after all before it."""
        state = F.struct(end.alias("end"), F.array().cast("array<boolean>").alias("out"))
        return F.aggregate(chunk, state, lambda a, p: F.struct(F.greatest(a["end"], p["end"]).alias("end"), F.concat(a["out"], F.array(p["start"] > a["end"])).alias("out")), lambda a: a["out"])

    flags = _with(chunks, lambda cs: _with(before(cs), lambda ends: F.flatten(F.transform(cs, lambda c, k: heads(c, F.get(ends, k))))))
    at = F.filter(F.transform(flags, lambda h, j: F.when(h, j)), lambda j: j.isNotNull())
    part = lambda at: F.transform(at, lambda j, x: F.slice(passages, j + 1, F.coalesce(F.get(at, x + 1), F.size(passages)) - j))
    return F.flatten(F.transform(_with(at, part), lambda s: F.when(F.size(s) > 1, best(s)).otherwise(s)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, min_dice: float = MIN_DICE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with licence (of the best passage; null: none reaches min_dice), licence_dice, licences (all found, sorted) and n_passages (how many reach it)."""
    known = sorted((t for t in (Template(n, x) for n, x in (TEMPLATES + whole_licences() if templates is None else templates)) if t.bigrams), key=lambda t: (t.name, t.bigrams))
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    new = ["licence", "licence_dice", "licences", "n_passages"]
    text_of = unused(docs, "_text")
    out = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in new], F.col(text).alias(text_of))
    kept = [F.col(f"`{c}`") for c in out.columns[:-1]]
    if not known:
        return out.select(*kept, F.lit(None).cast("string").alias("licence"), F.lit(0.0).alias("licence_dice"), F.array().cast("array<string>").alias("licences"), F.lit(0).alias("n_passages"))
    col = {c: unused(docs, f"_{c}") for c in ("lines", "words", "of", "bigrams", "hits", "found")}
    every = _among(sorted({h for t in known for h in t.bigrams}))
    least, most = min(len(t.bigrams) for t in known), max(len(t.bigrams) for t in known)
    lines = F.transform(F.split(F.coalesce(F.col(text_of), F.lit("")), "\n"), _words)
    out = out.select(*kept, F.filter(lines, lambda w: F.size(w) > 0).alias(col["lines"]))
    place = F.flatten(F.transform(col["lines"], lambda w, i: F.array_repeat(i, F.size(w))))
    out = out.select(*kept, F.col(col["lines"]), F.flatten(col["lines"]).alias(col["words"]), place.alias(col["of"]))
    # distinct bigrams of a line are fewer than its words, and at most one fewer than its distinct words
    fits = lambda w: (F.size(w) > low * least) & (F.size(F.array_distinct(w)) <= high * most + 1)
    line = lambda w, i: F.when(fits(w), F.struct(i.alias("i"), F.size(w).alias("n"), F.array_distinct(_bigrams(w)).alias("b")))
    out = out.select(*kept, F.transform(col["lines"], line).alias(col["lines"]), F.col(col["of"]), _bigrams(F.col(col["words"])).alias(col["bigrams"]))
    hits = F.expr(f"filter(transform({col['bigrams']}, (h, i) -> case when {every} then named_struct('i', i, 'h', h) end), x -> x is not null)")
    some = F.expr(f"filter({col['lines']}, x -> x is not null and exists(x.b, h -> {every}))")
    # the word with which each line begins: where the line's number first comes among those of the words
    begins = F.filter(F.transform(col["of"], lambda i, j: F.when((j == 0) | (F.get(col["of"], j - 1) != i), j)), lambda j: j.isNotNull())
    starts = _with(begins, lambda at: F.transform(some, lambda x: x.withField("start", F.get(at, x["i"]))))
    out = out.select(*kept, F.col(col["bigrams"]), hits.alias(col["hits"]), starts.alias(col["lines"]))
    every_bigram, hit = F.col(col["bigrams"]), F.col(col["hits"])

    def by_line(t: Template, k: int) -> Column:
        """The lines that reach the coefficient with a template."""
        n = len(t.bigrams)
        counted = F.expr(f"transform({col['lines']}, x -> case when size(x.b) between {low * n - 1e-9} and {high * n + 1e-9} then named_struct('c', size(filter(x.b, h -> {_among(t.bigrams)})), 'a', size(x.b), 'start', x.start, 'n', x.n) end)")
        good = F.filter(counted, lambda x: x.isNotNull() & (2.0 * x["c"] >= min_dice * (x["a"] + n)))
        return F.transform(good, lambda x: _passage(x["c"], x["a"], n, k, x["start"], x["start"] + x["n"] - 1))

    def windows(t: Template, k: int) -> Column:
        """The template's windows that reach the coefficient."""
        n, m = len(t.bigrams), len(t.words) - 1
        need = max(1, math.ceil(low * n - 1e-9))

        def among(own: Column) -> Column:
            near = lambda j: F.coalesce(F.get(own, j + need - 1)["i"] - F.get(own, j)["i"] < m, F.lit(False))
            begins = lambda x, j: near(j) & ((x["h"] == t.first[0]) | (j == 0) | ~near(j - 1))
            first = F.filter(F.transform(own, lambda x, j: F.when(begins(x, j), F.struct(x["i"].alias("i"), j.alias("j")))), lambda b: b.isNotNull())

            def scored(b: Column) -> Column:
                i = b["i"]
                # m words have at most m hits
                inside = F.filter(F.slice(own, b["j"] + 1, m), lambda x: x["i"] < i + m)
                shared = lambda own: F.size(F.array_distinct(F.transform(own, lambda x: x["h"])))
                last = lambda own: F.array_max(F.transform(own, lambda x: x["i"]))
                rated = lambda c, e: _passage(c, F.size(F.array_distinct(F.slice(every_bigram, i + 1, e - i + 1))), n, k, i, e + 1)
                return _with(inside, lambda own: F.when(shared(own) >= need, _with(last(own), lambda e: rated(shared(own), e))))

            return F.filter(F.transform(first, scored), lambda p: p.isNotNull() & (p["dice"] >= min_dice))

        own = F.expr(f"filter({col['hits']}, x -> {_among(t.bigrams).replace('h in', 'x.h in', 1)})")
        none = F.array().cast(f"array<{PASSAGE}>")
        return F.when(F.size(hit) >= need, _with(own, lambda o: F.when(F.size(o) >= need, among(o)).otherwise(none))).otherwise(none)

    found = F.flatten(F.array(*[c for k, t in enumerate(known) for c in (by_line(t, k), windows(t, k))]))
    place = F.transform(found, lambda p: F.struct(p["start"], p["end"], p.alias("p")))
    out = out.select(*kept, F.array_sort(place).alias(col["found"]))
    once = F.filter(F.transform(col["found"], lambda x, j: F.when((j == 0) | ~F.get(col["found"], j - 1).eqNullSafe(x), x["p"])), lambda p: p.isNotNull())
    out = out.select(*kept, once.alias(col["found"]))
    out = out.select(*kept, F.when(F.size(col["found"]) > 1, _free_of_overlaps(F.col(col["found"]))).otherwise(F.col(col["found"])).alias(col["found"]))
    name = lambda p: F.get(F.array(*[F.lit(t.name) for t in known]), -p["order"])
    best = F.array_max(F.transform(col["found"], lambda p: F.struct(p["dice"], p["order"])))
    return out.select(
        *kept,
        name(best).alias("licence"),
        F.coalesce(best["dice"], F.lit(0.0)).alias("licence_dice"),
        F.array_sort(F.array_distinct(F.transform(col["found"], name))).alias("licences"),
        F.size(col["found"]).alias("n_passages"),
    )
