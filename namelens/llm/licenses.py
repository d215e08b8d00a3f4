"""Operator 4: licence notices found by the Dice coefficient over word bigrams, in DataFrame expressions only.

Texts are normalised (lower case, runs of other characters than letters and
digits become one space), so a notice may be wrapped, indented or amid other
sentences. A passage is a run of words of the whole text whose bigrams, counted
with repeats, number between a * d / (2 - d) and a * (2 - d) / d for a template
of a bigrams: beyond these sizes no Dice coefficient reaches d. It is
2 * common / (a + b) over the sets of word bigrams. The best passages start and
end with a bigram of the template, so only these are compared.

Templates are pruned before that: a passage that matches holds at least
a / (2 - d) * d of the template's bigrams, so the text must hold as many of
them, and at least one of the words that so many bigrams can't do without.

Matching passages that overlap are one notice, named by its best passage.

Defined results: null and empty texts match nothing; each notice counts, also
where a text repeats it; ties go to the licence that comes first in code point
order; texts of one word have no bigram; rows are judged on their own, so null,
shared and repeated ids change nothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import numbered

#: Customary short notices, headers and short texts of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions:""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.""",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
LEAST_DICE = 0.85


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def plain_words(text: str) -> list[str]:
    """The normalised words of a template; templates are ASCII."""
    return re.findall(r"[a-z0-9]+", text.lower())


def bounds(n: int, least: float) -> tuple[int, int, int]:
    """Fewest and most bigrams of a passage that reaches the coefficient with a template of n, and how many both have at least."""
    low, high = math.ceil(round(n * least / (2 - least), 9)), math.floor(round(n * (2 - least) / least, 9))
    return low, high, math.ceil(round(least * (n + low) / 2, 9))


def needed_words(rows: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which a matching text has one: longest first, until no template can match without them."""
    sets = []
    for _, t in rows:
        w = plain_words(t)
        grams = set(zip(w, w[1:], strict=False))
        if grams:
            sets.append((grams, bounds(len(grams), least)[2]))
    chosen: set[str] = set()
    for grams, need in sets:
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w not in chosen, -len(w), w)):
            if sum(chosen.isdisjoint(g) for g in grams) < need:
                break
            chosen.add(word)
    return sorted(chosen)


def _template_column(rows: list[tuple[str, str]], least: float) -> Column | None:
    """All templates as an array of (licence, grams, size, low, high, need), the grams as hashes."""
    out = []
    for licence, text in rows:
        w = plain_words(text)
        grams = sorted(set(zip(w, w[1:], strict=False)))
        if grams:
            low, high, need = bounds(len(grams), least)
            hashes = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in grams])
            out.append(F.struct(F.lit(licence).alias("licence"), hashes.alias("grams"), *[F.lit(v).alias(n) for n, v in (("size", len(grams)), ("low", low), ("high", high), ("need", need))]))
    return F.array(*out) if out else None


def _barrier(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns made once: the optimizer would otherwise put their expressions into every use, each element's too."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


_NOTICE = "struct<start:int,end:int,dice:double,licence:string>"


def _joined(found: Column) -> Column:
    """Overlapping passages, sorted by start, as one each: its bounds, and the dice and licence of the best."""

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        better = (x["dice"] > cur["dice"]) | ((x["dice"] == cur["dice"]) & (x["licence"] < cur["licence"]))
        best = lambda n: F.when(better, x[n]).otherwise(cur[n]).alias(n)
        one = F.struct(cur["start"].alias("start"), F.greatest(cur["end"], x["end"]).alias("end"), best("dice"), best("licence"))
        new = F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), x.alias("cur"))
        return F.when(cur.isNull(), F.struct(acc["done"].alias("done"), x.alias("cur"))).when(x["start"] <= cur["end"], F.struct(acc["done"].alias("done"), one.alias("cur"))).otherwise(new)

    start = F.struct(F.array().cast(f"array<{_NOTICE}>").alias("done"), F.lit(None).cast(_NOTICE).alias("cur"))
    return F.aggregate(found, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def notices(docs: DataFrame, *, text_col: str = "text", rows: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """docs with its columns named c0, c1 ..., and `notices`: start and end (bigram places), dice and licence of each, in order."""
    rows = TEMPLATES if rows is None else rows
    d, at = numbered(docs)
    known = _template_column(rows, least)
    if known is None:
        return d.withColumn("notices", F.array().cast(f"array<{_NOTICE}>"))
    d = _barrier(d, w=F.split(normalised(F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))), " "))
    gate = F.arrays_overlap("w", F.array(*map(F.lit, needed_words(rows, least))))
    pairs = F.slice(F.zip_with("w", F.slice("w", 2, 1 << 30), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.size("w") - 1)
    d = _barrier(d, g=F.when(gate, pairs).otherwise(F.array().cast("array<long>"))).drop("w")
    every = F.array_distinct(F.flatten(F.transform(known, lambda t: t["grams"])))
    d = _barrier(d, hits=F.array_intersect("g", every))
    d = _barrier(d, ts=F.when(F.size("hits") > 0, F.filter(known, lambda t: F.size(F.array_intersect(t["grams"], F.col("hits"))) >= t["need"])))
    placed = F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    d = _barrier(d, p=F.when(F.size("ts") > 0, F.filter(placed, lambda s: F.array_contains(F.col("hits"), s["x"]))))
    # for each template, the places of its bigrams
    places = lambda t: F.transform(F.filter("p", lambda s: F.array_contains(t["grams"], s["x"])), lambda s: s["i"])
    d = _barrier(d, cands=F.when(F.size("p") > 0, F.transform("ts", lambda t: F.struct(*[t[n].alias(n) for n in ("licence", "grams", "size", "low", "high", "need")], places(t).alias("at")))))

    def passages(t: Column) -> Column:
        """Those from place a to a later place e of the template's bigrams, of a size and with as many hits as a match needs."""
        within = lambda a: lambda e, j: (e - a + 1 >= t["low"]) & (e - a + 1 <= t["high"]) & (j + 1 >= t["need"])
        grams = lambda a, e: F.slice(F.col("g"), a + 1, e - a + 1)
        dice = lambda a, e: 2.0 * F.size(F.array_intersect(grams(a, e), t["grams"])) / (F.size(F.array_distinct(grams(a, e))) + t["size"])
        scored = lambda a: lambda e: F.struct(a.alias("start"), e.alias("end"), dice(a, e).alias("dice"), t["licence"].alias("licence"))
        of = lambda a, k: F.filter(F.transform(F.filter(F.slice(t["at"], k + 1, t["high"]), within(a)), scored(a)), lambda x: x["dice"] >= least)
        return F.flatten(F.transform(t["at"], of))

    d = _barrier(d.drop("ts", "p", "hits"), found=F.when(F.size("cands") > 0, F.array_sort(F.flatten(F.transform("cands", passages)))))
    none = F.array().cast(f"array<{_NOTICE}>")
    return d.select(*at.values(), F.when(F.size("found") > 0, _joined(F.col("found"))).otherwise(none).alias("notices"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """A row for each document: its best licence (null: none), dice, the number of notices and all licences found."""
    d = notices(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **params)
    d = _barrier(d, n=F.col("notices"), best=F.array_min(F.transform("notices", lambda x: F.struct((-x["dice"]).alias("d"), x["licence"].alias("licence")))))
    return d.select(
        F.col("c0").alias("doc_id"), F.col("best.licence").alias("licence"), F.round(-F.col("best.d"), 6).alias("dice"),
        F.size("n").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("n", lambda x: x["licence"]))), ",").alias("licences"),
    )
