"""License scan (DataFrame functions only; no shuffle of texts).

Texts and templates are cut into words of letters and digits, lower-cased, and
into shingles of five words.  Overlapping windows of ``2 * BLOCK`` shingles, one
every ``BLOCK``, get one minimum per band; templates are cut into segments of
``BLOCK`` shingles with the same bands, and a common band value retrieves the
template.  A segment that a window contains whole has Jaccard similarity one
half or more with it, so ``BANDS`` bands of one row miss it with probability
2 ** -BANDS at most, and a template of several segments has as many chances
again.  Templates below ``BLOCK`` shingles use windows of one shingle, whose
signature is the shingle itself: at a containment of 0.8 they can't be missed.

Before that, texts that can't match are left out: those without any word of a set
that every template needs for its containment (:func:`telling_words`).

A retrieved template matches if at least ``THRESHOLD`` of its shingles stand in
the text (exact containment).  Sibling licenses share most of their wording, so
with ``best`` a match is dropped if another template matches better (by
containment, then by shared shingles) and covers all shingles of this match; a
text with both notices keeps both.  Only matches are shuffled for that.
Templates are a parameter: a list of bounded size that the plan holds as
literals.

Defined cases: a null text, or one of fewer than five words, has no match; a
template of fewer than five words is refused; a license repeated in a text is
one row; rows that repeat each other give a row each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BLOCK = 8
BANDS = 16
THRESHOLD = 0.8
#: Bounds on the templates, which are held as literals.
MAX_TEMPLATES, MAX_TEMPLATE_SHINGLES = 500, 20_000

# Notices that licenses ask for, in their published wording.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Library General Public License as published by the Free Software Foundation; either version 2 of "
                 "the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                 "the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                 "the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                        "International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International "
                     "License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
                        "International License."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all "
                "copyright and related or neighboring rights to this work."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License v1.0 which accompanies this distribution, and is available at "
                "http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    # Whole license texts.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
            "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
            "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                     "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                     "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
                     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
                     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
                     "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
                     "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission. "
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                     "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
                     "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
                     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
                     "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
                     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
                     "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
                     "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
            "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
            "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
             "this software for any purpose, including commercial applications, and to alter it and redistribute it "
             "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
             "you must not claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
             "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
             "3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))
    # let() binds the array of word hashes, so that it is made once.
    bound = F.transform(F.array(hashed), lambda h: F.when(F.size(h) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)),
        lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(SHINGLE))))).otherwise(
        F.array().cast("array<bigint>")))
    return F.coalesce(bound[0], F.array().cast("array<bigint>"))


def _ordered(band: int):
    """Maps hashes to the values whose order is the band's: XOR by a constant."""
    value = ((band + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    constant = value - (1 << 64) if value >= 1 << 63 else value
    return lambda h: h.bitwiseXOR(F.lit(constant))


def _band_key(band: int):
    return lambda smallest: F.xxhash64(F.lit(band), smallest)


def band_minima(column: str, band: int, size: Column) -> Column:
    """Minimum of each block of ``BLOCK`` shingles under the band's order."""
    return F.transform(
        F.sequence(F.lit(0), F.ceil(size / BLOCK).cast("int") - 1),
        lambda b: F.array_min(F.transform(F.slice(column, b * BLOCK + 1, BLOCK), _ordered(band))))


def window_keys(column: str, size: Column) -> Column:
    """Band keys of all windows: a window is a block and the one after it, so
    its minimum is the smaller one of two block minima."""
    bands = []
    for band in range(BANDS):
        minima = F.transform(F.array(band_minima(column, band, size)), lambda m: F.zip_with(
            m, F.concat(F.slice(m, 2, F.size(m)), F.slice(m, -1, 1)), lambda a, b: F.least(a, b)))[0]
        bands.append(F.transform(minima, _band_key(band)))
    return F.flatten(F.array(*bands))


def telling_words(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which a text must have one to match any of the templates (as lists of
    words).

    If the shingles of a template that hold none of some words are too few for the
    threshold, a matching text shares a shingle with one of these words.  Words that
    many templates have come first, longer ones before shorter ones."""
    held = Counter(w for words in templates for w in set(words))
    chosen: set[str] = set()
    for words in templates:
        whole = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        order = sorted(set(words), key=lambda w: (len(w) < 6, w not in chosen, -held[w], -len(w), w))
        rest, needed = whole, threshold * len(whole)
        for w in order:
            if len(rest) < needed:
                break
            rest = {s for s in rest if w not in s}
            chosen.add(w)
    return sorted(chosen)


class Templates:
    """Shingles and retrieval keys of the templates, computed by Spark with the
    expressions that the texts go through."""

    def __init__(self, spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        frame = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(templates)], "id int, text string")
        # Blocks from the beginning, and one that ends with the template.
        keyed = frame.select("id", F.array_distinct(shingles(F.col("text"))).alias("s")).withColumn("n", F.size("s"))
        segments = keyed.withColumn("segment", F.explode(F.when(F.col("n") >= BLOCK, F.transform(
            F.sequence(F.lit(0), F.expr(f"n div {BLOCK}") - 1),
            lambda b: F.slice("s", (b * BLOCK + 1).cast("int"), BLOCK))).otherwise(F.array(F.col("s")))))
        tails = keyed.filter(F.col("n") > BLOCK).withColumn("segment", F.slice("s", -BLOCK, BLOCK))
        segments = segments.unionByName(tails)
        minima = [_band_key(band)(F.array_min(F.transform("segment", _ordered(band)))) for band in range(BANDS)]
        rows = segments.select("id", "s", "n", F.array(*minima).alias("keys")).collect()
        self.licenses = [name for name, _ in templates]
        self.telling = telling_words([r["w"] for r in frame.select(words_of(F.col("text")).alias("w")).collect()], threshold)
        self.shingles = {r["id"]: r["s"] for r in rows}
        if any(not s for s in self.shingles.values()):
            raise ValueError(f"a template needs {SHINGLE} words")
        if sum(map(len, self.shingles.values())) > MAX_TEMPLATE_SHINGLES:
            raise ValueError(f"more than {MAX_TEMPLATE_SHINGLES} template shingles")
        self.by_band: dict[int, set[int]] = {}
        self.by_shingle: dict[int, set[int]] = {}
        for r in rows:
            if r["n"] < BLOCK:
                for s in r["s"]:
                    self.by_shingle.setdefault(s, set()).add(r["id"])
            else:
                for k in r["keys"]:
                    self.by_band.setdefault(k, set()).add(r["id"])


def _longs(values) -> Column:
    values = sorted(values)
    return F.array(*map(F.lit, values)).cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _owners(keys: Column, owners: dict[int, set[int]]) -> Column:
    """Templates that own one of the keys."""
    if not owners:
        return F.array().cast("array<int>")
    table = F.create_map(*(x for k, ids in sorted(owners.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(ids))))))
    return F.flatten(F.transform(F.array_intersect(keys, _longs(owners)), lambda k: table[k]))


def _best(matched: DataFrame) -> DataFrame:
    """Drops a match whose shared shingles a better match of its row covers."""
    rows = matched.groupBy("row").agg(F.collect_list(F.struct(*(c for c in matched.columns if c != "row"))).alias("m"))

    def beaten(x):
        return F.exists("m", lambda y: (
            (F.struct(y["containment"], y["shared"]) > F.struct(x["containment"], x["shared"]))
            & (F.size(F.array_except(x["both"], y["both"])) == 0)))
    return rows.select(F.inline(F.filter("m", lambda x: ~beaten(x))))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, best: bool = False) -> DataFrame:
    """``doc_id, license, template, containment, shared, template_shingles,
    first_shingle`` per text and matching template, with ``best`` without the
    matches that a better one explains."""
    table = Templates(docs.sparkSession, templates, threshold)
    # A text without any of the telling words can't reach the threshold.
    low = F.lower("text")
    docs = docs.filter(reduce(or_, (low.contains(w) for w in table.telling)))
    # Exploding an array of one element computes the shingles once for all uses;
    # a plain column would be copied into each of them by the optimiser.
    row = [F.monotonically_increasing_id().alias("row")] if best else []
    cut = docs.select("doc_id", *row, F.explode(F.array(shingles(F.col("text")))).alias("s"))
    row = ["row"] if best else []
    found = F.array_distinct(F.concat(_owners(F.col("s"), table.by_shingle),
                                      _owners(window_keys("s", F.size("s")), table.by_band)))
    found = F.when(F.size("s") > 0, found)
    retrieved = cut.select("doc_id", *row, "s", F.explode_outer(found).alias("hit")).filter("hit IS NOT NULL")
    spans = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(table.licenses[i]).alias("license"),
                               _longs(s).alias("ts")) for i, s in sorted(table.shingles.items())))
    hits = retrieved.withColumn("t", spans[F.col("hit")])
    matched = hits.select("doc_id", *row, "s", F.col("t.license").alias("license"), F.col("t.template").alias("template"),
                          F.array_intersect("t.ts", "s").alias("both"), F.size("t.ts").alias("template_shingles"))
    shared = F.size("both")
    first = F.array_min(F.transform("both", lambda h: F.array_position("s", h)))
    found = matched.filter(shared >= F.lit(threshold) * F.col("template_shingles")).select(
        "doc_id", *row, "license", "template", (shared / F.col("template_shingles")).alias("containment"),
        shared.alias("shared"), "template_shingles", (first - 1).cast("int").alias("first_shingle"),
        *(["both"] if best else []))
    return _best(found).drop("both") if best else found
