"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Units are the lines of a document, the document as a whole, and runs of words that may cross lines: for each template, the
run of as many words as it has from each place where one of its bigrams stands, if enough of its bigrams follow. Text is lower-cased, everything but letters and digits
parts words, and a unit's bigrams are hashed and made distinct; a text of one word is its own bigram. With a and b
distinct bigrams Dice is at most 2 min(a, b) / (a + b), so a template is compared only to units within bounds that follow
from the threshold, and units that share no bigram with any template are passed over. Of runs that overlap, that of the
longest template is kept, then the most similar, the first template by name, the first place; a run within a line that
has a licence of its own is left out. Templates are literals of the plan;
every document is worked on in its own row, without a shuffle, a join or Python.

Defined results: null or empty text has no licence (nulls, similarity 0); the best unit is the one with the highest
similarity, then the first template by name, then the first line; a run has the number of the line where it begins; the
document as a whole is unit -1 and comes after lines of equal similarity; rows that repeat are scanned each; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.runtime import columns_for

THRESHOLD = 0.8

# Short notices by which works name their licence, and the texts of licences.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT (text)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause (full)": f"{_BSD} {_BSD_AS_IS}",
    "BSD-3-Clause (full)": f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}",
    "ISC (full)": _ISC,
    "MIT (full)": f"{_GRANT} {_AS_IS}",
}
#: Longer texts are files beside this module, read where the driver is.
TEMPLATES |= {f"{f.stem} (full)": f.read_text() for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^\w]|_", " ", text.lower()).split()


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _bigrams(words: Column) -> Column:
    """Distinct hashes of neighbouring words; of the word alone if there is one, which may be empty."""
    rest = F.slice(words, 2, F.size(words))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(rest), F.lit(0))), rest, lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def _pairs(words: Column) -> Column:
    """Hashes of neighbouring words, in their places."""
    rest = F.slice(words, 2, F.size(words))
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(rest), F.lit(0))), rest, lambda a, b: F.xxhash64(a, b))


def _template_hashes(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], int]]:
    """Distinct bigrams of the templates, hashed by Spark, and how many words they have; as many rows as templates."""
    assert len(templates) <= 1000, "templates are literals of the plan"
    rows = [F.struct(F.lit(name).alias("name"), _bigrams(_words(F.lit(text))).alias("grams"), F.size(_words(F.lit(text))).alias("words")) for name, text in sorted(templates.items())]
    found = spark.range(1).select(F.array(*rows).alias("all")).first()["all"]
    return [(x.name, list(x.grams), x.words) for x in found]


def _longs(grams: list[int]) -> str:
    """An array literal, as SQL: one call to the JVM, whatever its length."""
    return f"cast(split('{','.join(map(str, grams))}', ',') AS array<bigint>)"


def _one_of(x: str, grams: list[int]) -> str:
    return f"{x} IN ({', '.join(f'{g}L' for g in grams)})"


def _runs(df: DataFrame, known: list[tuple[str, list[int], int]], threshold: float) -> DataFrame:
    """df (pairs, sizes: words of each line) with runs: (line, licence, similarity, last line), none overlapping another."""
    every = sorted({g for _, grams, _ in known for g in grams})
    df = df.withColumn("anchors", F.expr(f"array_compact(transform(pairs, (g, i) -> CASE WHEN {_one_of('g', every)} THEN i END))"))
    known = [x for x in known if x[2] > 1]
    df = df.select("*", *[F.expr(f"filter(anchors, i -> {_one_of('pairs[i]', grams)})").alias(f"at{k}") for k, (_, grams, _) in enumerate(known)])
    found = []
    for k, (name, grams, words) in enumerate(known):
        # Dice >= t of a and b bigrams means shared >= t * b / (2 - t), so as many places lie within the run
        need = max(1, int(len(grams) * threshold / (2 - threshold) - 1e-9) + (len(grams) * threshold % (2 - threshold) > 1e-9))
        start = f"filter(transform(at{k}, (p, j) -> CASE WHEN get(at{k}, j + {need - 1}) - p < {words - 1} THEN p END), p -> p IS NOT NULL)"
        own = f"transform({start}, p -> named_struct('p', p, 'own', array_distinct(slice(pairs, p + 1, {words - 1}))))"
        dice = f"-2.0D * size(array_intersect(x.own, {_longs(grams)})) / (size(x.own) + {len(grams)})"
        name = name.replace("\\", "\\\\").replace("'", "\\'")
        found.append(f"transform({own}, x -> named_struct('short', {-words}, 'far', {dice}, 'licence', '{name}', 'at', x.p))")
    all_ = f"filter(array_sort(concat({', '.join(found)})), x -> x.far <= {-threshold}D)" if found else "array()"
    df = df.withColumn("cand", F.expr(all_)).drop("anchors", *[f"at{k}" for k in range(len(known))])
    apart = "NOT exists(acc, y -> x.at < y.at - y.short AND y.at < x.at - x.short)"
    df = df.withColumn("cand", F.expr(f"aggregate(cand, slice(cand, 1, 0), (acc, x) -> CASE WHEN {apart} THEN concat(acc, array(x)) ELSE acc END)"))
    line = "aggregate(sizes, named_struct('l', 0, 'n', 0), (s, c) -> named_struct('l', s.l + IF(s.n + c <= {}, 1, 0), 'n', s.n + c)).l"
    last = "least(x.at - x.short - 1, size(pairs))"
    return df.withColumn("runs", F.expr(f"transform(cand, x -> named_struct('line', {line.format('x.at')}, 'licence', x.licence, 'similarity', -x.far, 'last', {line.format(last)}))")).drop("cand")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col and found, an array of (line, licence, similarity), the best template of each unit."""
    known = _template_hashes(docs.sparkSession, templates or TEMPLATES)
    every = sorted({g for _, grams, _ in known for g in grams})
    low = min(len(g) for _, g, _ in known) * threshold / (2 - threshold)
    high = max(len(g) for _, g, _ in known) * (2 - threshold) / threshold
    df = docs.select(*columns_for(docs, id=id_col, text=text_col))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    df = df.withColumn("units", F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)).withColumn("n_lines", F.size(lines)).drop("text")
    df = df.withColumn("units", F.transform("units", _words))
    df = df.withColumn("pairs", _pairs(F.element_at("units", -1))).withColumn("sizes", F.transform(F.slice("units", 1, F.col("n_lines")), lambda w: F.when(w[0] == "", 0).otherwise(F.size(w))))
    df = df.withColumn("units", F.transform("units", _bigrams))
    numbered = F.transform("units", lambda u, i: F.struct(F.when(i < F.col("n_lines"), i).otherwise(-1).alias("line"), u.alias("grams")))
    df = df.withColumn("near", numbered).drop("units")
    df = df.withColumn("near", F.expr(f"filter(near, u -> size(u.grams) >= {low}D AND size(u.grams) <= {high}D AND exists(u.grams, g -> {_one_of('g', every)}))"))

    def similar(u: Column, name: str, grams: list[int]) -> Column:
        a, b = F.size(u["grams"]), len(grams)
        fits = (a >= b * threshold / (2 - threshold)) & (a <= b * (2 - threshold) / threshold)
        dice = F.size(F.array_intersect(u["grams"], F.expr(_longs(grams)))) * 2.0 / (a + b)
        return F.when(fits, F.struct((-dice).alias("far"), F.lit(name).alias("licence")))

    best = F.transform("near", lambda u: F.struct(u["line"].alias("line"), F.array_min(F.array(*[similar(u, name, grams) for name, grams, _ in known])).alias("best")))
    df = df.withColumn("found", F.filter(best, lambda x: x["best"]["far"] <= -threshold)).drop("near")
    df = df.withColumn("found", F.transform("found", lambda x: F.struct(x["line"].alias("line"), x["best"]["licence"].alias("licence"), (-x["best"]["far"]).alias("similarity"))))
    df = _runs(df, known, threshold)
    more = "transform(filter(runs, r -> NOT (r.line = r.last AND exists(found, f -> f.line = r.line))), r -> named_struct('line', r.line, 'licence', r.licence, 'similarity', r.similarity))"
    return df.select(F.col("id").alias(id_col), F.concat("found", F.expr(more)).alias("found"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.array_min(F.transform("found", lambda x: F.struct((-x["similarity"]).alias("far"), x["licence"].alias("licence"), (x["line"] == -1).alias("whole"), x["line"].alias("line"))))
    rows = rows.withColumn("best", first)
    return rows.select("doc_id", F.size("found").cast("long").alias("n_found"), F.col("best.licence").alias("licence"), F.col("best.line").alias("line"), F.coalesce(-F.col("best.far"), F.lit(0.0)).alias("similarity"))
