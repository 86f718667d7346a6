"""Licence scans, in DataFrame functions only.

Spans of a file are compared with licence templates by the cosine of sparse TF-IDF
vectors; the best one above a threshold is the file's own licence.  Spans are every
line, every run of words as long as a template that begins with one of its words (so that a notice is found that is
wrapped, stands inside a line or carries a holder's name; of a template of at most
``SHORT`` words all must be there) and, for full licence texts, the whole of a file.
What shares too few words with a template to reach the threshold (the cosine is at
most the root of the squared weights of the shared words) is not compared.  Document frequencies of the
template words are counted over all files, so what is common in the corpus
weighs little; words of no template weigh as much as one that no file has.
A file with hardly any other text is a licence file: it governs its directory and,
where nothing nearer does, all below.  Files without a licence of their own
inherit from the nearest directory above that has one.

The scan is a projection: no text is shuffled.  Inheritance joins distinct
directories, exploded to their ancestors, with the governed ones, and only then
files with directories.

Defined results: null and empty texts have no own licence and may inherit; a
null or empty path has the root as its directory; of several licence files in
one directory the one with the best score counts, ties by the licence's name; equal scores of
templates go to the first name; repeated rows and null ids are judged row by row; very long texts are
judged whole; an empty table gives an empty result; extra input columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import let, save

#: Names and notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: More notices and titles, for runs of words.
NOTICES = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD 3-Clause License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU General Public License Version 3, 29 June 2007", "GNU General Public License, version 3"],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "MIT License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
}
#: Full licence texts, for whole files.
FULL = {
    "MIT": 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause": 'BSD 3-Clause License Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
}
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a licence; other words of a licence file at most.
THRESHOLD, OTHER_WORDS = 0.6, 20
#: Words of a template that has to be there with all of them, at most.
SHORT = 5


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def weights(files: DataFrame, text_col: str, templates: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of template terms over all files, and that of an unseen term."""
    every = sorted({t for x in templates for t in re.findall(TERM, x.lower())})
    there = F.array_intersect(terms_of(F.coalesce(F.col(text_col), F.lit(""))), F.array(*map(F.lit, every)))
    # One pass: the empty term, which every file has, counts the files.
    seen = files.select(F.explode(F.array_append(there, F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    df = {r["term"]: r["n"] for r in seen.collect()}  # a row for each template term
    n = df.get("", 0)
    return {t: math.log((n + 2) / (df.get(t, 0) + 1)) for t in every}, math.log(n + 2)


def vector(template: str, idf: dict[str, float]) -> dict[str, float]:
    words = re.findall(TERM, template.lower())
    v = {t: words.count(t) * idf[t] for t in set(words)}
    size = math.sqrt(sum(w * w for w in v.values()))
    return {t: w / size for t, w in sorted(v.items())} if size else {}


def telling(vectors: list[dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a span needs one: with a template's other terms alone no cosine reaches the threshold."""
    found = set()
    for v in vectors:
        rest = sum(w * w for w in v.values())
        for t in sorted(v, key=lambda t: (-idf[t], t)):
            if rest < threshold**2 - 1e-6:
                break
            found.add(t)
            rest -= v[t] ** 2
    return sorted(found)


def own_licence(text: Column, idf: dict[str, float], unseen: float, lines: dict[str, str], runs: list[tuple[str, str]], whole: list[tuple[str, str]], threshold: float) -> Column:
    """struct(score, rank, name, words) of the best span, null if none reaches the threshold; words: of the longest span with that name."""
    rank = {name: -i for i, name in enumerate(sorted({*lines, *(n for n, _ in runs), *(n for n, _ in whole)}))}
    known = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
    times = lambda words, t: F.size(F.filter(words, lambda w: w == t))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def norm(words: Column) -> Column:
        return F.sqrt(total(F.transform(F.array_distinct(words), lambda w: F.pow(times(words, w) * F.coalesce(F.try_element_at(known, w), F.lit(unseen)), F.lit(2)))))

    def looked_up(words: Column, values: dict[str, float]) -> Column:
        table = F.create_map(*[F.lit(x) for t, w in values.items() for x in (t, w)])
        return total(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0))))

    def judged(words: Column, size: Column, name: str, v: dict[str, float]) -> Column:
        score = F.round(looked_up(words, {t: w * idf[t] for t, w in v.items()}) / size, 9)
        return F.struct(score.alias("score"), F.lit(rank[name]).alias("rank"), F.lit(name).alias("name"), F.size(words).alias("words"))

    terms = lambda v: F.array(*map(F.lit, v))
    none = F.filter(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit("").alias("name"), F.lit(0).alias("words"))), lambda s: F.lit(False))
    can = lambda words, v: looked_up(F.array_intersect(words, terms(v)), {t: w * w for t, w in v.items()}) >= threshold**2 - 1e-6

    def in_runs(words: Column, name: str, x: str) -> Column:
        v, n = vector(x, idf), len(re.findall(TERM, x.lower()))
        if not v:
            return none
        last = F.greatest(F.size(words) - n, F.lit(0))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.array_contains(terms(v), F.get(words, i)))
        spans = F.transform(F.array_distinct(F.transform(starts, lambda i: F.least(i, last))), lambda i: F.slice(words, i + 1, F.lit(n)))
        fits = lambda s: (F.size(F.array_intersect(s, terms(v))) == len(v)) if n <= SHORT else can(s, v)
        found = F.transform(F.filter(spans, fits), lambda s: judged(s, norm(s), name, v))
        return F.when(can(words, v), found).otherwise(none)

    def in_whole(words: Column, name: str, x: str) -> Column:
        v, n = vector(x, idf), len(re.findall(TERM, x.lower()))
        return F.when((F.size(words) <= 2 * n) & can(words, v), F.array(judged(words, norm(words), name, v))).otherwise(none) if v else none

    vectors = {name: v for name, x in sorted(lines.items()) if (v := vector(x, idf))}
    tells = telling(list(vectors.values()), idf, threshold)
    pattern = rf"(?<![A-Za-z0-9])(?i:{'|'.join(map(re.escape, tells))})(?![A-Za-z0-9])" if tells else r"\b\B"
    told = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    in_line = lambda words: let(norm(words), lambda size: F.array_max(F.array(*(judged(words, size, name, v) for name, v in vectors.items()))))
    by_line = F.transform(told, lambda x: let(terms_of(x), in_line)) if vectors else none
    long = [in_runs, in_whole]
    need = telling([v for _, x in [*runs, *whole] if (v := vector(x, idf))], idf, threshold)

    def by_words(words: Column) -> Column:
        found = F.concat(*[long[k](words, *one) for k, group in enumerate((runs, whole)) for one in group])
        return F.when(F.arrays_overlap(words, F.array(*map(F.lit, need))), found).otherwise(none)

    spans = F.concat(by_line, let(terms_of(text), by_words)) if need else by_line

    def best(s: Column) -> Column:
        top = F.array_max(s)
        of = F.filter(s, lambda x: x["name"] == top["name"])
        return F.when(F.size(s) > 0, F.struct(top["score"].alias("score"), top["rank"].alias("rank"), top["name"].alias("name"), F.array_max(F.transform(of, lambda x: x["words"])).alias("words")))

    return let(F.filter(spans, lambda s: s["score"] >= threshold), best)


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty text."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, with their depths."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above"), n.alias("depth")))


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, path, licence, how (file, header, inherited, none), score (its own line's, else null), from_dir."""
    more, full = ({}, {}) if templates is not None else (NOTICES, FULL)
    templates = TEMPLATES if templates is None else templates
    runs = [*templates.items(), *((name, x) for name, group in more.items() for x in group)]
    idf, unseen = weights(files, text_col, [x for _, x in [*runs, *full.items()]])
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = own_licence(text, idf, unseen, templates, runs, list(full.items()), threshold)
    judged = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), text.alias("text"), own.alias("own"))
    parts = F.array_join(F.filter(F.split(parent(F.col("path")), "/"), lambda x: x != ""), "/")
    other = F.when(F.col("own").isNotNull(), F.size(terms_of(F.col("text"))) - F.col("own.words"))
    judged = save(judged.select("doc_id", "path", parts.alias("dir"), "own", (other <= OTHER_WORDS).alias("is_file")), "judged")

    best = F.max(F.struct("own.score", "own.rank", F.col("own.name").alias("name")))
    governed = judged.where("is_file").groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("above"), F.col("b.name").alias("licence"))
    asked = judged.where("own is null").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.above", "a.depth")
    nearest = asked.join(governed, "above").groupBy("dir").agg(F.max(F.struct("depth", "licence", "above")).alias("n"))
    nearest = save(nearest.select("dir", F.col("n.licence").alias("got"), F.col("n.above").alias("from_dir")), "nearest")
    out = judged.join(nearest, "dir", "left")
    how = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("got").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own.name", "got").alias("licence"), how.alias("how"), F.col("own.score").alias("score"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
