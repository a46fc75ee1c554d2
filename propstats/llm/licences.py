"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

A text's units are the clauses of its lines, without comment marks. Runs of neighbouring units are candidate headers, so
notices wrapped over lines count as a whole, and the whole text is a candidate licence file. All become
sparse TF-IDF vectors over words; the best cosine to a template's vector decides. Document
frequencies are counted over all texts, for the words of the templates; a word that no template has
weighs as much as a word of one text in ``OTHER_ODDS``, so it pulls a cosine down.

Which runs are looked at follows from the limit: a cosine is at most the root of the share that the common words have of
a template's squared weight. A text whose words have too little of every template is done at once. Of each notice
the fewest heaviest words with more than a match can lack are its marks: every match holds one of some notice's, so only runs
with a mark are compared. A run of several units with more than ``LONGEST`` times the longest notice's words is no header.

A text whose whole is a licence (``FILE_COSINE``) licenses its directory if it is named like a licence file or has
``FILE_WORDS`` words: a short notice alone in a file speaks for that file only. A text without a header gets
the license of the nearest directory above it that has one: paths become ancestor rows, joined to the
licensed directories, and the longest match stays. Directories are resolved once each, then
texts join their own directory.

Defined cases: null and empty texts have no header but may inherit; a null path has no directory; ties
go to the template named first; repeated rows are judged alike; of several licence files in a directory
the one with the best cosine counts, then the template named first; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import stored

#: License names and the notices by which texts declare them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"),
}
#: Whole licence texts, as files hold them below a line with year and holder.
FILES: dict[str, tuple[str, ...]] = {
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "BSD-3-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
}
#: A run of units goes up to so many times the words of the longest template.
LONGEST = 1.5
#: What opens and closes a line of comment.
COMMENT = re.compile(r"^[\s#/*;!%<>|-]+|[\s#/*;!%<>|-]+$")
CLAUSE = re.compile(r"(?<=[.;:!?])\s+")
HEADER_COSINE, FILE_COSINE = 0.8, 0.8
FILE_WORDS = 20
FILE_NAME = re.compile(r"(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$", re.IGNORECASE)
OTHER_ODDS = 100
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def notices() -> list[tuple[str, str]]:
    """(license, text) of every notice; the first paragraph of a licence text is one, too."""
    return [(name, text) for name, texts in TEMPLATES.items() for text in texts] + [(name, text.split("\n")[0]) for name, texts in FILES.items() for text in texts]


def templates() -> list[tuple[str, str]]:
    """(license, text) of every notice, then of every licence text."""
    return notices() + [(name, text) for name, texts in FILES.items() for text in texts]


def names() -> list[str]:
    return list(dict.fromkeys(name for name, _ in templates()))


def _vocabulary() -> list[str]:
    return sorted({w for _, text in templates() for w in words_of(text)})


def units(text: str) -> list[tuple[int, list[str]]]:
    """(line, words) of each clause that has words."""
    found = []
    for i, line in enumerate(text.split("\n")):
        for clause in CLAUSE.split(COMMENT.sub("", line)):
            words = WORD.findall(clause.lower())
            if words:
                found.append((i, words))
    return found


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    wanted, seen, n = set(_vocabulary()), Counter(), 0
    for batch in batches:
        for text in batch["t"]:
            n += 1
            if text:
                seen.update(wanted.intersection(WORD.findall(text.lower())))
    seen[""] = n
    yield pd.DataFrame({"w": list(seen.keys()), "n": list(seen.values())})


class Matcher:
    """The templates' vectors under given document counts; the count of "" is that of all texts."""

    def __init__(self, counts: dict[str, int]):
        n = counts.get("", 0)
        self.idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1.0 for w in _vocabulary()}
        self.other = math.log(OTHER_ODDS) + 1.0
        self.number = {w: i for i, w in enumerate(self.idf)}
        self.names = [name for name, _ in templates()]
        vectors = [self._vector(words_of(text))[0] for _, text in templates()]
        self.matrix = np.stack([v / np.linalg.norm(v) for v in vectors])
        self.notices = len(notices())
        self.longest = LONGEST * max(sum(words_of(text).values()) for _, text in notices())
        # Of each notice the heaviest words, until the others together are too little for a match.
        self.marks = set()
        known = list(self.number)
        for row in self.matrix[: self.notices]:
            weights = np.sort(row)[::-1] ** 2
            needed = int(np.searchsorted(np.cumsum(weights), 1 - HEADER_COSINE**2, side="right")) + 1
            self.marks.update(known[i] for i in np.argsort(-row, kind="stable")[:needed])

    def may(self, words: Counter) -> tuple[bool, bool]:
        """Whether any run of a text of these words can match a notice, and whether the whole can match a template."""
        there = [i for i in map(self.number.get, words) if i is not None]
        reach = np.sqrt((self.matrix[:, there] ** 2).sum(axis=1)) + 1e-9
        return bool((reach[: self.notices] >= HEADER_COSINE).any()), bool((reach >= FILE_COSINE).any())

    def _vector(self, words: Counter) -> tuple[np.ndarray, float]:
        vector, others = np.zeros(len(self.number)), 0.0
        for w, n in words.items():
            i = self.number.get(w)
            if i is None:
                others += ((1 + math.log(n)) * self.other) ** 2
            else:
                vector[i] = (1 + math.log(n)) * self.idf[w]
        return vector, others

    def best(self, words: Counter, among: int | None = None) -> tuple[float, int]:
        """The best cosine and its template, of the first ``among``."""
        vector, others = self._vector(words)
        norm = math.sqrt(vector @ vector + others)
        cosines = self.matrix[:among] @ vector / norm if norm else np.zeros(1)
        i = int(np.argmax(cosines))
        return float(cosines[i]), i

    def header(self, found: list[tuple[int, list[str]]]) -> tuple[float, int, int | None]:
        """The best cosine of any run of units that holds a mark, its template and its first line; the first of equals."""
        cosine, template, line = 0.0, 0, None
        ahead = np.append(np.flatnonzero([any(w in self.marks for w in words) for _, words in found]), len(found)).astype(int)
        upto = np.concatenate([[0], np.cumsum([len(words) for _, words in found])]).astype(int)
        for start in range(len(found)):
            # Runs from here on that reach the next mark.
            mark = int(ahead[np.searchsorted(ahead, start)])
            if mark == len(found):
                break
            if mark > start and upto[mark + 1] - upto[start] > self.longest:
                continue
            counts = Counter(w for _, words in found[start : mark + 1] for w in words)
            for end in range(mark, len(found)):
                if end > mark:
                    if upto[end + 1] - upto[start] > self.longest:
                        break
                    counts.update(found[end][1])
                c, t = self.best(counts, self.notices)
                if c > cosine:
                    cosine, template, line = c, t, found[start][0]
        return cosine, template, line


def _judged(counts: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(counts)
        for batch in batches:
            rows = []
            for text, path in zip(batch["t"], batch["path"], strict=True):
                name, cosine, line_no, whole = None, 0.0, None, False
                words = words_of(text) if text else Counter()
                some, all_of_it = matcher.may(words)
                if some:
                    cosine, t, line_no = matcher.header(units(text))
                    name = matcher.names[t] if line_no is not None else None
                if all_of_it:
                    c, t = matcher.best(words)
                    whole = c >= FILE_COSINE and (bool(path and FILE_NAME.search(path)) or sum(words.values()) >= FILE_WORDS)
                    if c > cosine:
                        name, cosine, line_no = matcher.names[t], c, 0
                rows.append((name, cosine, line_no, whole))
            found = pd.DataFrame(rows, columns=["license", "cosine", "line", "whole"], dtype=object)
            yield pd.concat([batch[["k", "path"]].reset_index(drop=True), found], axis=1)

    return run


def _directory(path):
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", ""))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """Rows (key, license, evidence, cosine, line), one per file; evidence is file, header, inherited or null."""
    id_type = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key).alias("k"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("t"))
    # A row per template word, whatever the corpus.
    counts = rows.select("t").mapInPandas(_document_counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    judged = rows.mapInPandas(
        _judged({r.w: r.n for r in counts}), f"k {id_type}, path string, license string, cosine double, line int, whole boolean"
    )
    judged = stored(judged.withColumn("dir", _directory(F.col("path"))), "licences")
    order = names()
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("license"))
    licensed = judged.where("whole AND dir IS NOT NULL").groupBy("dir").agg(
        F.min_by("license", F.struct(-F.col("cosine"), rank)).alias("dir_license")
    )
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))
    above = judged.select("dir").where("dir IS NOT NULL").distinct().select(F.col("dir").alias("below"), F.explode(ancestors).alias("a"))
    nearest = above.join(licensed, F.col("a.dir") == F.col("dir")).groupBy("below").agg(F.max_by("dir_license", F.col("a.depth")).alias("inherited"))
    # Stored, so that the join reads two plain shuffles: a directory of many files can then be split over tasks.
    nearest = stored(nearest, "nearest")
    out = judged.join(nearest, judged["dir"] == nearest["below"], "left")
    own = F.col("license").isNotNull() & (F.col("cosine") >= HEADER_COSINE)
    evidence = F.when(F.col("whole"), "file").when(own, "header").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(
        F.col("k").alias(key),
        F.when(own | F.col("whole"), F.col("license")).otherwise(F.col("inherited")).alias("license"),
        evidence.alias("evidence"),
        F.when(own, F.col("cosine")).alias("cosine"),
        F.when(own, F.col("line")).alias("line"),
    )
