"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are the licences' own texts, standard notices, SPDX tags and one-sentence forms. A file is compared by its
units: each sentence or line, each paragraph and each block of comment lines (wrapped lines joined, comment signs taken
off), and the whole file; units have any size. Document frequencies of all words are counted over all files.

Two steps find the cosines. First, in one pass over the texts, a prefix filter looks for the rarest words of each
template (those it leaves out can't reach the threshold alone), and units that hold one get an upper bound of their
cosine, in which words outside the templates weigh the least a word can. Units whose bound is under the threshold can't
match. The few others go on with their words, whose frequencies are joined (salted, as a word can be in very many), and
get their exact cosine. A file's licence is its best match of at least `threshold`; ties go to the smaller name.

A file without a licence of its own takes that of the nearest directory above it that has a licence file with one.
Paths are joined by equality of directory and ancestor; directories are made distinct first, so that a directory with a
third of all files costs one row there.

Null text counts as empty; a null path has no directory. Several licence files in one directory: the best score, then
the smaller licence name and path. Repeated rows are answered each. Empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, stash, table

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, version: str, thing: str = "This program") -> str:
    return (
        f"{thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. {thing} is distributed in the hope that it will be useful, but "
        f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Public names of licences, their texts and notices, and sentences by which files declare them.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", " ".join((_BSD_OPEN, _BSD_1, _BSD_2, _BSD_AS_IS))),
    ("BSD-2-Clause", " ".join((_BSD_OPEN, _BSD_1, _BSD_2))),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", " ".join((_BSD_OPEN, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS))),
    ("BSD-3-Clause", " ".join((_BSD_OPEN, _BSD_1, _BSD_2, _BSD_3))),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _VERBATIM),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC + " " + _ISC_AS_IS),
    ("ISC", _ISC),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3", "This library")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT + " " + _AS_IS),
    ("MIT", _MIT),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("proprietary", "All rights reserved."),
) + tuple(
    (name, f"SPDX-License-Identifier: {name}{form}")
    for name in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0")
    for form in (("", "-only", "-or-later") if "GPL" in name else ("",))
)
LICENSE_FILES = r"(?i)^(licen[sc]e|copying|notice)([.-][^/]*)?$"
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
CUT = re.compile(r"\n|(?<=[.!?])\s+(?=[^\W\d_])")
COMMENT = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|;+|--+|<!--|%+|\"\"\"|''')[ \t]?")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in words(t)})


def units(text: str) -> list[str]:
    """Distinct pieces of a text that are compared."""
    out = dict.fromkeys(CUT.split(text))
    paragraph: list[str] = []
    block: list[str] = []

    def close(lines: list[str]) -> None:
        if len(lines) > 1:
            out[" ".join(lines)] = None
        lines.clear()

    for line in text.split("\n"):
        bare = COMMENT.sub("", line).strip()
        bare = bare.removesuffix("*/").removesuffix("-->").strip()
        out.setdefault(bare)
        if bare:
            paragraph.append(bare)
        else:
            close(paragraph)
        if COMMENT.match(line):
            block.append(bare)
        else:
            close(block)
    close(paragraph)
    close(block)
    out[" ".join(COMMENT.sub("", x).strip() for x in text.split("\n"))] = None
    return [u for u in out if u]


def idf(files: int, seen: int) -> float:
    return math.log((1 + files) / (1 + seen)) + 1


class Matcher:
    """Templates as vectors; finds the units of a text that can match."""

    def __init__(self, files: int, seen: dict[str, int], threshold: float):
        self.threshold = threshold
        self.idf = {w: idf(files, seen.get(w, 0)) for w in vocabulary()}
        self.vectors = [(name, {w: n * self.idf[w] for w, n in Counter(words(t)).items()}) for name, t in TEMPLATES]
        self.norms = [math.sqrt(sum(x * x for x in v.values())) for _, v in self.vectors]
        self.held: dict[str, list[tuple[int, float]]] = {w: [] for w in self.idf}  # by word: templates that have it
        for k, (_, v) in enumerate(self.vectors):
            for w, x in v.items():
                self.held[w].append((k, x))
        keep = set()
        for _, v in self.vectors:  # rarest words until those left are too short for the threshold
            rest = norm = sum(x * x for x in v.values())
            for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if rest < (threshold * 0.999) ** 2 * norm:
                    break
                keep.add(w)
                rest -= x * x
        self.prefix = frozenset(keep)

    def candidates(self, text: str) -> list[tuple[str, float, float, float, list[str], list[int]]]:
        """(licence, inner product, squared length inside the vocabulary, template's length, other words, their counts)."""
        if self.prefix.isdisjoint(words(text)):
            return []
        out, seen = [], set()
        for unit in units(text):
            tokens = words(unit)
            if self.prefix.isdisjoint(tokens):
                continue
            count = Counter(tokens)
            if (key := frozenset(count.items())) in seen:
                continue
            seen.add(key)
            v = {w: n * self.idf[w] for w, n in count.items() if w in self.idf}
            other = {w: n for w, n in count.items() if w not in self.idf}
            inside = sum(x * x for x in v.values())
            least = math.sqrt(inside + sum(n * n for n in other.values()))  # no word weighs less than 1
            dots = [0.0] * len(self.vectors)
            for w, x in v.items():
                for k, y in self.held[w]:
                    dots[k] += x * y
            for (name, _), norm, dot in zip(self.vectors, self.norms, dots):
                if dot >= 0.999 * self.threshold * least * norm:
                    out.append((name, dot, inside, norm, list(other), list(other.values())))
        return out


def document_frequencies(files: DataFrame, most: int = 400_000) -> DataFrame:
    """word, n: in how many files each word occurs; the empty word stands for the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out():
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            found[""] += b.num_rows
            for text in b.column("text").to_pylist():
                found.update(set(words(text or "")))
            if len(found) > most:
                yield out()
                found.clear()
        yield out()

    return files.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_CANDS = "array<struct<name string, dot double, inside double, norm double, words array<string>, counts array<long>>>"


def own_licenses(files: DataFrame, threshold: float = 0.7, salts: int = 16) -> DataFrame:
    """id, path, own, score of every row of (id, path, text)."""
    spark = files.sparkSession
    bounded_batches(spark)
    seen = stash(document_frequencies(files), "words")
    known = {r["word"]: r["n"] for r in seen.where(F.col("word").isin(["", *vocabulary()])).collect()}  # the templates' words
    total = known.pop("", 0)
    shared = spark.sparkContext.broadcast((total, known, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        kind = pa.list_(pa.struct([("name", pa.string()), ("dot", pa.float64()), ("inside", pa.float64()), ("norm", pa.float64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))
        names = ("name", "dot", "inside", "norm", "words", "counts")
        for b in batches:
            found = [[dict(zip(names, c)) for c in matcher.candidates(t or "")] for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("id"), b.column("path"), pa.array(found, kind)], names=["id", "path", "cands"])

    rows = files.select("id", "path", "text").mapInArrow(run, f"id long, path string, cands {_CANDS}")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.select("row", F.posexplode("cands").alias("k", "c")).select("row", "k", "c.*")
    asked = each.select("row", "k", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", "k", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    asked = asked.withColumn("salt", F.pmod(F.hash("row", "k"), F.lit(salts)))
    df = seen.join(asked.select("word").distinct(), "word", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    weight = F.col("c") * (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("n"))) + 1)
    outside = asked.join(df, ["word", "salt"]).groupBy("row", "k").agg(F.sum(weight * weight).alias("outside"))
    scored = each.drop("words", "counts").join(outside, ["row", "k"], "left")
    score = F.round(F.col("dot") / F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0))) / F.col("norm"), 6)
    best = scored.withColumn("score", score).where(F.col("score") >= threshold).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("best"))
    return rows.join(best, "row", "left").select("id", "path", F.col("best.name").alias("own"), F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("score"))


def scan(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, path, text) -> id, path, license, declared, score, from_dir: own or inherited licence of every row."""
    found = stash(own_licenses(files, threshold), "licences").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    name = F.regexp_extract("path", "[^/]*$", 0)
    best = F.min(F.struct((-F.col("score")).alias("s"), "own", "path"))
    declared = found.where(name.rlike(LICENSE_FILES) & F.col("own").isNotNull()).groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("from_dir"), F.col("best.own").alias("inherited"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = found.where("dir is not null").select("dir").distinct().withColumn("from_dir", F.explode(F.array_distinct(above)))
    nearest = dirs.join(declared, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "inherited"), F.length("from_dir")).alias("near"))
    return found.join(nearest, "dir", "left").select(
        "id",
        "path",
        F.coalesce("own", "near.inherited").alias("license"),
        F.col("own").isNotNull().alias("declared"),
        "score",
        F.when(F.col("own").isNull(), F.col("near.from_dir")).alias("from_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: a folder per source, thousand and fifty; the first of each fifty is its LICENSE file.

    documents have no paths, so these are made; a row without doc_id has none.
    """
    k = F.col("doc_id")
    name = F.when(k % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(k.cast("string"), F.lit(".txt")))
    folder = F.when(k % 1000 == 0, F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(k / 1000))).otherwise(
        F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(k / 1000), F.floor(k / 50))
    )
    return docs.select(k.alias("id"), F.when(k.isNotNull(), F.concat_ws("/", folder, name)).alias("path"), "text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_files(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
