"""Licence scans: cosine of notices to templates in a sparse TF-IDF space, and inheritance down the directories.

What is compared is every line with a licensing word, the same line with the lines before and after it (a wrapped notice),
the paragraph that a file begins with if it has such a word, the whole of a file that is named as licence files are, and
the passage that begins at a line with which whole licences begin. Each goes to the licence with the largest cosine, if
that is large enough and no other licence comes close: what could be either is neither. A file mostly made of notices, or named so,
licenses its directory; files without a notice of their own take the licence of the nearest directory above them that has
one. The texts are read once; all that follows works on what that pass has found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratadoc.llm.words import ascii_lower
from stratadoc.session import saved

#: Public licence notices by identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: How whole licences are headed.
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Short licences as a whole, from the sentence that they begin with.
CONDITIONS = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
PERMITTED = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
WHOLE = [
    ("BSD-2-Clause", f"{PERMITTED} {CONDITIONS} {DISCLAIMER}"),
    ("BSD-3-Clause", f"{PERMITTED} {CONDITIONS} {ENDORSEMENT} {DISCLAIMER}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]
#: Licences that an identifier line names, and what GNU licences' identifiers end in.
IDENTIFIED = "Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC0-1.0 ISC MIT MPL-2.0 Unlicense".split()
GNU = "AGPL-3.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0".split()
IDENTIFIER = "SPDX-License-Identifier: "
TEMPLATES += TITLES + WHOLE + [(name, f"{IDENTIFIER}{name}") for name in (*IDENTIFIED, *GNU)]
TEMPLATES += [(name, f"{IDENTIFIER}{name}-{end}") for name in GNU for end in ("only", "or-later")]
#: The words that make a line a notice, and the names of licence files.
CUES = r"licen[cs]e|copyright|redistribut|permission is hereby|permission to use|unencumbered|creative commons|spdx"
PASSAGE_CUES = r"redistribution and use in|permission is hereby granted|permission to use, copy|free and unencumbered"
LICENSE_FILES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

MIN_COSINE = 0.6
#: The least cosines of a passage and of an identifier line, how many lines a passage has, and how far the next licence
#: must be from the first.
PASSAGE_COSINE, IDENTIFIER_COSINE, PASSAGE_LINES, MARGIN = 0.8, 0.9, 30, 0.002
#: The part of a file's characters that notices make up when the file licenses its directory.
FILE_SHARE = 0.25


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


#: What a unit of comparison is, in the order of its size.
LINE, NEIGHBOURS, HEADER, FILE, PASSAGE = "line", "neighbours", "header", "file", "passage"


def _scanned(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """path, text_key, total_chars, held (template terms that the text has) and units, from one pass over the texts."""
    vocabulary = sorted({t for _, text in templates for t in re.findall("[a-z0-9]+", text.lower())})
    low = files.select("path", F.xxhash64("text").alias("text_key"), F.length("text").alias("total_chars"), ascii_lower(F.col("text")).alias("low"))
    listed = low.withColumn("lines", F.when(F.col("low").rlike(CUES), F.split("low", "\n", -1)))
    line = lambda i: F.get("lines", i)
    unit = lambda kind, i, text, own: F.struct(F.lit(kind).alias("kind"), i.alias("line_no"), F.length(own).alias("n_chars"), text.alias("text"))
    cued = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: line(i).rlike(CUES))
    near = lambda i: F.array_join(F.slice("lines", F.greatest(i, F.lit(1)), F.least(i + 2, F.size("lines")) - F.greatest(i - 1, F.lit(0))), " ")
    each = F.flatten(F.transform(cued, lambda i: F.array(unit(LINE, i, line(i), line(i)), unit(NEIGHBOURS, i, near(i), line(i)))))
    ahead = lambda i: F.array_join(F.slice("lines", i + 1, F.lit(PASSAGE_LINES)), " ")
    begins = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: line(i).rlike(PASSAGE_CUES))
    passages = F.transform(begins, lambda i: unit(PASSAGE, i, ahead(i), ahead(i)))
    header = F.substring_index("low", "\n\n", 1)
    of_header = F.when(header.rlike(CUES) & (header != F.col("low")), F.array(unit(HEADER, F.lit(0), header, header)))
    of_file = F.when(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILES), F.array(unit(FILE, F.lit(0), F.col("low"), F.col("low"))))
    none = F.expr("cast(array() as array<struct<kind: string, line_no: int, n_chars: int, text: string>>)")
    units = F.concat(F.coalesce(each, none), F.coalesce(passages, none), F.coalesce(of_header, none), F.coalesce(of_file, none))
    held = F.array_intersect(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, vocabulary)))
    return saved(listed.select("path", "text_key", "total_chars", F.coalesce(held, F.array().cast("array<string>")).alias("held"), units.alias("units")), "license-scan")


def _weights(scanned: DataFrame, template_terms: DataFrame) -> DataFrame:
    """template, license, term, weight (of a vector of length one), idf: a table as small as the templates.

    How many files hold a term is counted over all of them.
    """
    df = scanned.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = scanned.agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    raw = template_terms.join(df, "term", "left").crossJoin(F.broadcast(n)).withColumn("idf", idf).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("template")))
    return saved(raw.select("template", "license", "term", (F.col("raw") / norm).alias("weight"), "idf", (F.log(F.col("n") + 1) + 1).alias("unseen")), "template-weights")


UNIT = ["path", "text_key", "kind", "line_no", "n_chars", "total_chars"]


def notices(scanned: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """path, text_key, kind, line_no, n_chars (of the line, paragraph or file), total_chars (of the file), license, score for
    each unit with a licence."""
    weights = _weights(scanned, _templates(scanned.sparkSession, templates))
    # Rows equal in path and text are one file, so their units are taken once.
    units = scanned.select("path", "text_key", "total_chars", F.explode("units").alias("u")).select("path", "text_key", "u.kind", "u.line_no", "u.n_chars", "total_chars", "u.text").distinct()
    tf = units.select(*UNIT, F.explode(terms(F.col("text"))).alias("term")).groupBy(*UNIT, "term").agg(F.count("*").alias("tf"))
    # Both tables have a row for each term of a template at most, whatever the corpus.
    known = weights.groupBy("term").agg(F.first("idf").alias("idf"))
    unseen = weights.agg(F.max("unseen").alias("unseen"))
    weighed = tf.join(F.broadcast(known), "term", "left").crossJoin(F.broadcast(unseen)).withColumn("raw", F.col("tf") * F.coalesce("idf", "unseen"))
    # What follows a licence in a passage is no part of it: there only words that templates have count.
    counts = (F.col("kind") != PASSAGE) | F.col("idf").isNotNull()
    weighed = weighed.groupBy(*UNIT).agg(F.sqrt(F.sum(F.when(counts, F.col("raw") * F.col("raw")))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "raw"))).alias("known"))
    # A unit's terms that templates have are at most as many as the templates' terms.
    dots = weighed.select(*UNIT, "norm", F.explode("known").alias("k")).join(F.broadcast(weights.select("template", "license", F.col("term").alias("of"), "weight")), F.col("k.term") == F.col("of"))
    dots = dots.groupBy(*UNIT, "norm", "template", "license").agg(F.sum(F.col("k.raw") * F.col("weight")).alias("dot"))
    naming = [i for i, (_, text) in enumerate(templates) if text.startswith(IDENTIFIER)]
    least = F.when(F.col("template").isin(naming), F.lit(IDENTIFIER_COSINE)).when(F.col("kind") == PASSAGE, F.lit(PASSAGE_COSINE)).otherwise(F.lit(min_cosine))
    cosines = dots.withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    by_license = cosines.groupBy(*UNIT, "license").agg(F.max("score").alias("score"))
    # As many as there are licences at most.
    ranked = by_license.groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "license"))).alias("r"))
    clear = (F.size("r") == 1) | (F.get("r", 1)["order"] - F.get("r", 0)["order"] >= MARGIN - 1e-9)
    return ranked.filter(clear).select(*UNIT, F.get("r", 0)["license"].alias("license"), (-F.get("r", 0)["order"]).alias("score"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """path, license, origin (own, inherited or none), score, n_notices, licensed_dir for each path of files (path, text).

    Of a file's notices a whole licence counts first, then the one with the largest score (then the first licence by name), so of a directory's
    licence files. n_notices is the number of its lines with a licensing word that, alone or with their neighbours, come
    out as a licence. Null and empty texts have no notice; rows without a path are no file and get a row without a licence. Rows of one
    path are one file: its notices are those of all its rows (rows equal in text count once), and it licenses its
    directory if one of its texts does. An empty table gives an empty result. Other columns are not looked at.
    """
    scanned = _scanned(files.select("path", "text"), templates)
    found = saved(notices(scanned, templates, min_cosine), "notices")
    # A whole licence says more than the lines in it.
    place = F.when(F.col("kind") == PASSAGE, 0).otherwise(1).alias("place")
    best = F.min(F.struct(place, (-F.col("score")).alias("order"), "license"))
    line = found.filter(F.col("kind").isin(LINE, NEIGHBOURS)).select("path", "text_key", "line_no", "n_chars").distinct()
    by_line = line.groupBy("path", "text_key").agg(F.count("*").alias("lines"), F.sum("n_chars").alias("chars"))
    whole = F.max(F.when(~F.col("kind").isin(LINE, NEIGHBOURS), F.col("n_chars")))
    of_text = found.groupBy("path", "text_key").agg(best.alias("own"), whole.alias("whole"), F.max("total_chars").alias("total_chars"))
    of_text = of_text.alias("t").join(by_line.alias("l"), (F.col("t.path") == F.col("l.path")) & (F.col("t.text_key") == F.col("l.text_key")), "left")
    share = F.greatest(F.coalesce("chars", F.lit(0)), F.coalesce("whole", F.lit(0))) / F.col("total_chars")
    own = of_text.groupBy("t.path").agg(F.min("own").alias("own"), F.sum(F.coalesce("lines", F.lit(0))).alias("n_notices"), F.max(share).alias("share"))
    is_file = (F.col("share") >= file_share) | F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILES)
    licensed = own.filter(is_file & F.col("path").isNotNull()).groupBy(_parent(F.col("path")).alias("licensed_dir")).agg(F.min("own").alias("dir_own"))

    paths = scanned.select("path").distinct().withColumn("dir", _parent(F.col("path")))
    # Nearest licensed ancestor, once for each directory that holds files.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = paths.select("dir").distinct().filter("dir is not null").withColumn("ancestor", F.explode(F.array_distinct(above)))
    nearest = dirs.join(licensed, F.col("ancestor") == F.col("licensed_dir")).groupBy("dir").agg(
        F.max(F.struct(F.length("licensed_dir").alias("depth"), "licensed_dir", "dir_own")).alias("near")
    )
    joined = paths.join(own, "path", "left").join(nearest, "dir", "left")
    has_own, inherits = F.col("own").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "path", F.coalesce("own.license", "near.dir_own.license").alias("license"),
        F.when(has_own, "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        (-F.coalesce("own.order", "near.dir_own.order")).alias("score"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.when(~has_own, F.col("near.licensed_dir")).alias("licensed_dir"),
    )
