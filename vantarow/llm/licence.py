"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance along directories.

Lines, sentences over several lines, comment blocks and whole licence files that speak of licensing are notices;
equal ones are scored once. Their term vectors meet the templates' in a join on terms. Files named as licences give theirs to all files below their
directory that have none of their own, the nearest ancestor first, by joins on path prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import keep

#: Licence and wording of a notice.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Proprietary and confidential, no redistribution without written permission of the copyright holder."),
)
#: What a notice holds at least one of, in lower case.
CUES = ("licens", "licenc", "spdx", "permission", "redistribut", "public domain", "rights reserved", "except in compliance", "proprietary")
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: What parts paragraphs: line ends with neither letter nor digit between them (empty lines, or those of a comment).
_GAP = r"\n[^\p{L}\p{N}]*\n"
#: What a line end inside a paragraph takes with it: white space before, comment leaders behind.
_WRAP = r"\s*\n[^\p{L}\p{N}]*"
_SENTENCE = r"(?<=[.!?])\s+"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.][0-9]+)*"), F.lit(0))


def _cued(text: Column, cues=CUES) -> Column:
    low, out = F.lower(text), None
    for cue in cues:
        out = low.contains(cue) if out is None else out | low.contains(cue)
    return out


def _bags(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys, term and tf of each row's notice, counted in runs of the sorted terms, so that nothing is shuffled."""
    terms = rows.select(*keys, F.array_sort(_terms(F.col("notice"))).alias("terms")).where(F.size("terms") > 0)
    ids = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    runs = terms.select(*keys, "terms", ids.alias("first"))
    run = F.transform("first", lambda at, j: F.struct(F.get("terms", at).alias("term"), (F.coalesce(F.get("first", j + 1), F.size("terms")) - at).alias("tf")))
    return runs.select(*keys, F.inline(run))


def _idf(n: int) -> Column:
    """Of a term in ``df`` of n notices; terms that no notice has get the largest."""
    return F.log(F.lit(1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0


def notices(documents: DataFrame, least: float = 0.6) -> DataFrame:
    """Best licence of every document that has a notice: doc_id, licence, similarity, n_notices (whole texts are searched).

    ``documents``: doc_id, text, whole (true: the text as a whole is a notice too). Notices are the different ones among the
    sentences of each line, the sentences of each paragraph, whose lines are joined, and paragraphs of several sentences.
    """
    spark = documents.sparkSession
    # a cue of several words can be parted by a line end, its last word can't
    maybe = documents.where(_cued(F.col("text"), [c.split(" ")[-1] for c in CUES]))
    joined = F.transform(F.split("text", _GAP), lambda p: F.regexp_replace(p, _WRAP, " "))
    paragraphs = F.filter(joined, lambda p: _cued(p, CUES))
    lines = F.filter(F.split("text", r"\n+"), lambda line: _cued(line, CUES))
    parts = F.concat(
        F.flatten(F.transform(lines, lambda line: F.split(line, _SENTENCE))), F.flatten(F.transform(paragraphs, lambda p: F.split(p, _SENTENCE))),
        F.filter(paragraphs, lambda p: p.rlike(_SENTENCE)), F.when(F.col("whole"), F.array(F.array_join(joined, " "))).otherwise(F.array()),
    )
    some = F.array_distinct(F.filter(F.transform(parts, lambda x: F.rtrim(F.regexp_replace(x, r"^[^\p{L}\p{N}]+", ""), F.lit(" \t\r\n"))), lambda x: _cued(x, CUES)))
    found = maybe.select("doc_id", F.explode(some).alias("notice"))
    # a notice can be a whole long text: from here on its hash stands for it
    found = keep(found.select("doc_id", F.xxhash64("notice").alias("kind"), "notice"), "notices")
    kinds = keep(found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("notice").alias("notice")), "kinds")
    n = int(kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    df = _bags(kinds, "n").groupBy("term").agg(F.sum("n").alias("df"))
    templates = _bags(spark.createDataFrame([(i, licence, text) for i, (licence, text) in enumerate(TEMPLATES)], "template int, licence string, notice string"), "template", "licence")
    weighed = templates.join(df, "term", "left").withColumn("idf", _idf(n)).withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # the templates' vectors are a table of fixed size, written once
    known = F.broadcast(keep(weighed.join(norm, "template").select("template", "licence", "term", (F.col("idf") * F.col("w") / F.col("norm")).alias("v")), "templates"))
    # products need the templates' terms only, lengths need all: a notice's terms are in one task, so one sum of each is sent
    dots = _bags(kinds, "kind").join(known, "term").groupBy("kind", "template", "licence").agg(F.sum(F.col("tf") * F.col("v")).alias("dot"))
    lengths = _bags(kinds, "kind").join(df, "term").withColumn("w", F.col("tf") * _idf(n)).groupBy("kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    scores = dots.join(lengths, "kind").select("kind", "template", "licence", (F.col("dot") / F.col("length")).alias("similarity"))
    best = scores.groupBy("kind").agg(F.max(F.struct(F.round("similarity", 9).alias("similarity"), (-F.col("template")).alias("order"), "licence")).alias("b"))
    best = keep(best.where(F.col("b.similarity") >= least).select("kind", F.col("b.licence").alias("licence"), F.col("b.similarity").alias("similarity"), F.col("b.order").alias("order")), "best")
    return (
        found.select("doc_id", "kind").join(best, "kind").groupBy("doc_id")
        .agg(F.max(F.struct("similarity", "order", "licence")).alias("b"), F.count(F.lit(1)).alias("n_notices"))
        .select("doc_id", F.col("b.licence").alias("licence"), F.col("b.similarity").alias("similarity"), "n_notices")
    )


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_licences(documents: DataFrame, path: Column, least: float = 0.6) -> DataFrame:
    """Own and effective licence of every document.

    ``documents``: doc_id (long, one text for each) and text; ``path``: expression for the slash-separated path of the file
    (null: the root). Other columns are ignored, whatever their names. Null and empty texts have no notice;
    rows with a null doc_id are ignored; a notice may run over lines, behind any comment leaders; of several notices the most similar counts, of equal ones the first
    template; of several licence files in one folder too, then the first path. An empty table gives an empty
    result. Returns doc_id, path, licence, similarity, n_notices, effective (own, else inherited), inherited_from.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(path.cast("string"), F.lit("")).alias("path")).where("doc_id is not null")
    own = keep(notices(rows.withColumn("whole", F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES)), least), "own")
    files = rows.select("doc_id", "path", _folder(F.col("path")).alias("folder"))
    files = files.join(own, "doc_id", "left")
    given = keep(
        files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES) & F.col("licence").isNotNull())
        .groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "licence")).alias("g"))
        .select(F.col("folder").alias("ancestor"), F.col("g.licence").alias("theirs"), F.col("g.path").alias("inherited_from")),
        "given",
    )
    result = ["doc_id", "path", "licence", "similarity", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices")]
    if given.isEmpty():
        return files.select(*result, F.col("licence").alias("effective"), F.lit(None).cast("string").alias("inherited_from"))
    # one row per folder and ancestor, never per file and ancestor
    parts = F.split("folder", "/")
    above = files.select("folder").distinct().select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor")).distinct()
    nearest = above.join(given, "ancestor").groupBy("folder").agg(F.max_by(F.struct("theirs", "inherited_from"), F.length("ancestor")).alias("g"))
    joined = files.join(nearest, "folder", "left")
    return joined.select(*result, F.coalesce("licence", F.col("g.theirs")).alias("effective"), F.when(F.col("licence").isNull(), F.col("g.inherited_from")).alias("inherited_from"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Licence of every document of ``documents``; see :func:`scan_licences`.

    The table has no paths: documents are filed as source/language/doc_id.txt, those of fewer than 400 characters
    that speak of licensing as licence files (LICENSE-doc_id) of the same folder.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id").cast("string")
    mostly = (F.length("text") < 400) & _cued(F.col("text"))
    return scan_licences(documents, F.concat_ws("/", "source", "lang", F.when(mostly, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))))
