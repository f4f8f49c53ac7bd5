"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

DataFrame functions only. A unit that reaches the threshold with a template must hold one of the template's heaviest terms
(those without which the rest of its vector is too short), so files without any are left out exactly.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_join, stage

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
    "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: ",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ",
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. ",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 ",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU{} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. ",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU{} General Public License for more details. ",
    "You should have received a copy of the GNU{} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. ",
    "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
    "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. ", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. ",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)


def _gnu(kind: str, version: str) -> list[str]:
    parts = [x.format(kind, version) for x in _GNU]
    return [parts[0], "".join(parts)]


# Usual short notices, standard headers and licence texts, each whole and by its opening.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE[0], "".join(_APACHE)],
    "MIT": ["Released under the MIT License.", "MIT License", _MIT[0], _MIT[0] + _MIT[1], "MIT License " + "".join(_MIT)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_gnu("", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("", "2")],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu(" Lesser", "3")],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", *_gnu(" Affero", "3")],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_2 + _BSD_END],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD_2 + _BSD_NAME + _BSD_END],
    "ISC": ["Licensed under the ISC License.", _ISC[0], "".join(_ISC)],
    "MPL-2.0": [_MPL[0], "".join(_MPL)],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Unlicense": [_UNLICENSE[0], "".join(_UNLICENSE)],
    "Proprietary": ["All rights reserved."],
}
#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\.\w+)?$"
TERM = "[a-z0-9]+"
#: What differs from holder to holder, in lower case, and what stays of it.
HOLDER = [(r"copyright[^\n]*all rights reserved", "all rights reserved"), (r"copyright[^\na-z0-9]*(c[^\na-z0-9]*)?[0-9]{4}[^\n]*", "copyright")]
#: What a line begins with, but for spaces: where it changes, and at lines without terms, a block ends.
MARKER = r"^[ \t]*([^a-z0-9 \t]{0,2})"


def template_terms(templates: dict[str, list[str]]) -> list[tuple[int, str, dict[str, int]]]:
    """Number, licence and counts of terms of each template; each licence has one by its SPDX identifier too."""
    out = []
    for name in sorted(templates):
        spdx = [] if name == "Proprietary" else [f"SPDX-License-Identifier: {name}"]
        for text in [*templates[name], *spdx]:
            counts: dict[str, int] = {}
            for t in re.findall(TERM, text.lower()):
                counts[t] = counts.get(t, 0) + 1
            out.append((len(out), name, counts))
    return out


def _lower(text: str) -> F.Column:
    x = F.lower(F.coalesce(text, F.lit("")))
    for pattern, kept in HOLDER:
        x = F.regexp_replace(x, pattern, kept)
    return x


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files and, for each term of the templates, of files that hold it: a row a template term at most."""
    found = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), 0), F.array(*map(F.lit, vocabulary)))
    # one row in a file for its own count, one for each term
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("term")).groupBy("term").count().collect()
    counts = {r["term"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def _heads(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which each vector's unit must hold one to reach the threshold."""
    heads: set[str] = set()
    for v in vectors:
        rest = total = sum(w * w for w in v.values())
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 * total * (1 - 1e-9):
                break
            heads.add(t)
            rest -= w * w
    return sorted(heads)


def match_units(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """path, doc_id, name, own_license, own_score of each file, staged: the best template of any of its units, or null.

    A unit is a line, a block of lines that begin alike (a paragraph or a run of comments), and for a licence file also
    its whole text; the whole text goes before the others, then the higher score, then the smaller licence. Weight of a
    term: count * idf, with idf ln((files + 1) / (files with it + 1)) + 1 over all files; terms in no template count as
    in no file. Holders and years of copyright lines are left out. The score is rounded to 6 digits.
    """
    spark, terms = files.sparkSession, template_terms(templates)
    n, counts = document_frequencies(files, sorted({t for _, _, c in terms for t in c}))
    idf = {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for _, _, c in terms for t in c}
    vectors = [{t: x * idf[t] for t, x in c.items()} for _, _, c in terms]
    needed = "(?<![a-z0-9])(?:" + "|".join(_heads(vectors, threshold)) + ")(?![a-z0-9])"
    # a row a template term: a few thousand, fixed by the templates
    flat = [(i, name, t, w / math.sqrt(sum(x * x for x in v.values()))) for (i, name, _), v in zip(terms, vectors, strict=True) for t, w in v.items()]
    def fixed(rows: list[tuple], schema: str) -> DataFrame:
        names = [x.split(":")[0] for x in schema.split(",")]
        text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
        return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>"))))

    vector, weight = fixed(flat, "template:int,license:string,term:string,share:double"), fixed(list(idf.items()), "term:string,weight:double")

    hit = F.lower(F.coalesce("text", F.lit(""))).rlike(needed)
    rows = files.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "name", F.when(hit, _lower("text")).alias("text"))
    rows = stage(rows, "files")
    lines = rows.where("text is not null").select("row", "name", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.withColumn("mark", F.when(F.col("text").rlike(TERM), F.regexp_extract("text", MARKER, 1)))
    before = F.lag("mark").over(Window.partitionBy("row").orderBy("line"))
    lines = lines.withColumn("new", (~F.col("mark").eqNullSafe(before)).cast("int"))
    lines = lines.withColumn("block", F.sum("new").over(Window.partitionBy("row").orderBy("line"))).where("mark is not null")
    head = F.col("text").rlike(needed)
    lines = lines.withColumn("head", head).withColumn("some", F.max(head.cast("int")).over(Window.partitionBy("row", "block")) > 0)
    # kind 0: the whole text; 1: blocks, numbered from the end; 2: lines
    unit = lambda kind, no: F.struct(F.lit(kind).alias("kind"), no.cast("int").alias("no"))
    units = F.array_compact(F.array(F.when(F.col("head"), unit(2, F.col("line"))), F.when(F.col("some"), unit(1, F.col("block"))), F.when(F.col("name").rlike(LICENSE_FILE), unit(0, F.lit(0)))))
    each = lines.select("row", F.explode(units).alias("unit"), "text").select("row", "unit.kind", "unit.no", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    key = ["row", "kind", "no"]
    tf = each.groupBy(*key, "term").agg(F.count("*").alias("tf")).join(weight, "term", "left")
    value = F.col("tf") * F.coalesce("weight", F.lit(math.log(n + 1) + 1))
    norms = tf.groupBy(*key).agg(F.sqrt(F.sum(value * value)).alias("norm"))
    dots = tf.join(vector, "term").groupBy(*key, "template", "license").agg(F.sum(value * F.col("share")).alias("dot"))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct(F.least("kind", F.lit(1)).alias("kind"), (-F.col("score")).alias("score"), "license")).alias("top"))
    found = rows.drop("text").join(best, "row", "left")
    return stage(found.select("doc_id", "path", "name", F.col("top.license").alias("own_license"), (-F.col("top.score")).alias("own_score")), "licenses")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, path, license, score, basis of each file of (doc_id, path of its directory, name, text).

    basis is own, inherited (the nearest directory, its own first, that holds a licence file with a licence; of several
    there the highest score, then the smaller licence) or none. Null paths are the root, of path ''; null names are no
    licence files; rows are independent otherwise, so repeated rows stay; other columns are ignored.
    """
    prepared = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "name", "text")
    own = match_units(prepared, templates, threshold)
    held = own.where(F.col("own_license").isNotNull() & F.col("name").rlike(LICENSE_FILE))
    held = held.groupBy(F.col("path").alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("held"))
    # distinct directories, each with its ancestors: a hot directory is one row here
    parts = F.split("path", "/")
    depths = F.when(F.col("path") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    dirs = prepared.groupBy("path").agg(F.lit(1).alias("__one")).select("path", F.explode(depths).alias("depth"))
    dirs = dirs.withColumn("dir", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("depth"), F.lit(1))), "/")))
    nearest = dirs.join(held, "dir").groupBy("path").agg(F.max_by("held", "depth").alias("near"))
    joined = split_join(own, nearest, "path", how="left")
    basis = F.when(F.col("own_license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("own_license", "near.l").alias("license"), F.coalesce("own_score", -F.col("near.s")).alias("score"), basis.alias("basis"))


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: source/language/thousands of the id is the directory; a document that begins with a notice
    (its first line names a licence or reserves rights) is that directory's licence file."""
    first = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    name = F.when(first.rlike("licen[sc]e|all rights reserved"), "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string")).alias("path"), name.alias("name"), "text")


def oracle() -> str:
    """The same over the documents table, in DuckDB."""
    rows = ", ".join(f"({i}, '{name}', '{t}', {c})" for i, name, counts in template_terms(TEMPLATES) for t, c in counts.items())
    lowered = "lower(coalesce(text, ''))"
    for pattern, kept in HOLDER:
        lowered = f"regexp_replace({lowered}, '{pattern}', '{kept}', 'g')"
    return f"""
WITH tt(template, license, term, tf) AS (VALUES {rows}),
files AS (SELECT row_number() OVER () AS rid, doc_id, concat_ws('/', source, lang, CAST(doc_id // 1000 AS VARCHAR)) AS path,
  regexp_matches(lower(split_part(coalesce(text, ''), chr(10), 1)), 'licen[sc]e|all rights reserved') AS is_license, coalesce(text, '') AS text FROM documents),
df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT rid, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files) WHERE term IN (SELECT term FROM tt) GROUP BY term),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT DISTINCT tt.term, ln((total.n + 1) / (coalesce(df.n, 0) + 1.0)) + 1 AS w FROM tt CROSS JOIN total LEFT JOIN df USING (term)),
tv AS (SELECT template, license, term, tf * w AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY template),
split AS (SELECT rid, is_license, string_split({lowered}, chr(10)) AS ls FROM files),
lines AS (SELECT rid, is_license, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
marked AS (SELECT *, CASE WHEN regexp_matches(line, '{TERM}') THEN regexp_extract(line, '{MARKER}', 1) END AS mark FROM lines),
changes AS (SELECT *, CAST(mark IS DISTINCT FROM lag(mark) OVER (PARTITION BY rid ORDER BY pos) AS INTEGER) AS new FROM marked),
blocks AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS block FROM changes),
units AS (SELECT rid, 2 AS kind, pos AS no, line FROM blocks WHERE mark IS NOT NULL
  UNION ALL SELECT rid, 1, block, line FROM blocks WHERE mark IS NOT NULL UNION ALL SELECT rid, 0, 0, line FROM blocks WHERE mark IS NOT NULL AND is_license),
lt AS (SELECT rid, kind, no, term, count(*) AS tf FROM (SELECT rid, kind, no, unnest(regexp_extract_all(line, '{TERM}')) AS term FROM units) GROUP BY ALL),
lv AS (SELECT rid, kind, no, lt.term, tf * coalesce(idf.w, (SELECT ln(n + 1) + 1 FROM total)) AS w FROM lt LEFT JOIN idf USING (term)),
ln AS (SELECT rid, kind, no, sqrt(sum(w * w)) AS norm FROM lv GROUP BY rid, kind, no),
cos AS (SELECT lv.rid, lv.kind, lv.no, tv.license, round(sum(lv.w * tv.w) / any_value(ln.norm) / any_value(tn.norm), 6) AS score
  FROM lv JOIN tv ON lv.term = tv.term JOIN ln ON ln.rid = lv.rid AND ln.kind = lv.kind AND ln.no = lv.no JOIN tn ON tn.template = tv.template GROUP BY lv.rid, lv.kind, lv.no, tv.template, tv.license),
own AS (SELECT rid, license, score FROM cos WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY least(kind, 1), score DESC, license) = 1),
held AS (SELECT path AS dir, license, score FROM own JOIN files USING (rid) WHERE is_license QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
near AS (SELECT d.path, held.license, held.score FROM (SELECT DISTINCT path FROM files) d JOIN held ON d.path = held.dir OR held.dir = '' OR starts_with(d.path, held.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.path ORDER BY length(held.dir) DESC) = 1)
SELECT doc_id, files.path AS path, coalesce(own.license, near.license) AS license, coalesce(own.score, near.score) AS score,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis
FROM files LEFT JOIN own USING (rid) LEFT JOIN near ON near.path = files.path"""
