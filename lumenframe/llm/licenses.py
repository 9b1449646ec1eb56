"""License scans: TF-IDF cosine of licence lines, headers and whole texts to templates, inheritance from directories.

Every line of a whole text that holds a cue word is a licence line. Its terms ([a-z0-9]+ in lower case) are weighted by
frequency in the line times ln((1 + N) / (1 + df)) + 1, with N and df counted over all licence lines of the corpus and
the templates; its licence is the template's with the largest cosine, if that is at least THRESHOLD.

Blocks of a text with a cue word are compared as well, as whole vectors of all their lines and with weights of their
own, to full licence texts and standard headers: every paragraph with a cue word, every run of such paragraphs (a
comment and the code beside it are apart), and the whole text. A block's licence needs BLOCK_THRESHOLD.

A file's licence is that of its best line or block; ties go to the line. A licence file has the name of one (LICENSE,
COPYING, ...) or consists of licence lines, or of its best block where that won, by at least file_share of its words (a
majority, unless the caller says otherwise; the query says FILE_SHARE, as its SQL does): it also declares the licence of
its directory (that of most licence files; ties go to the name first in order). A file without a licence
of its own inherits that of the nearest directory above it that declares one.

DataFrame operations only. Files meet directories by way of the distinct directories, in salted joins, so neither a
directory nor an ancestor that holds most files is a hot key. The templates are a constant table; nothing else is
broadcast unless Spark finds it small.

Null texts have no licence of their own, but inherit. A null path is a file in no directory. Repeated rows are repeated
in the result. Columns other than id, path and text are left out.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.5
BLOCK_THRESHOLD = 0.6
FILE_SHARE = 0.05
MAJORITY = 0.5
FILE_NAMES = "(?i)^(.*[-_.])?(un)?(licen[sc]es?|copying)([-_.].*)?$"
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--)"
CUES = "licen[sc]|copyright|spdx|public domain|permission is hereby granted|redistribution and use"
#: Licences by SPDX identifier with sentences that declare them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Released under the simplified BSD License, 2-clause."],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD License, 3-clause."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.",
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.",
    "You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>.",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
#: Standard headers by SPDX identifier; a header of several paragraphs is a template as a whole and by its first one.
HEADERS = {
    "AGPL-3.0": [[x.format("program", "Affero ", "3") for x in _GNU]],
    "Apache-2.0": [_APACHE],
    "GPL-2.0": [[x.format("program", "", "2") for x in _GNU]],
    "GPL-3.0": [[x.format("program", "", "3") for x in _GNU]],
    "LGPL-2.1": [[x.format("library", "Lesser ", "2.1") for x in _GNU]],
    "LGPL-3.0": [[x.format("library", "Lesser ", "3") for x in _GNU]],
    "MPL-2.0": [["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]],
}
#: Full licence texts, a file for each SPDX identifier.
TEXTS = Path(__file__).parent / "license_texts"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(f"{name}#{i}", name, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template string, license string, line string")


def block_templates() -> list[tuple[str, str, str]]:
    """(template, license, line) of the full texts and standard headers."""
    rows = [(f"{f.stem}#text", f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    for name, headers in HEADERS.items():
        for i, parts in enumerate(headers):
            rows += [(f"{name}#header{i}-{n}", name, "\n".join(parts[:n])) for n in sorted({1, len(parts)})]
    return rows


def licence_blocks(files: DataFrame, cues: str = CUES) -> DataFrame:
    """(key, line_no, line) of the blocks of files (key, text) that hold a cue word."""
    held = files.where(F.col("text").rlike(f"(?i){cues}")).select("key", F.translate("text", "\r\0\1", "").alias("text"))
    cued = lambda x: F.lower(x).rlike(cues)
    rows = held.withColumn("lines", F.split("text", "\n"))
    # \1 ends a paragraph at a line without a word, \0 a comment beside something else
    kind = F.transform("lines", lambda x: F.when(~x.rlike("[A-Za-z0-9]"), 0).when(x.rlike(COMMENT), 1).otherwise(2))
    rows = rows.withColumn("kinds", kind)
    last = lambda i: F.when(i > 0, F.element_at("kinds", F.greatest(i, F.lit(1)))).otherwise(0)
    marked = F.transform("lines", lambda x, i: F.when(F.element_at("kinds", i + 1) == 0, "\1").when((last(i) > 0) & (last(i) != F.element_at("kinds", i + 1)), F.concat(F.lit("\0\1"), x)).otherwise(x))
    rows = rows.withColumn("parts", F.split(F.array_join(marked, "\n"), "\1"))
    # what holds no cue parts the runs
    rows = rows.withColumn("runs", F.split(F.array_join(F.transform("parts", lambda x: F.when(cued(x), x).when(x.rlike("[A-Za-z0-9\0]"), "\0").otherwise("")), "\n"), "\0"))
    flat = lambda c: F.filter(F.transform(c, lambda x: F.translate(x, "\0", "")), cued)
    found = F.array_distinct(F.concat(flat("parts"), flat("runs"), F.array("text")))
    return rows.select("key", F.posexplode(found).alias("line_no", "line"))


def licence_lines(files: DataFrame, cues: str = CUES) -> DataFrame:
    """(key, line_no, line) of files (key, text)."""
    held = files.where(F.col("text").rlike(f"(?i){cues}"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(cues))
    return held.select("key", F.posexplode(lines).alias("line_no", "line"))


def weighted(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf) of the terms of lines."""
    return lines.select(*keys, F.explode(terms(F.col("line"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def cosines(lines: DataFrame, models: DataFrame, count: int, threshold: float) -> DataFrame:
    """(key, line_no, license, score) of lines (key, line_no, line) and templates, count of them, that reach the threshold."""
    found, known = weighted(lines, ["key", "line_no"]), weighted(models, ["template", "license"])
    n = lines.count() + count
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(known.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = df.groupBy("term").agg((F.log((1.0 + F.lit(n)) / (1.0 + F.sum("df"))) + 1.0).alias("idf"))
    known_idf = common.write_shared(idf.join(F.broadcast(known.select("term").distinct()), "term", "left_semi"), "template-idf")  # the templates' terms alone
    rest = idf.join(F.broadcast(known.select("term").distinct()), "term", "left_anti")
    line_w = found.join(rest.unionByName(known_idf), "term").select("key", "line_no", "term", (F.col("tf") * F.col("idf")).alias("w"))
    line_w = common.write_shared(line_w, "licence-weights")
    norms = line_w.groupBy("key", "line_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    model_w = known.join(known_idf, "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("v"))
    model_norms = model_w.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    model_w = model_w.join(model_norms, "template").select("license", "template", "term", (F.col("v") / F.col("size")).alias("v"))
    dots = line_w.join(F.broadcast(model_w), "term").groupBy("key", "line_no", "license", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scores = dots.join(norms, ["key", "line_no"]).select("key", "line_no", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scores.where(F.col("score") >= threshold)


def words_of(text: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(common.WORD_PATTERN), F.lit(0)))


def scan(files: DataFrame, threshold: float = THRESHOLD, block_threshold: float = BLOCK_THRESHOLD) -> DataFrame:
    """(key, license, score, licence_words) of the files (key, text) whose best licence line or block reaches its threshold."""
    spark = files.sparkSession
    lines = common.write_shared(licence_lines(files), "licence-lines")
    blocks = common.write_shared(licence_blocks(files), "licence-blocks")
    full = block_templates()
    by_line = cosines(lines, templates(spark), sum(map(len, TEMPLATES.values())), threshold)
    by_block = cosines(blocks, spark.createDataFrame(full, "template string, license string, line string"), len(full), block_threshold)
    words = lines.select("key", words_of("line").alias("n")).groupBy("key").agg(F.sum("n").alias("licence_words"))
    by_line = by_line.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.lit(0).alias("kind"), "license")).alias("b")).join(words, "key")
    by_line = by_line.select("key", F.struct("b.s", "b.kind", "b.license", (-F.col("licence_words")).cast("long").alias("words")).alias("b"))
    by_block = by_block.join(blocks.select("key", "line_no", words_of("line").cast("long").alias("n")), ["key", "line_no"])
    by_block = by_block.select("key", F.struct((-F.col("score")).alias("s"), F.lit(1).alias("kind"), "license", (-F.col("n")).alias("words")).alias("b"))
    best = by_line.unionByName(by_block).groupBy("key").agg(F.min("b").alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (-F.col("b.words")).alias("licence_words"))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, as structs (dir, depth)."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above"), i.alias("depth")))


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, file_share: float = MAJORITY) -> DataFrame:
    """(id, path, license, score, how, from_dir) for each row of files."""
    rows = files.select(F.col(id_col), F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.xxhash64(path_col, text_col, id_col).alias("key"))
    narrow = rows.select(id_col, "path", "key", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.coalesce(F.regexp_count("text", F.lit(common.WORD_PATTERN)), F.lit(0)).alias("words"))
    narrow = common.write_shared(narrow, "licence-files")
    own = common.write_shared(scan(rows.select("key", "text"), threshold), "licences")
    size = (F.col("licence_words") >= file_share * F.col("words")) | F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAMES)
    declared = narrow.join(own, "key").where(size & (F.coalesce("dir", F.lit("")) != ""))
    votes = declared.groupBy("dir", "license").agg(F.count(F.lit(1)).alias("n"))
    by_dir = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("v")).select(F.col("dir").alias("above"), F.col("v.license").alias("dir_license"))
    dirs = narrow.where("dir is not null and dir <> ''").select("dir").distinct().withColumn("a", F.explode(ancestors(F.col("dir")))).select("dir", "a.above", "a.depth")
    near = common.salted_join(dirs, by_dir, "above", F.col("dir"), 16, "inner").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("d"))
    near = near.select("dir", F.col("d.above").alias("above"), F.col("d.dir_license").alias("dir_license"))
    out = common.salted_join(narrow.join(own, "key", "left"), near, "dir", F.col("key"), 16)
    how = F.when(F.col("license").isNotNull(), F.when(size, "licence_file").otherwise("header")).when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select(id_col, "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"), how.alias("how"), F.when(F.col("license").isNull(), F.col("above")).alias("from_dir"))


PATH = "coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(cast(cast(floor(doc_id / 100) as bigint) as string), '_') || '/' || coalesce(cast(doc_id as string), '_') || '.txt'"


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.documents(spark, sf_dir).select("doc_id", F.expr(PATH).alias("path"), "text"), file_share=FILE_SHARE)


_VALUES = ", ".join(f"('{name}#{i}', '{name}', '{text}')" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
OP5_SQL = f"""
WITH files AS (SELECT doc_id, {PATH} AS path, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM documents),
d AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{CUES}'))) AS line FROM d),
lines AS (SELECT doc_id, row_number() OVER () AS line_no, line FROM l),
t(template, license, line) AS (VALUES {_VALUES}),
lt AS (SELECT doc_id, line_no, term, count(*) AS tf FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM lines) GROUP BY ALL),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM lines) + (SELECT count(*) FROM t) AS n),
idf AS (SELECT term, ln((1.0e0 + any_value(n.n)) / (1.0e0 + count(*))) + 1 AS idf FROM (SELECT term FROM lt UNION ALL SELECT term FROM tt), n GROUP BY term),
lw AS (SELECT doc_id, line_no, term, tf * idf AS w FROM lt JOIN idf USING (term)),
tw AS (SELECT template, license, term, tf * idf AS v FROM tt JOIN idf USING (term)),
ln AS (SELECT line_no, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line_no),
tn AS (SELECT template, sqrt(sum(v * v)) AS size FROM tw GROUP BY template),
s AS (SELECT doc_id, license, round(sum(w * v / size) / any_value(norm), 6) AS score FROM lw JOIN tw USING (term) JOIN ln USING (line_no) JOIN tn USING (template) GROUP BY doc_id, line_no, template, license),
own AS (SELECT doc_id, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM s WHERE score >= {THRESHOLD}) WHERE r = 1),
lwords AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS lw FROM lines GROUP BY doc_id),
o AS (SELECT d.doc_id, d.path, d.dir, own.license, own.score, coalesce(lwords.lw, 0) >= {FILE_SHARE} * d.words AS big FROM d LEFT JOIN own USING (doc_id) LEFT JOIN lwords USING (doc_id)),
v AS (SELECT dir, license, count(*) AS n FROM o WHERE license IS NOT NULL AND big GROUP BY ALL),
by_dir AS (SELECT dir, license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, license) AS r FROM v) WHERE r = 1),
near AS (SELECT o.doc_id, max_by(struct_pack(d := b.dir, l := b.license), length(b.dir)) AS b FROM o JOIN by_dir b ON starts_with(o.dir || '/', b.dir || '/') GROUP BY o.doc_id)
SELECT o.doc_id, o.path, coalesce(o.license, near.b.l) AS license, coalesce(o.score, 0.0e0) AS score,
       CASE WHEN o.license IS NOT NULL THEN CASE WHEN big THEN 'licence_file' ELSE 'header' END WHEN near.b IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN o.license IS NULL THEN near.b.d END AS from_dir
FROM o LEFT JOIN near USING (doc_id)
"""
