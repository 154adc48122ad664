"""License scans with DataFrame operations only.

Units are the lines of a document (headers), blocks of it, and, of a licence file, its whole text too. Blocks are runs of
consecutive pieces, where a piece is a sentence or the part of one that stands on a line: so notices among other words of
a line and notices wrapped over lines are units. A block has at most LONGEST words and begins and ends with a piece that
shares a word with a template; without such an end it would only score less. A unit and each template become
sparse TF-IDF vectors over words that are no stop words, and are compared by cosine: lines and blocks with notices and
openings of licences, whole files with whole licence texts too. Document frequencies are counted over all documents for
the words of the templates; other words count as unseen, with the highest weight.

A cosine can't exceed the share of the template's length that the unit's words hold, nor the share of the unit's that
template words hold. Documents, and then units, that fall short of the threshold by these bounds are left out before
anything is shuffled, which loses none; what is left is few.

A document's own licence is its best template at or over the threshold. A directory has the licence of its licence
files (best cosine, then the smaller name). Documents without one of their own inherit from the nearest directory
above that has one, found by joining the distinct directories' ancestors with those directories.

Null text and null path are empty; a document in no directory inherits from the root '' only. Ties between licences
go to the smaller name. Null ids and repeated rows are documents like others, but rows that agree in id and path share
their best unit; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import drop_tables, materialize

#: Words that are in no vector; fixed values.
STOP_WORDS = [
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "in", "is", "it", "its", "not",
    "of", "on", "or", "that", "the", "this", "to", "under", "was", "with", "you", "your",
]
#: (licence, text) of notices as they stand in headers, and of how licence texts begin; fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("Apache-2.0", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Parts that several licence texts share.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_WARRANTY = "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: (licence, text) of whole licence texts, to which whole licence files are compared; fixed values. Texts of many pages are
#: found by how they begin.
WHOLE_TEXTS = [
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright {_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright {_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("ISC", 'ISC License Copyright Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", f'MIT License Copyright Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, {_NO_WARRANTY}'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.75
#: File names that make a file a licence file.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: What ends a piece: a line, or a sentence in it.
PIECE = r"\n|(?<=[.!?;:])[\x09-\x0D\x20]+"
#: Rounding of scores, as a margin of bounds.
MARGIN = 1e-6


def words_of(text: str) -> list[str]:
    return [w for w in re.findall(TOKEN, text.lower()) if w not in STOP_WORDS]


#: Words of a block that can reach the threshold: a template's are a share of threshold squared of it at least, as long as
#: its other words weigh no less than the template's.
LONGEST = math.ceil(max(len(words_of(t)) for _, t in TEMPLATES) / THRESHOLD**2)


def _tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), lambda t: ~t.isin(STOP_WORDS))


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however many expressions read it: an output of explode."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _strings(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _blocks(pieces: Column, rows: DataFrame, key: list[str], vocabulary: Column, longest: int) -> DataFrame:
    """(key, tokens): the words of all blocks of at most `longest` words. Arrays that lambdas read are outputs of explode,
    else they would be computed again for every element."""
    cut = rows.select(*key, F.explode(F.array(pieces)).alias("pieces"))
    runs = F.transform("pieces", lambda p, i: F.when(F.arrays_overlap(p, vocabulary), F.slice("pieces", i + 1, F.lit(longest))))
    begun = cut.select(*key, F.explode(F.filter(runs, lambda r: r.isNotNull())).alias("run"))
    ends = F.filter(F.sequence(F.lit(1), F.size("run")), lambda k: F.arrays_overlap(F.element_at("run", k), vocabulary))
    short = F.filter(ends, lambda k: F.aggregate(F.slice("run", F.lit(1), k), F.lit(0), lambda n, p: n + F.size(p)) <= longest)
    return begun.select(*key, F.explode(F.transform(short, lambda k: F.flatten(F.slice("run", F.lit(1), k)))).alias("tokens"))


class _Vectors:
    """Templates as unit vectors over the words of all of them, given the documents that hold each word."""

    def __init__(self, total: int, frequency: dict[str, int]):
        every = [(name, words_of(text), False) for name, text in TEMPLATES] + [(name, words_of(text), True) for name, text in WHOLE_TEXTS]
        self.unseen = math.log(1.0 + total) + 1.0
        self.idf = {w: math.log((1.0 + total) / (1.0 + frequency.get(w, 0))) + 1.0 for _, words, _ in every for w in words}
        self.rows = []
        for i, (name, words, whole) in enumerate(every):
            v = {w: words.count(w) * self.idf[w] for w in sorted(set(words))}
            norm = math.sqrt(math.fsum(x * x for x in v.values()))
            self.rows.append((i, name, {w: x / norm for w, x in v.items()}, whole))

    def may_reach(self, held: Column, threshold: float, whole: Column) -> Column:
        """Whether the words held may give a cosine of threshold with any template, those of whole texts only if `whole`."""
        def share(v: dict[str, float]) -> Column:
            weights = F.create_map(*(F.lit(x) for w, y in v.items() for x in (w, y * y)))
            return F.aggregate(F.array_intersect(held, _strings(v)), F.lit(0.0), lambda s, w: s + F.coalesce(weights[w], F.lit(0.0)))

        least = (threshold - MARGIN) ** 2
        found = F.lit(False)
        for _, _, v, of_files in self.rows:
            ok = share(v) >= least
            found = found | (ok & whole if of_files else ok)
        return found


def vocabulary_of_templates() -> list[str]:
    return sorted({w for _, text in (*TEMPLATES, *WHOLE_TEXTS) for w in words_of(text)})


def scan_licenses(docs: DataFrame, path: Column, is_license_file: Column | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, path, own_license, own_score (6 digits), license, origin ('file', 'header',
    'directory' or null), license_dir (the directory that it inherits from)."""
    spark = docs.sparkSession
    path = F.coalesce(path, F.lit(""))
    name = F.regexp_extract(path, "([^/]*)$", 1)
    is_file = F.coalesce(is_license_file, F.lit(False)) if is_license_file is not None else name.rlike(LICENSE_FILE)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), is_file.alias("is_file"), text.alias("text"))
    # rows that agree in id and path share their best unit
    key = ["doc_id", "path", "is_file"]
    vocabulary = _strings(vocabulary_of_templates())

    # of all documents, whole: which words of the templates they hold
    held = F.array_intersect(F.regexp_extract_all(F.lower(F.col("text")), F.lit(TOKEN), 0), vocabulary)
    counted = materialize(rows.select(F.explode(F.array_append(held, F.lit(""))).alias("token")).groupBy("token").agg(F.count("*").alias("df")), "license-words")
    frequency = {r["token"]: r["df"] for r in counted.collect()}  # a row per word of the templates, and one for all documents
    vectors = _Vectors(frequency.pop("", 0), frequency)

    marked = _computed(rows, "held", held).where(F.size("held") > 0)
    candidates = materialize(marked.where(vectors.may_reach(F.col("held"), threshold, F.col("is_file"))).select(*key, "text"), "license-candidates")
    longest = math.ceil(LONGEST * (THRESHOLD / threshold) ** 2)
    lines = candidates.select(*key, F.explode(F.transform(F.split("text", "\n"), _tokens)).alias("tokens")).withColumn("whole", F.lit(False))
    pieces = F.filter(F.transform(F.split("text", PIECE), _tokens), lambda p: F.size(p) > 0)
    blocks = _blocks(pieces, candidates, key, vocabulary, longest).withColumn("whole", F.lit(False))
    files = candidates.where("is_file").select(*key, _tokens(F.col("text")).alias("tokens")).withColumn("whole", F.lit(True))
    units = _computed(lines.unionByName(blocks).unionByName(files), "held", F.array_intersect("tokens", vocabulary)).where(F.size("held") > 0)
    # unseen words weigh most; with as many of them as this the known ones, even if all were one word, are too few
    units = _computed(units, "known", F.size(F.filter("tokens", lambda t: F.array_contains("held", t)))).where(F.col("known") * F.col("known") >= (F.size("tokens") - F.col("known")) * ((threshold - MARGIN) ** 2 / (1 - (threshold - MARGIN) ** 2) if threshold < 1 else 0.0))
    units = units.where(vectors.may_reach(F.col("held"), threshold, F.col("whole"))).select(*key, "whole", "tokens")
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "license-units")

    weights = spark.createDataFrame(sorted(vectors.idf.items()), "token string, idf double")
    templates = spark.createDataFrame([(i, n, w, x, whole) for i, n, v, whole in vectors.rows for w, x in v.items()], "template int, license string, token string, w double, of_files boolean")
    tf = units.select("unit", F.explode("tokens").alias("token")).groupBy("unit", "token").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(weights), "token", "left").select("unit", "token", (F.col("tf") * F.coalesce("idf", F.lit(vectors.unseen))).alias("v"))
    lengths = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = weighed.join(F.broadcast(templates), "token").groupBy("unit", "template", "license", "of_files").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scores = dots.join(lengths, "unit").select("unit", "license", "of_files", F.round(F.col("dot") / F.col("length"), 6).alias("score")).where(F.col("score") >= threshold)
    scores = scores.join(units.select("unit", "whole", *key), "unit").where("whole or not of_files")
    best = scores.groupBy(*key).agg(F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("own_license"), F.max("score").alias("own_score"))
    best = materialize(best, "license-best")
    drop_tables(counted, candidates, units)

    slim = rows.select(*key)
    parent = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    directories = best.where("is_file").groupBy(parent.alias("ancestor")).agg(F.min_by("own_license", F.struct(-F.col("own_score"), F.col("own_license"))).alias("dir_license"))
    distinct = slim.select(parent.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    nearest = distinct.select("dir", F.explode(above).alias("ancestor")).join(directories, "ancestor")
    nearest = nearest.groupBy("dir").agg(F.max_by("dir_license", F.length("ancestor")).alias("dir_license"), F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))
    nearest = materialize(nearest, "license-directories")

    safe = F.coalesce(F.col("doc_id"), F.lit(-1 << 62)).alias("safe_id")
    own = best.select(safe, F.col("path").alias("p"), F.col("is_file").alias("f"), "own_license", "own_score")
    rows = slim.select("*", safe.alias("s"), parent.alias("own_dir"))
    out = rows.join(own, (F.col("s") == F.col("safe_id")) & (F.col("path") == F.col("p")) & (F.col("is_file") == F.col("f")), "left")
    out = out.join(nearest, F.col("own_dir") == F.col("dir"), "left")
    mine = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("dir_license").isNotNull(), "directory").alias("origin"),
        F.when(~mine, F.col("ancestor")).alias("license_dir"),
    )


def oracle_sql(path: str, is_license_file: str, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan_licenses over the table documents, with SQL for the path and for what is a licence file."""
    every = [(n, t, False) for n, t in TEMPLATES] + [(n, t, True) for n, t in WHOLE_TEXTS]
    values = ", ".join("({}, '{}', '{}', {})".format(i, n, t.replace("'", "''"), whole) for i, (n, t, whole) in enumerate(every))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = f"list_filter(regexp_extract_all(lower({{}}), '{TOKEN}'), lambda t: t NOT IN ({stop}))"
    longest = math.ceil(LONGEST * (THRESHOLD / threshold) ** 2)
    return f"""
WITH d AS (SELECT doc_id, {path} AS path, {is_license_file} AS is_file, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
n AS (SELECT count(*) AS total FROM d),
tpl AS (SELECT template, license, of_files, unnest({words.format("words")}) AS token FROM (VALUES {values}) v(template, license, words, of_files)),
tt AS (SELECT template, license, of_files, token, count(*) AS tf FROM tpl GROUP BY ALL),
voc AS (SELECT DISTINCT token FROM tt), vl AS (SELECT list(token) AS vl FROM voc),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT rid, unnest({words.format("text")}) AS token FROM d) JOIN voc USING (token) GROUP BY token),
idf AS (SELECT token, ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0 AS idf FROM voc LEFT JOIN df USING (token), n),
tv AS (SELECT template, license, of_files, token, tf * idf AS w FROM tt JOIN idf USING (token)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY template),
ps AS (SELECT rid, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])[\x09-\x0D\x20]+', '\1' || chr(10), 'g'), chr(10)), lambda p: {words.format("p")}), lambda p: len(p) > 0) AS ps FROM d),
po AS (SELECT rid, ps, unnest(list_filter(range(1, len(ps) + 1), lambda i: list_has_any(ps[i], vl))) AS i, vl FROM ps, vl),
bl AS (SELECT rid, flatten(ps[i:j]) AS tokens FROM (SELECT rid, ps, i, unnest(list_filter(range(i, least(len(ps), i + {longest} - 1) + 1), lambda j: list_has_any(ps[j], vl))) AS j FROM po) WHERE list_sum(list_transform(ps[i:j], lambda p: len(p))) <= {longest}),
u AS (SELECT rid, FALSE AS whole, tokens FROM bl UNION ALL SELECT rid, FALSE, {words.format("line")} FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) UNION ALL SELECT rid, TRUE, {words.format("text")} FROM d WHERE is_file),
h AS (SELECT rid, whole, tokens, row_number() OVER () AS unit FROM (SELECT DISTINCT rid, whole, tokens FROM u, vl WHERE list_has_any(tokens, vl))),
c AS (SELECT rid, whole, unit, token, count(*) AS tf FROM (SELECT rid, whole, unit, unnest(tokens) AS token FROM h) GROUP BY ALL),
v AS (SELECT c.*, tf * coalesce(idf, ln(1.0 + total) + 1.0) AS v FROM c LEFT JOIN idf USING (token), n),
ln AS (SELECT unit, sqrt(sum(v * v)) AS length FROM v GROUP BY unit),
s AS (SELECT doc_id, path, is_file, license, round(dot / length, 6) AS score FROM (
  SELECT rid, unit, template, license, sum(v * w / norm) AS dot FROM v JOIN tv USING (token) JOIN tn USING (template) WHERE whole OR NOT of_files GROUP BY ALL) JOIN ln USING (unit) JOIN d USING (rid)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path, is_file ORDER BY score DESC, license) AS k FROM s WHERE score >= {threshold}) WHERE k = 1),
dirs AS (SELECT ancestor, license FROM (SELECT *, row_number() OVER (PARTITION BY ancestor ORDER BY score DESC, license) AS k2 FROM (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS ancestor, license, score FROM best WHERE is_file)) WHERE k2 = 1),
dd AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM d),
up AS (SELECT dir, unnest(list_concat([''], CASE WHEN dir = '' THEN [] ELSE list_transform(range(1, len(string_split(dir, '/')) + 1), lambda k: array_to_string(string_split(dir, '/')[1:k], '/')) END)) AS ancestor FROM dd),
near AS (SELECT * FROM (SELECT dir, ancestor, license, row_number() OVER (PARTITION BY dir ORDER BY length(ancestor) DESC) AS k3 FROM up JOIN dirs USING (ancestor)) WHERE k3 = 1)
SELECT d.doc_id, d.path, best.license AS own_license, best.score AS own_score, coalesce(best.license, near.license) AS license,
  CASE WHEN best.license IS NOT NULL AND d.is_file THEN 'file' WHEN best.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'directory' END AS origin,
  CASE WHEN best.license IS NULL THEN near.ancestor END AS license_dir
FROM d LEFT JOIN best ON d.doc_id IS NOT DISTINCT FROM best.doc_id AND d.path = best.path AND d.is_file = best.is_file
LEFT JOIN near ON near.dir = regexp_replace(d.path, '/?[^/]*$', '')
"""
