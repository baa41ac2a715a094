"""License scan in DataFrame operations only.

Three kinds of text are compared with templates by the cosine of sparse TF-IDF vectors: single header lines (lines that
speak of licences), header lines with the two lines that follow (notices wrapped over lines), and whole licence files,
known by their name or by a high share of licence terms. Document frequencies count all these texts. Equal texts are
scored once, so a notice that a third of all documents carry costs one row. A document takes its best text; one without
takes the licence of the nearest directory above it that holds a licence file: each distinct directory is resolved once,
by a join on the directories of its path, and documents join their own directory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

OUT = ["license", "how", "score", "found_in"]

# Licence notices, short forms and the wording of texts and file headers.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License " + _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0", _GNU.format("General Public License", 3)),
    "GPL-2.0": ("This program is free software licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0", _GNU.format("General Public License", 2)),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD3),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}
HEADER = r"(?i)licen[cs]e|copyright|copying|spdx|public domain|permission is hereby granted|redistribution and use"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def terms(text: Column) -> Column:
    """Words in order: runs of ASCII letters, digits and inner . or -."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("([a-z0-9]+(?:[.-][a-z0-9]+)*)"), F.lit(1))


def line_scores(lines: DataFrame, templates: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """lines(h1, h2, line, n: how many; h1 and h2 tell a line) to (h1, h2, license, score): the best template, ties to the smaller name, if at least ``least``. Only the hashes of a line go along with its terms."""
    spark = lines.sparkSession
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = stored(lines.select("h1", "h2", "n", F.explode(terms(F.col("line"))).alias("w")).groupBy("h1", "h2", "n", "w").agg(F.count(F.lit(1)).alias("tf")), "terms")
    df = words.groupBy("w").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(1.0 + total) / (1.0 + F.coalesce(F.col("df"), F.lit(0)))) + 1.0
    forms = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(forms, "license string, form int, text string")  # a constant table
    known = table.select("license", "form", F.explode(terms(F.col("text"))).alias("w")).groupBy("license", "form", "w").agg(F.count(F.lit(1)).alias("tf")).join(df, "w", "left")
    known = known.select("license", "form", "w", (F.col("tf") * idf).alias("y"))
    lengths = known.groupBy("license", "form").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    known = stored(known.join(lengths, ["license", "form"]).groupBy("w").agg(F.collect_list(F.struct("license", "form", (F.col("y") / F.col("length")).alias("y"))).alias("ys")), "templates")  # a constant table by word
    weighted = words.join(df, "w").select("h1", "h2", "w", (F.col("tf") * idf).alias("x"))
    # A line's terms meet once: its length, and its products with every template.
    met = weighted.join(F.broadcast(known), "w", "left").groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("ys").isNotNull(), F.struct("x", "ys"))).alias("hits"))
    dots = met.select("h1", "h2", "norm", F.explode("hits").alias("hit")).select("h1", "h2", "norm", "hit.x", F.explode("hit.ys").alias("f")).groupBy("h1", "h2", "norm", "f.license", "f.form").agg(F.sum(F.col("x") * F.col("f.y")).alias("dot"))
    best = dots.select("h1", "h2", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= least)
    return best.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("h1", "h2", F.col("b.license"), (-F.col("b.s")).alias("score"))


def directories(of: Column) -> Column:
    """A directory and those above it, from the root "" down."""
    parts = F.split(of, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def _words(text: Column) -> Column:
    return F.size(F.split(text, "[ \\t-\\r]+"))


def texts(files: DataFrame, templates: dict[str, tuple[str, ...]], term_share: float, least_terms: int) -> DataFrame:
    """(doc_id, p, words, own_words, line, file): the texts of each file that are compared; line may be several lines, own_words counts its header line, file tells whole files."""
    lines, named = F.split("text", "\n", -1), F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    rows = files.filter(F.col("text").rlike(HEADER) | (named & (F.col("text") != ""))).select("doc_id", F.col("path").alias("p"), _words(F.col("text")).alias("words"), "text", lines.alias("lines"), named.alias("named"))
    parts = rows.select("doc_id", "p", "words", "lines", F.posexplode("lines").alias("i", "line")).filter(F.col("line").rlike(HEADER))
    wrapped = F.array_join(F.slice("lines", F.col("i") + 1, F.lit(3)), " ")
    parts = parts.select("doc_id", "p", "words", _words(F.col("line")).alias("own_words"), F.explode(F.array_distinct(F.array("line", wrapped))).alias("line"), F.lit(False).alias("file"))
    vocabulary = sorted(set(re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", " ".join(t for ts in templates.values() for t in ts).lower())))
    own = F.array_distinct(terms(F.col("text")))
    share = (F.size(own) >= least_terms) & (F.size(F.array_intersect(own, F.array(*map(F.lit, vocabulary)))) >= F.size(own) * term_share)
    return parts.unionByName(rows.filter(F.col("named") | share).select("doc_id", "p", "words", F.col("words").alias("own_words"), F.col("text").alias("line"), F.lit(True).alias("file")))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.45, file_share: float = 0.5, term_share: float = 0.6, least_terms: int = 30) -> DataFrame:
    """files(doc_id, path, text) to (doc_id, license, how, score, found_in) of every row.

    how: "header" (some lines of a file), "file" (the row is a licence file: by its name, by term_share of its distinct
    words, of which it has least_terms, being words of the templates, or as file_share of its words stand in the lines), "inherited" (found_in: the
    directory) or null. Null and empty texts and a null path have nothing of their own; a null path inherits nothing. Rows
    that share an id and path share their lines. Ties go to the smaller licence name. Other columns are ignored.
    """
    templates = templates or TEMPLATES
    files = files.select("doc_id", "path", "text")
    hashed = {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("2"), "line")}
    lines = stored(texts(files, templates, term_share, least_terms).withColumns(hashed), "headers")
    scored = line_scores(lines.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n")), templates, least)
    hits = lines.select("doc_id", "p", "words", "own_words", "file", "h1", "h2").join(scored, ["h1", "h2"])
    whole = F.col("file") | F.coalesce(F.col("p").rlike(FILE_NAME), F.lit(False)) | (F.col("own_words") >= F.col("words") * file_share)
    own = hits.groupBy("doc_id", "p").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.max(whole).alias("whole"))
    own = stored(own.select(F.col("doc_id").alias("id"), "p", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "whole"), "own")

    above_path = lambda path: F.regexp_replace(path, "/?[^/]*$", "")
    above = own.filter("whole AND p IS NOT NULL").groupBy(above_path(F.col("p")).alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    asked = files.filter("path IS NOT NULL").select(above_path(F.col("path")).alias("of")).distinct()
    near = asked.select("of", F.posexplode(directories(F.col("of"))).alias("depth", "at")).join(above, "at").groupBy("of").agg(F.max(F.struct("depth", "at", "b")).alias("m"))
    near = stored(near.select("of", F.struct(F.col("m.b.license").alias("license"), (-F.col("m.b.s")).alias("score"), F.col("m.at").alias("at")).alias("from")), "directories")
    out = files.select("doc_id", "path", above_path(F.col("path")).alias("dir")).join(own, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("path").eqNullSafe(F.col("p")), "left")
    out = out.join(near, F.col("dir") == F.col("of"), "left")
    has, inherits = F.col("license").isNotNull(), F.col("from").isNotNull()
    how = F.when(has, F.when(F.col("whole"), "file").otherwise("header")).when(inherits, "inherited")
    return out.select("doc_id", F.coalesce("license", "from.license").alias("license"), how.alias("how"), F.coalesce("score", "from.score").alias("score"), F.when(has, F.col("path")).otherwise(F.col("from.at")).alias("found_in"))


def sql(path: str, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.45, file_share: float = 0.5, term_share: float = 0.6, least_terms: int = 30) -> str:
    """The rows of scan over documents, whose path is the given SQL expression."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    forms = ", ".join(f"({quoted(name)}, {i}, {quoted(text)})" for name, ts in templates.items() for i, text in enumerate(ts))
    term = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
    words = lambda c: f"len(regexp_split_to_array({c}, '[ \\t-\\r]+'))"
    return f"""
WITH files AS (SELECT doc_id, {path} AS path, text FROM documents), forms AS (SELECT * FROM (VALUES {forms}) t(license, form, text)),
vocabulary AS (SELECT list_distinct(flatten(list({term("text")}))) AS known FROM forms),
rows_ AS (SELECT doc_id, path AS p, {words("text")} AS words, text, string_split(text, chr(10)) AS lines, coalesce(regexp_matches(path, {quoted(FILE_NAME)}), false) AS named, list_distinct({term("text")}) AS own FROM files WHERE regexp_matches(text, {quoted(HEADER)}) OR (regexp_matches(path, {quoted(FILE_NAME)}) AND text <> '')),
each AS (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM rows_),
heads AS (SELECT doc_id, p, words, lines[i] AS line, array_to_string(lines[i : i + 2], ' ') AS wrapped FROM each WHERE regexp_matches(lines[i], {quoted(HEADER)})),
texts AS (
  SELECT doc_id, p, words, {words("line")} AS own_words, line, false AS file FROM heads UNION ALL SELECT doc_id, p, words, {words("line")}, wrapped, false FROM heads WHERE wrapped <> line
  UNION ALL SELECT doc_id, p, words, words, text, true FROM rows_, vocabulary WHERE named OR (len(own) >= {least_terms} AND len(list_intersect(own, known)) >= len(own) * {term_share})
),
lines_ AS (SELECT line, count(*) AS n FROM texts GROUP BY line), total AS (SELECT coalesce(sum(n), 0) AS total FROM lines_),
tf AS (SELECT line, n, w, count(*) AS tf FROM (SELECT line, n, unnest({term("line")}) AS w FROM lines_) x GROUP BY ALL), df AS (SELECT w, sum(n) AS df FROM tf GROUP BY w),
idf AS (SELECT w, ln((1.0 + total) / (1.0 + df)) + 1.0 AS idf FROM df, total),
weighted AS (SELECT line, w, tf.tf * idf AS x FROM tf JOIN idf USING (w)), norms AS (SELECT line, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY line),
known AS (SELECT license, form, w, count(*) AS tf FROM (SELECT license, form, unnest({term("text")}) AS w FROM forms) x GROUP BY ALL),
knownx AS (SELECT license, form, known.w, known.tf * coalesce(idf, ln(1.0 + total) + 1.0) AS y FROM known LEFT JOIN idf USING (w), total),
knowny AS (SELECT license, form, w, y / sqrt(sum(y * y) OVER (PARTITION BY license, form)) AS y FROM knownx),
dots AS (SELECT line, license, form, sum(x * y) AS dot FROM weighted JOIN knowny USING (w) GROUP BY ALL),
scored AS (SELECT line, license, round(dot / norm, 9) AS score FROM dots JOIN norms USING (line) WHERE round(dot / norm, 9) >= {least}),
best AS (SELECT line, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
hits AS (SELECT texts.*, license, score, file OR coalesce(regexp_matches(p, {quoted(FILE_NAME)}), false) OR own_words >= words * {file_share} AS whole FROM texts JOIN best USING (line)),
own AS (SELECT doc_id, p, min((-score, license)) AS b, bool_or(whole) AS whole FROM hits GROUP BY doc_id, p),
above AS (SELECT regexp_replace(p, '/?[^/]*$', '') AS place, min(b) AS b FROM own WHERE whole GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
steps AS (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM dirs),
near AS (SELECT dir, place, b FROM (SELECT dir, depth, array_to_string(string_split(dir, '/')[1 : depth], '/') AS place FROM steps) x JOIN above USING (place) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT files.doc_id, coalesce(struct_extract(own.b, 2), struct_extract(near.b, 2)) AS license, CASE WHEN own.b IS NOT NULL THEN CASE WHEN whole THEN 'file' ELSE 'header' END WHEN near.b IS NOT NULL THEN 'inherited' END AS how,
  coalesce(-struct_extract(own.b, 1), -struct_extract(near.b, 1)) AS score, CASE WHEN own.b IS NOT NULL THEN path ELSE near.place END AS found_in
FROM files LEFT JOIN own ON own.doc_id = files.doc_id AND own.p = files.path LEFT JOIN near ON near.dir = regexp_replace(files.path, '/?[^/]*$', '')
"""
