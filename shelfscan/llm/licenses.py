"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

What a file says of its licence is the whole text of a licence file, and of any
other its leading comment and the lines that name a licence. It is scored as a
whole and line by line, against every notice of every licence, and the best
score counts. Parts that share no telling word with any notice are left out
(they cannot be close to one). Equal parts are scored once, by their digest: their terms meet
the notices' by an equality join on the term, and dot products and norms are
sums. Document frequencies count every part of every file. A file with a licence
of its own has that; any other has the one of the nearest directory above it
that has a licence file, found by joining directories with their ancestors.

Defined results: null text says nothing; a null path is a file without
directory; of several licence files in a directory the one closest to its
template counts, then the smallest path; licences that are equally close go
by name; repeated files each give their row; an empty table gives no rows;
columns other than those named are not read. Tables in passing are written, so
jobs run while the result is planned.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.llm.scratch import written

#: fixed values: what licence notices say
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD-3-Clause": (
        "BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0, the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
STATEMENT = r"(?i)licen[cs]e|copyright|spdx"
#: a text's leading comment, in one pair of marks or line by line; the loops give nothing back, so a long comment needs no stack
BLOCK_COMMENT = r"^[ \t\n]*+/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
LINE_COMMENTS = r"^(?:[ \t]*+(?:(?:#|//|--|;|%)[^\n]*+)?+\n)++"
#: words that say nothing of a licence: a part that shares only these with the notices is not scored
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be by can do for from has have in into is it its may must no not of on or other so such that the their this to was which with you".split()
)
LEAST_SCORE = 0.5
_NOT_TERM = "[^a-z0-9]+"


def statement_of(text: Column, is_licence_file: Column) -> Column:
    """What a file says of its licence; empty where it says nothing."""
    text = F.coalesce(text, F.lit(""))
    ended = F.concat(text, F.lit("\n"))
    comment = F.concat(F.regexp_extract(ended, BLOCK_COMMENT, 0), F.regexp_extract(ended, LINE_COMMENTS, 0))
    naming = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(STATEMENT)), "\n")
    return F.when(is_licence_file, text).otherwise(F.concat(comment, F.lit("\n"), naming))


def telling_terms(templates: Mapping[str, Sequence[str]]) -> list[str]:
    """Terms of the notices that are no function words."""
    return sorted({t for texts in templates.values() for text in texts for t in re.split(_NOT_TERM, text.lower()) if t} - FUNCTION_WORDS)


def parts_of(statement: Column, templates: Mapping[str, Sequence[str]] = TEMPLATES) -> Column:
    """The statement as a whole and its lines, each once, those that share a telling term with a notice."""
    telling = F.array(*map(F.lit, telling_terms(templates)))
    return F.filter(F.array_distinct(F.concat(F.array(statement), F.split(statement, "\n"))), lambda x: F.arrays_overlap(_terms(x), telling))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NOT_TERM), lambda t: t != "")


def _template_terms(spark: SparkSession, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """(licence, notice, term, tf): a few terms of a few notices."""
    rows = [(licence, i, text) for licence, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    terms = spark.createDataFrame(rows, "licence string, notice int, text string").select("licence", "notice", F.explode(_terms(F.col("text"))).alias("term"))
    return terms.groupBy("licence", "notice", "term").agg(F.count(F.lit(1)).alias("tf"))


def match_parts(parts: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: float = LEAST_SCORE) -> DataFrame:
    """(digest, licence, score) of each part close enough to a notice. ``parts``: (digest, number, part, files), a digest once."""
    terms = parts.select("number", "files", F.explode(_terms(F.col("part"))).alias("term"))
    counts = written(terms.groupBy("number", "files", "term").agg(F.count(F.lit(1)).alias("tf")), "licence-terms")
    total = parts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total"), F.lit(1).alias("one"))
    seen = counts.groupBy("term").agg(F.sum("files").alias("df"))
    patterns = _template_terms(parts.sparkSession, templates)
    known = seen.select("term").union(patterns.select("term")).distinct().join(seen, "term", "left").withColumn("one", F.lit(1))
    idf = known.join(F.broadcast(total), "one").select("term", (F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))  # one row
    own = counts.join(idf, "term").select("number", "term", (F.col("tf") * F.col("idf")).alias("w"))
    other = patterns.join(idf, "term").select("licence", "notice", "term", (F.col("tf") * F.col("idf")).alias("v"))
    other_norm = other.groupBy("licence", "notice").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v_norm"))
    own_norm = own.groupBy("number").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_norm"))
    dots = own.join(other, "term").groupBy("number", "licence", "notice").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("w_norm") * F.col("v_norm")), 6)
    scored = dots.join(own_norm, "number").join(other_norm, ["licence", "notice"]).select("number", "licence", cosine.alias("score"))
    best = scored.where(F.col("score") >= least).groupBy("number").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    return best.join(parts.select("number", "digest"), "number").select("digest", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: float = LEAST_SCORE) -> DataFrame:
    """(id, path, licence, origin, from_path, score) per file.

    ``files``: (id, path, text, is_licence_file). ``origin`` is ``own``,
    ``inherited`` or ``none``; ``from_path`` is the file the licence comes from.
    """
    # written sides are plain exchanges for the joins, so Spark can split a part or directory that fills a task
    licence_file = F.coalesce("is_licence_file", F.lit(False))
    rows = written(files.select(
        "id", F.col("path").cast("string").alias("path"), F.monotonically_increasing_id().alias("row"),
        parts_of(statement_of(F.col("text"), licence_file), templates).alias("parts"), licence_file.alias("is_licence_file"),
    ), "licence-rows")
    said = rows.select("row", F.explode("parts").alias("part")).select("row", F.md5("part").alias("digest"), "part")
    distinct = said.groupBy("digest").agg(F.first("part").alias("part"), F.count(F.lit(1)).alias("files"))
    distinct = written(distinct.withColumn("number", F.monotonically_increasing_id()), "licence-parts")
    matched = written(match_parts(distinct, templates, least), "licence-matches")
    best = said.select("row", "digest").join(matched, "digest").groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    own = rows.drop("parts").join(best, "row", "left").select("id", "path", "is_licence_file", "best.licence", (-F.col("best.s")).alias("score"))
    own = own.select("id", "path", "is_licence_file", "licence", "score", _directory(F.coalesce("path", F.lit(""))).alias("dir"))
    holders = own.where("is_licence_file and licence is not null and path is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("holder")
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("up"), n.alias("depth")))
    climbs = own.where("licence is null").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.up", "a.depth")
    found = climbs.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("holder", "depth").alias("holder"))
    joined = own.join(written(found, "licence-directories"), "dir", "left")
    has = F.col("licence").isNotNull()
    return joined.select(
        "id", "path", F.coalesce("licence", "holder.licence").alias("licence"),
        F.when(has, "own").when(F.col("holder").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("holder.path")).alias("from_path"),
        F.when(has, F.col("score")).otherwise(-F.col("holder.s")).alias("score"),
    )
