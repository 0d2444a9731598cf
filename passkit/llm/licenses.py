"""Licence scan: TF-IDF cosine to templates, then inheritance from directories.

Units are the lines of a text and its paragraphs of two lines or more. A
unit's terms are runs of ASCII letters and digits, in lower case; their
weights are tf * idf with ``idf = ln((1 + N) / (1 + df)) + 1`` over all N
units with a term. Only terms of some template are counted for df; any other
term weighs as one seen nowhere. A unit carries a template's licence if their
cosine reaches ``LEAST``.

Units are pruned before their terms are unfolded, exactly: the lightest
terms of a template that together hold less than ``LEAST ** 2`` of its squared
norm cannot bring a cosine to ``LEAST``, so a unit needs one of the others.

A licence file is one whose name says so, or whose matching lines hold half
of its words or more; it gives its licences to its directory. A file
without a licence of its own takes those of the nearest directory above it
that has any, by a join on the distinct directories' ancestors.

Built-in functions only. Defined results: a null path is in no directory and
inherits nothing; a null or empty text has no licence of its own; equal rows
give equal rows, as every row is a file; ties in cosine go to the template
that sorts first; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passkit.llm.base import small, stored

LEAST = 0.6
LICENCE_FILE = "(?i)^(un)?(licen[cs]e|copying|copyright|notice)([.-].*)?$"

# Wording of public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used "
                     "to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def units(files: DataFrame, text: str) -> DataFrame:
    """(_file, _unit, _line, _terms): lines and paragraphs with a term."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # a paragraph counts beside its lines if it has two or more of them
    pars = F.filter(F.split(t, "\n[\\x20\\t\\r]*\n"), lambda p: F.instr(F.trim(p, F.lit("\n")), "\n") > 0)
    both = F.concat(F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("x"), F.lit(True).alias("line"))),
                    F.transform(pars, lambda x: F.struct(x.alias("x"), F.lit(False).alias("line"))))
    rows = files.select("_file", F.posexplode(both).alias("_unit", "_u"))
    return rows.select("_file", "_unit", F.col("_u.line").alias("_line"), _terms(F.col("_u.x")).alias("_terms")).filter(F.size("_terms") > 0)


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of literals; the templates' size bounds all that come here."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def matches(files: DataFrame, text: str, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(_file, _unit, _line, n_terms, licence, cosine): the units that reach ``least``, each with its best template."""
    spark = files.sparkSession
    bags = [(name, _words(t)) for name, t in templates]
    vocabulary = sorted({w for _, b in bags for w in b})
    rows = units(files, text)
    seen = rows.select(F.array_intersect("_terms", F.array(*map(F.lit, vocabulary))).alias("t"))
    counts = {r["t"]: r["n"] for r in seen.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # "" counts the units; a row for each vocabulary term at most
    total = counts.get("", 0)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}
    beyond = math.log(1 + total) + 1
    weights, needed = [], set()
    for k, (name, bag) in enumerate(bags):
        w = {t: bag.count(t) * idf[t] for t in bag}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights += [(k, name, t, x / norm) for t, x in sorted(w.items())]
        below = 0.0
        for t, x in sorted(w.items(), key=lambda tx: (tx[1], tx[0])):
            below += (x / norm) ** 2
            if below >= least * least - 1e-9:
                needed.add(t)
    held = rows.filter(F.arrays_overlap("_terms", F.array(*map(F.lit, sorted(needed)))))
    tf = held.select("_file", "_unit", "_line", F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term")).groupBy(
        "_file", "_unit", "_line", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(_table(spark, sorted(idf.items()), ["term", "idf"])), "term", "left")
    tf = tf.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(beyond)))
    norm = tf.groupBy("_file", "_unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.join(F.broadcast(_table(spark, weights, ["k", "licence", "term", "tw"])), "term").groupBy(
        "_file", "_unit", "_line", "n_terms", "k", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cos = dot.join(norm, ["_file", "_unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= least)
    return cos.groupBy("_file", "_unit", "_line", "n_terms").agg(F.max(F.struct("cosine", (-F.col("k")).alias("k"), "licence")).alias("best")).select(
        "_file", "_unit", "_line", "n_terms", "best.licence", "best.cosine")


def scan(files: DataFrame, path: str = "path", text: str = "text", id_col: str | None = None,
         templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per file: path (and id), own licences, best cosine, and the licences it has and how.

    ``via`` is ``own``, ``directory`` or ``none``; ``licences`` are joined by a comma in sorted order.
    """
    names = [c for c in (id_col, path) if c]
    content = (F.col(path).cast("string"), F.col(text).cast("string"))
    # a file is named by 128 bits of its path and text, so that any scan names it alike; equal rows share their terms
    rows = files.select(F.struct(*names).alias("_row"), content[0].alias("_path"), content[1].alias("_text"),
                        F.struct(F.xxhash64(*content).alias("a"), F.xxhash64(F.lit(1), *content).alias("b")).alias("_file"))
    base = stored(rows.select("_file", "_row", "_path", F.size(_terms(F.coalesce("_text", F.lit("")))).alias("n")), "files")
    found = stored(matches(rows, "_text", TEMPLATES if templates is None else templates, least), "licences")
    own = found.groupBy("_file").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("own_licences"), F.max("cosine").alias("best_cosine"),
        F.sum(F.when(F.col("_line"), F.col("n_terms"))).alias("line_terms"))
    slash = F.length("_path") - F.length(F.substring_index("_path", "/", -1))
    out = base.join(own, "_file", "left").withColumns({
        "_dir": F.when(slash > 0, F.expr("substring(_path, 1, length(_path) - length(substring_index(_path, '/', -1)) - 1)")).otherwise(
            F.when(F.col("_path").isNotNull(), F.lit(""))),
        "_gives": F.col("own_licences").isNotNull() & (F.substring_index("_path", "/", -1).rlike(LICENCE_FILE) | (2 * F.col("line_terms") >= F.col("n")))})
    out = stored(out, "own")
    given = out.filter("_gives and _dir is not null").select("_dir", F.explode(F.split("own_licences", ",")).alias("l")).distinct().groupBy("_dir").agg(
        F.array_join(F.array_sort(F.collect_list("l")), ",").alias("dir_licences"))
    dirs = out.filter("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn(
        "_up", F.array_join(F.slice(F.split("_dir", "/"), 1, F.col("depth")), "/"))
    near = above.join(given.withColumnRenamed("_dir", "_up"), "_up").groupBy("_dir").agg(
        F.max(F.struct("depth", F.col("_up").alias("from"), "dir_licences")).alias("g")).select(
        "_dir", F.col("g.from").alias("inherited_from"), F.col("g.dir_licences").alias("dir_licences"))
    near = small(stored(near, "directories"))
    out = out.join(near, "_dir", "left")
    has = F.col("own_licences").isNotNull()
    return out.select("_row.*", "own_licences", "best_cosine",
                      F.when(~has, F.col("inherited_from")).alias("inherited_from"),
                      F.coalesce("own_licences", "dir_licences").alias("licences"),
                      F.when(has, "own").when(F.col("dir_licences").isNotNull(), "directory").otherwise("none").alias("via"))
