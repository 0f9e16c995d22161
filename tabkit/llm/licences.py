"""Licence scan with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance by directory.

Every line and every paragraph of a file is a segment. Its terms (runs of a-z and 0-9 after lowering A-Z) are
weighted by their count times ``ln((1 + files) / (1 + files with the term)) + 1``, counted over all files for every
term. A segment whose cosine to a template reaches ``threshold`` carries that licence, and a file has the licence of
its best segment, the smaller name on ties.

Few segments are weighed. By Cauchy-Schwarz the cosine is at most the norm of the template's shared terms, so a
set of rare terms is chosen such that no template reaches the threshold without one of them; a segment without
any is left out. That loses nothing. The templates and their terms are fixed and small; they are broadcast, with
the other terms of most files, ``COMMON`` at most. The weights of the remaining terms are joined by a shuffle.

A file without a licence of its own inherits that of the nearest directory, its own first, that holds a licence
file with one. Directories are joined with their ancestors, once per directory rather than per file.

Defined cases: a null or empty text has no licence of its own. A null path lies in no directory and inherits
nothing. Repeated rows are files of their own. Several licence files in one directory: the greater cosine, then
the smaller name. Without files there are no rows. Columns that bear the name of a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import ascii_lower, met, stored, without

THRESHOLD = 0.8
#: Terms outside the templates that are broadcast with their weights.
COMMON = 10_000
#: Directories that are broadcast with the licences they inherit.
BROADCAST_DIRS = 200_000
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"

#: Notices and opening paragraphs of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _terms(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _idf(df: int, files: int) -> float:
    return math.log((1 + files) / (1 + df)) + 1


def template_weights(templates, idf: dict[str, float]) -> list[dict[str, float]]:
    """Each template as a vector of norm one."""
    vectors = []
    for _, text in templates:
        weights = {t: n * idf[t] for t, n in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append({t: w / norm for t, w in weights.items()})
    return vectors


def telling_terms(vectors: list[dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Rare terms first, until no template reaches the threshold on its other terms."""
    left = [sum(w * w for w in v.values()) for v in vectors]
    chosen = []
    for term in sorted(idf, key=lambda t: (-idf[t], t)):
        open_ = [i for i, rest in enumerate(left) if rest >= threshold**2 * (1 - 1e-9) and term in vectors[i]]
        if open_:
            chosen.append(term)
            for i, v in enumerate(vectors):
                left[i] -= v.get(term, 0.0) ** 2
    return chosen


def _least_size(terms: DataFrame) -> int:
    """The least ``size`` such that ``COMMON`` terms at most have it or a greater one."""
    held = {row["size"]: row["count"] for row in terms.groupBy("size").count().collect()}
    least, taken = 65, 0
    for size in range(64, 0, -1):
        taken += held.get(size, 0)
        if taken > COMMON:
            break
        least = size
    return least


def own_licences(files: DataFrame, key_col: str, text_col: str, *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, cosine) of the files that have a licence of their own. ``key_col`` names a file."""
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    texts = files.select(F.col(key_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = texts.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("word"))
    words = stored(held.groupBy("word").agg(F.count("*").alias("files")), "licence-terms")
    counts = {row["word"]: row["files"] for row in words.filter(F.col("word").isin(vocabulary)).collect()}
    total = files.count()
    idf = {t: _idf(counts.get(t, 0), total) for t in vocabulary}
    vectors = template_weights(templates, idf)
    telling = F.array(*map(F.lit, telling_terms(vectors, idf, threshold)))

    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("at", "segment"))
    blocks = F.filter(F.split("text", r"\n[\x20\t\r]*\n"), lambda x: F.contains(x, F.lit("\n")))
    paragraphs = texts.select("key", F.posexplode(blocks).alias("at", "segment")).withColumn("at", -1 - F.col("at"))
    segments = lines.union(paragraphs).withColumn("terms", _terms(F.col("segment")))
    segments = segments.filter(F.arrays_overlap("terms", telling)).select("key", "at", F.explode("terms").alias("term"))
    counted = segments.groupBy("key", "at", "term").agg(F.count("*").alias("n"))

    spark = files.sparkSession
    kind = "word string, idf double, uses array<struct<template:int,weight:double>>"
    rows = [(t, float(idf[t]), [(i, float(v[t])) for i, v in enumerate(vectors) if t in v]) for t in vocabulary]
    weight = F.log(F.lit(float(1 + total)) / (1 + F.col("files"))) + 1
    others = words.filter(~F.col("word").isin(vocabulary)).withColumn("size", F.length(F.bin("files")))
    least = _least_size(others)
    others = others.select("word", weight.alias("idf"), F.lit(None).cast("array<struct<template:int,weight:double>>").alias("uses"), "size")
    common = spark.createDataFrame(rows, kind).union(others.filter(F.col("size") >= least).drop("size"))
    met = counted.join(F.broadcast(common), F.col("term") == F.col("word"), "left")
    rare = met.filter("word IS NULL").select("key", "at", "term", "n")
    rare = rare.join(others.filter(F.col("size") < least).drop("size").hint("shuffle_merge"), F.col("term") == F.col("word"))
    weighed = met.filter("word IS NOT NULL").union(rare).select("key", "at", "term", (F.col("n") * F.col("idf")).alias("w"), "uses")
    weighed = stored(weighed, "licence-weights")
    by_template = weighed.select("key", "at", "w", F.explode_outer("uses").alias("use"))
    # the norm needs each term once: its square goes with the first use only, here by a sum per segment and term
    norms = weighed.groupBy("key", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = by_template.filter("use IS NOT NULL").groupBy("key", "at", F.col("use.template").alias("template")).agg(
        F.sum(F.col("w") * F.col("use.weight")).alias("dot")
    )
    # rounded, so that the order in which terms are added decides nothing
    cosines = dots.join(norms, ["key", "at"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    names = F.array(*[F.lit(name) for name, _ in templates])
    matched = cosines.filter(F.col("cosine") >= threshold).withColumn("licence", F.get(names, F.col("template")))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence")))
    return matched.groupBy("key").agg(best.alias("b")).select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def is_licence_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(LICENCE_FILE)


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, licence, from_dir): for each ``dir`` the licence of the nearest directory upwards in ``licensed``."""
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))
    up = directories.select("dir", F.explode(depths).alias("depth"))
    up = up.withColumn("ancestor", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")))
    met = up.join(licensed.select(F.col("dir").alias("ancestor"), "licence"), "ancestor")
    nearest = met.groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "licence")).alias("n"))
    return nearest.select("dir", F.col("n.licence").alias("licence"), F.col("n.ancestor").alias("from_dir"))


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every file with ``licence``, ``cosine`` (null unless its own), ``basis`` (own, inherited or none) and
    ``from_dir`` (whose licence it inherits)."""
    added = ["licence", "cosine", "basis", "from_dir"]
    rows = without(files, added)
    # rows are told apart by path and text: repeated rows have the same licence
    key = F.xxhash64(F.col(path_col), F.col(text_col))
    marked = rows.withColumn("__key", F.struct(F.col(path_col).alias("p"), key.alias("h")))
    own = stored(own_licences(marked, "__key", text_col, templates=templates, threshold=threshold), "licences")
    kept = own.select("key", "licence", "cosine", directory(F.col("key.p")).alias("dir"))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence")))
    licensed = kept.filter(is_licence_file(F.col("key.p"))).groupBy("dir").agg(best.alias("b")).select("dir", F.col("b.licence").alias("licence"))
    dirs = rows.select(directory(F.col(path_col)).alias("dir")).filter("dir IS NOT NULL").distinct()
    above = stored(inherited(dirs, licensed).select(F.col("dir").alias("__dir"), F.col("licence").alias("__above"), "from_dir"), "directories")
    mine = own.select(F.col("key").alias("__own"), F.col("licence").alias("__licence"), "cosine")
    joined = marked.join(mine, F.col("__key").eqNullSafe(F.col("__own")), "left")
    # a directory may hold a third of all files: its row is broadcast, or stands under every salt
    joined = met(joined.withColumn("__dir", directory(F.col(path_col))), above, ["__dir"], "left", BROADCAST_DIRS)
    own_one = F.col("__licence").isNotNull()
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__licence", "__above").alias("licence"), "cosine",
        F.when(own_one, "own").when(F.col("__above").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(~own_one, F.col("from_dir")).alias("from_dir"),
    )
