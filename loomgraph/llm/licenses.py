"""License scans (DataFrame functions only).

Each line and each paragraph of a file, and the whole of a licence file, is
held as sparse TF-IDF vector against the templates by cosine; the best template
at or above `threshold` is the file's own licence.  IDF comes from the
templates; a term that no template has takes the highest weight, so the norm of
a unit counts all of its words.

Most text never gets that far.  From the templates follow anchors: words so
heavy that a template's vector without them is shorter than `threshold` times
its length.  By Cauchy and Schwarz a unit without any anchor stays below the
threshold, so one regular expression sieves texts and lines without loss; a
bound from the counts of known and unknown words takes most of the rest.

A file without own licence takes that of the nearest ancestor directory with a
licence file.  Directories, not files, are exploded to their ancestors and
joined by path; files then join their directory.

Cases: null or empty texts have no own licence but may inherit; null paths
neither hold nor inherit; equal paths and repeated rows are each judged by
themselves; of several licence files in a directory the best match rules, then
the licence's name; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise

#: Short forms and headers of well-known licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]
#: A term: letters and digits, with single dots or hyphens inside.
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words too common to tell a licence by; they are no terms (fixed values).
STOP = tuple("a an and any are as at be by can do for from in is it may not of on or that the this to under with you".split())
#: Base names of licence files.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


class Model:
    """Weights of the templates, all known when the plan is made."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.names = [name for name, _ in templates]
        counts = [Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP) for _, text in templates]
        found = Counter(t for c in counts for t in c)
        n = len(templates)
        self.idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in found.items()}
        self.unknown = math.log(n + 1) + 1
        self.vectors = [{t: k * self.idf[t] for t, k in c.items()} for c in counts]
        self.norms = [math.sqrt(sum(w * w for w in v.values())) for v in self.vectors]
        anchors: set[str] = set()
        for vector, norm in zip(self.vectors, self.norms, strict=True):
            rest = sum(w * w for t, w in vector.items() if t not in anchors)
            for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if rest < (threshold * norm) ** 2 * (1 - 1e-9):
                    break
                if term not in anchors:
                    anchors.add(term)
                    rest -= w * w
        self.anchors = sorted(anchors)

    def weights(self, spark: SparkSession) -> DataFrame:
        """(m_t, idf, tw): a term, its IDF and its weight in every template; a table as large as the templates."""
        rows = [F.struct(F.lit(t).alias("m_t"), F.lit(w).alias("idf"), F.array(*(F.lit(v.get(t, 0.0)) for v in self.vectors)).alias("tw")) for t, w in sorted(self.idf.items())]
        return spark.range(1).select(F.inline(F.array(*rows)))

    def sieve(self) -> str:
        """Matches lower-cased text that holds an anchor as a term of its own."""
        return "(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in self.anchors) + ")(?![a-z0-9])"


def _units(text: Column, whole: Column) -> Column:
    """Lines and paragraphs, and the text itself of licence files."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t]*\n"), F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def candidate_units(text: Column, whole: Column, model: Model, threshold: float) -> Column:
    """The units of a text that may reach the threshold; no other can.

    A unit needs an anchor.  And if n of its words are terms of templates and m
    are not, its vector has at least the square length m * unknown**2 outside
    the templates and at most (n * unknown)**2 inside, so that its cosine is at
    most n / sqrt(n * n + m).
    """
    sieve = F.lit(model.sieve())
    term = lambda words: F.lit("(?<![a-z0-9])(?<![a-z0-9][.-])(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")(?![a-z0-9])(?![.-][a-z0-9])")
    known, stop = term(model.idf), term(STOP)

    def may(unit: Column) -> Column:
        # The count is bound to a variable, or each mention of it would search the unit anew.
        counted = F.array(F.regexp_count(unit, known).cast("double"))
        enough = F.exists(counted, lambda n: n * n >= (n * n + F.regexp_count(unit, F.lit(TERM)) - n - F.regexp_count(unit, stop)) * threshold**2 * (1 - 1e-9))
        return unit.rlike(model.sieve()) & enough

    low = F.lower(text)
    return F.when(F.regexp_like(low, sieve), F.filter(_units(low, whole), may)).otherwise(F.array().cast("array<string>"))


def own_licences(files: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(row, own, similarity) of the files (row, units) that have a licence of their own."""
    units = files.select("row", F.explode("units").alias("unit"))
    stop = F.array(*map(F.lit, STOP))
    found = F.filter(F.regexp_extract_all("unit", F.lit(TERM), 0), lambda w: ~F.array_contains(stop, w))
    # Sparse vectors as rows: a unit's terms meet the templates' weights by equality.
    terms = units.select("row", F.xxhash64("unit").alias("u"), F.explode(found).alias("t")).groupBy("row", "u", "t").agg(F.count("*").alias("n"))
    weighed = terms.join(F.broadcast(model.weights(files.sparkSession)), F.col("t") == F.col("m_t"), "left").select("row", "u", (F.col("n") * F.coalesce("idf", F.lit(model.unknown))).alias("w"), "tw")
    sums = weighed.groupBy("row", "u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.col("w") * F.coalesce(F.get("tw", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(len(model.names))))
    scores = [F.struct(F.round(F.col(f"d{i}") / (F.col("norm") * F.lit(norm)), 9).alias("similarity"), F.lit(name).alias("own")) for i, (name, norm) in enumerate(zip(model.names, model.norms, strict=True))]
    best = sums.select("row", F.array_max(F.array(*scores)).alias("best")).where(F.col("best.similarity") >= threshold)
    return best.groupBy("row").agg(F.max("best").alias("best")).select("row", "best.own", "best.similarity")


def directory(path: Column) -> Column:
    """The path up to its last slash, or nothing."""
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def scan(files: DataFrame, *, id_col: str, path: Column, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """One row per file row: the id, path, own licence and similarity, and licence, origin (own, inherited or none) and origin_dir."""
    model = Model(templates, threshold)
    named = files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    named = named.withColumn("whole", F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False)))
    # Rows keep their numbers only if they are written; of the texts only the units that may match go along.
    slim = materialise(named.withColumn("units", candidate_units(F.col("text"), F.col("whole"), model, threshold)).withColumn("dir", directory(F.col("path"))).drop("text"))
    own = materialise(own_licences(slim.where(F.size("units") > 0), model, threshold))
    judged = slim.drop("units").join(own, "row", "left")
    holders = judged.where(F.col("whole") & F.col("own").isNotNull() & F.col("path").isNotNull()).groupBy("dir").agg(F.max(F.struct("similarity", "own")).alias("m")).select(F.col("dir").alias("h_dir"), F.col("m.own").alias("h_own"))
    parts = F.split("dir", "/")
    dirs = slim.where("path is not null").select("dir").distinct()
    ancestors = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("up")).distinct()
    nearest = ancestors.join(holders, F.col("up") == F.col("h_dir")).groupBy("dir").agg(F.max(F.struct(F.length("up"), F.col("up").alias("up"), F.col("h_own").alias("own"))).alias("n")).select(F.col("dir").alias("n_dir"), F.col("n.up").alias("n_from"), F.col("n.own").alias("n_own"))
    joined = judged.join(nearest, (F.col("dir") == F.col("n_dir")) & F.col("path").isNotNull(), "left")
    has_own = F.col("own").isNotNull()
    return joined.select(
        F.col("id").alias(id_col), "path", "own", "similarity", F.coalesce("own", "n_own").alias("licence"),
        F.when(has_own, "own").when(F.col("n_own").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(has_own, F.col("dir")).otherwise(F.col("n_from")).alias("origin_dir"),
    )
