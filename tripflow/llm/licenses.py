"""License scans, in SQL functions only.

A line of a text is a header if the cosine of its sparse TF-IDF vector to a template reaches ``COSINE``. Document
frequencies are those of every term over all documents, on the lines as in the templates. A line can only reach the cosine if it holds one of the template's ``required``
terms (without them too little of the template's norm is left), so other lines are never taken apart.

A document whose licence lines hold at least ``FILE_SHARE`` per cent of its words is a licence file and speaks for its
directory. Documents without a licence of their own inherit that of the nearest ancestor directory, by an
equality join on the paths of all ancestors.

Defined cases: null or blank texts have no licence and may inherit; a null path is the root directory; repeated
rows give a row each; ties go to the higher cosine, the name and the smallest id; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import land

COSINE = 0.8
FILE_SHARE = 50
# Fixed texts: short notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Terms are runs of letters and digits, with inner points and hyphens (``2.0``, ``by-nc``).
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# A separator starts with no letter or digit; a single point or hyphen between two of them is none.
SPLIT = r"[^a-z0-9](?:[^a-z0-9]++|(?<![.-])|(?![a-z0-9])|(?<![a-z0-9].))"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def terms_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda term: term != "")


def vectors(frequency: dict[str, int], documents: int, templates=TEMPLATES) -> list[tuple[str, int, dict[str, float]]]:
    """Name, number and unit vector of each template."""
    out = []
    for number, (name, text) in enumerate(templates):
        weights = {term: n * idf(frequency.get(term, 0), documents) for term, n in Counter(terms_of(text)).items()}
        norm = math.sqrt(sum(weight * weight for weight in weights.values()))
        out.append((name, number, {term: weight / norm for term, weight in weights.items()}))
    return out


def idf(frequency: int, documents: int) -> float:
    return math.log((1 + documents) / (1 + frequency)) + 1


def required_terms(vector: dict[str, float], cosine: float = COSINE) -> list[str]:
    """Terms without all of which the rest of a unit vector is shorter than ``cosine``."""
    chosen, left = [], 1.0
    for term, weight in sorted(vector.items(), key=lambda one: (-one[1], one[0])):
        if left < cosine * cosine - 1e-9:
            break
        chosen.append(term)
        left -= weight * weight
    return chosen


def document_frequency(terms: DataFrame) -> DataFrame:
    """Documents that hold each term: term, documents. ``terms``: the distinct terms of each document."""
    return terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


def template_frequency(frequency: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Those of the template terms, a fixed number."""
    vocabulary = sorted({term for _, text in templates for term in terms_of(text)})
    return {row["term"]: row["documents"] for row in frequency.where(F.col("term").isin(vocabulary)).collect()}


def header_lines(docs: DataFrame, frequency: DataFrame, documents: int, cosine: float = COSINE) -> DataFrame:
    """row, line, words, name and cosine of the best template of every line that reaches ``cosine``.

    ``docs``: row, text. ``frequency``: term, documents. The table of templates has a fixed size.
    """
    spark = docs.sparkSession
    weights = vectors(template_frequency(frequency), documents)
    needed = sorted({term for _, _, vector in weights for term in required_terms(vector, cosine)})
    # Longer terms first, so that the alternation does not stop at a part of a term.
    needed.sort(key=len, reverse=True)
    pattern = "(?<![a-z0-9])(?:" + "|".join(map(re.escape, needed)) + ")(?![a-z0-9])"
    table = spark.createDataFrame(
        [(name, number, term, weight) for name, number, vector in weights for term, weight in vector.items()],
        "name string, template int, term string, weight double",
    )
    lines = (
        docs.where(F.lower("text").rlike(pattern))
        .select("row", F.posexplode(F.split("text", "\n")).alias("line", "body"))
        .where(F.lower("body").rlike(pattern))
    )
    terms = lines.select("row", "line", F.explode(terms_column(F.col("body"))).alias("term"))
    counted = terms.groupBy("row", "line", "term").agg(F.count("*").alias("n"))
    weight = F.log((1 + F.lit(documents)) / (1 + F.coalesce("documents", F.lit(0)))) + 1
    weighed = counted.join(frequency, "term", "left").withColumn("w", F.col("n") * weight)
    norms = weighed.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("words"))
    dots = (
        weighed.join(F.broadcast(table), "term")
        .groupBy("row", "line", "name", "template")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    best = (
        dots.join(norms, ["row", "line"])
        .withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
        .where(F.col("cosine") >= cosine)
        .groupBy("row", "line")
        .agg(F.max("words").alias("words"), F.min(F.struct(-F.col("cosine"), "name", "cosine")).alias("best"))
    )
    return best.select("row", "line", "words", "best.name", "best.cosine")


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ("") included, as (depth, directory)."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda part: part != "")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda depth: F.struct(depth.alias("depth"), F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("directory")),
    )


def scan(docs: DataFrame, path: Column, file_share: int = FILE_SHARE) -> DataFrame:
    """Per row: doc_id, path, n_words, license_words, license, cosine, is_file, effective, from_doc, distance.

    ``effective`` is the licence of the document or the one it inherits; ``from_doc`` and ``distance`` (levels up)
    say from where.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), text.alias("text")
    ).withColumn("row", F.monotonically_increasing_id())
    words = F.when(F.trim("text") == "", 0).otherwise(F.size("all"))
    plain = rows.withColumn("all", terms_column(F.col("text"))).select(
        "row", "doc_id", "path", words.cast("long").alias("n_words"), F.array_distinct("all").alias("terms")
    )
    plain = land(plain, "terms")
    frequency = land(document_frequency(plain), "frequency")
    found = header_lines(rows.select("row", "text"), frequency, plain.count())
    own = found.groupBy("row").agg(
        F.sum("words").alias("license_words"), F.min(F.struct(-F.col("cosine"), "name", "cosine")).alias("best")
    )
    own = own.select("row", "license_words", F.col("best.name").alias("license"), F.col("best.cosine").alias("cosine"))
    judged = land(
        plain.drop("terms").join(own, "row", "left")
        .withColumn("license_words", F.coalesce("license_words", F.lit(0)))
        .withColumn("is_file", F.col("license").isNotNull() & (100 * F.col("license_words") >= file_share * F.col("n_words"))),
        "licenses",
    )
    up = ancestors(F.col("path"))
    speakers = (
        judged.where("is_file")
        .select(F.element_at(up, -1)["directory"].alias("directory"), "license", "doc_id", "cosine")
        .groupBy("directory")
        .agg(F.min(F.struct(-F.col("cosine"), "license", "doc_id")).alias("best"))
        .select("directory", F.col("best.license").alias("given"), F.col("best.doc_id").alias("from_doc"))
    )
    # A directory is looked up once, however many documents it holds.
    directories = judged.where("license is null").select(F.element_at(up, -1)["directory"].alias("at"), up.alias("up")).distinct()
    inherited = (
        directories.select("at", F.size("up").alias("levels"), F.explode("up").alias("one"))
        .select("at", "levels", "one.depth", "one.directory")
        .join(speakers, "directory")
        .groupBy("at")
        .agg(F.max(F.struct("depth", "given", "from_doc", "levels")).alias("best"))
        .select("at", "best.given", "best.from_doc", (F.col("best.levels") - 1 - F.col("best.depth")).alias("distance"))
    )
    joined = judged.withColumn("at", F.when(F.col("license").isNull(), F.element_at(up, -1)["directory"])).join(inherited, "at", "left")
    return joined.select(
        "doc_id",
        "path",
        "n_words",
        "license_words",
        "license",
        "cosine",
        "is_file",
        F.coalesce("license", "given").alias("effective"),
        F.coalesce("from_doc", F.when(F.col("license").isNotNull(), F.col("doc_id"))).alias("from_doc"),
        F.coalesce("distance", F.when(F.col("license").isNotNull(), 0)).cast("int").alias("distance"),
    )
