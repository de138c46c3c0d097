"""Licence scans: passages against licence templates by Dice coefficient of word bigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm.common import without

THRESHOLD = 0.8
OWN = ("licenses", "license", "dice")

# Notices and short licence texts as they are usually written.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    ("proprietary", "All rights reserved."),
]


def bigrams(words):
    """The distinct pairs of neighbouring words of an array; a single word stands for itself."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)),
    )
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def normalised(text):
    """Words of a text: lower case, whatever is neither a letter nor a digit between them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_sizes(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """A row for each template and each number of bigrams that a passage may have to reach the
    threshold: with d = 2 * common / (a + b) and common <= min(a, b), a lies between
    b * t / (2 - t) and b * (2 - t) / t."""
    given = spark.createDataFrame(templates, "license string, template string")
    known = given.select("license", bigrams(normalised(F.col("template"))).alias("known"))
    b, t = F.size("known"), threshold
    return known.withColumn(
        "size",
        F.explode(
            F.sequence(
                F.ceil(b * (t / (2 - t)) - 1e-9).cast("int"),
                F.floor(b * ((2 - t) / t) + 1e-9).cast("int"),
            )
        ),
    )


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows with `licenses` (distinct names, sorted), `license` and `dice` (the best match, ties
    to the first name; null without a match).

    Passages are a text's lines, its paragraphs between blank lines, and the whole text. A passage
    is compared only with templates that its number of bigrams allows: an equi-join on that number
    with a broadcast row for each template and size, which the templates bound. Passages that match
    are reduced per id on the map side and meet the rows by id; texts are not shuffled.

    Null and empty texts match nothing. Rows that share an id share the matches of all of them; rows
    with a null id have none. Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    rows = without(docs, OWN)
    sizes = template_sizes(spark, templates, threshold)
    text = F.col(text_col)
    passages = F.array_distinct(
        F.concat(F.split(text, "\n", -1), F.split(text, r"\n\s*\n", -1), F.array(text))
    )
    cut = (
        rows.where(F.col(id_col).isNotNull() & text.isNotNull())
        .select(F.col(id_col).alias("id"), F.explode(passages).alias("passage"))
        .select("id", normalised(F.col("passage")).alias("words"))
        .where(F.size("words") > 0)
        .select("id", bigrams(F.col("words")).alias("own"))
    )
    dice = 2.0 * F.size(F.array_intersect("own", "known")) / (F.size("own") + F.col("size_b"))
    matched = (
        cut.join(
            F.broadcast(sizes.withColumn("size_b", F.size("known"))), F.size("own") == F.col("size")
        )
        .select("id", "license", dice.alias("dice"))
        .where(F.col("dice") >= threshold)
        .groupBy("id")
        .agg(
            F.array_sort(F.collect_set("license")).alias("licenses"),
            F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"),
        )
        .select(
            F.col("id").alias("__id"),
            "licenses",
            F.col("best.license").alias("license"),
            (-F.col("best.d")).alias("dice"),
        )
    )
    none = F.array().cast("array<string>")
    return (
        rows.join(matched, F.col(id_col) == F.col("__id"), "left")
        .withColumn("licenses", F.coalesce("licenses", none))
        .drop("__id")
    )
