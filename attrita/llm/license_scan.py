"""Operator 7 [native]: licence scan by the Dice coefficient over word bigrams.

Each line of a text, and a text of several lines as a whole, is a unit.  A unit
is normalised (lower case, every run of other characters than letters and
digits a space) and its word bigrams, counted as often as they occur, are
compared with those of each licence template:

    dice = 2 * common / (bigrams of the unit + bigrams of the template)

A coefficient of t needs sizes within t / (2 - t) and (2 - t) / t of each other,
so units outside the bounds of all templates never build bigrams, and a unit
meets only the templates that its size allows.  The best template of a unit is
reported (ties to the one that sorts first).  Occurrences are numbered, so that
a set intersection counts them; steps are bound by lambdas over arrays of one
element, so that none is computed twice.

DataFrame functions only: one scan, no shuffle; the templates are literals.

Edge cases: null, empty and one-word units have no bigrams and match nothing;
very long units fall to the size bounds; repeated rows give repeated results; a
null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Notices by which texts state public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def normalised_words(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def numbered_bigrams(words: list[str]) -> list[str]:
    """Bigrams with the number of their occurrence: "a b#1", "a b#2"."""
    seen: dict[str, int] = {}
    out = []
    for a, b in zip(words[:-1], words[1:], strict=True):
        g = f"{a} {b}"
        seen[g] = seen.get(g, 0) + 1
        out.append(f"{g}#{seen[g]}")
    return out


def template_bigrams(templates) -> list[tuple[str, list[str]]]:
    """(licence, numbered bigrams), sorted; templates are ASCII text."""
    return sorted((name, sorted(numbered_bigrams(normalised_words(text)))) for name, text in templates)


def _bounds(size: int, threshold: float) -> tuple[float, float]:
    """Sizes that can reach the threshold, a little wider than the rounding error."""
    return size * threshold / (2 - threshold) - 1e-9, size * (2 - threshold) / threshold + 1e-9


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, unit (0: the whole text, else the line's number), license,
    dice (4 places), bigrams, common: a row per unit that reaches the threshold."""
    known = template_bigrams(templates)
    low = min(_bounds(len(b), threshold)[0] for _, b in known)
    high = max(_bounds(len(b), threshold)[1] for _, b in known)
    lines = F.split(F.col(text_col), "\n")
    units = docs.select(F.col(id_col).alias("_id"), (F.size(lines) > 1).alias("_many"), F.posexplode(
        F.when(F.size(lines) > 1, F.concat(F.array(F.col(text_col)), lines)).otherwise(lines)).alias("_at", "_unit"))
    text = F.trim(F.regexp_replace(F.lower("_unit"), r"[^\p{L}\p{N}]+", " "))
    spaces = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))  # noqa: E731  one per bigram
    sized = F.filter(F.array(text), lambda t: spaces(t).between(low, high))
    words = F.transform(sized, lambda t: F.split(t, " "))
    pairs = F.transform(words, lambda w: F.transform(
        F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    grams = F.transform(pairs, lambda p: F.transform(p, lambda g, i: F.concat(
        g, F.lit("#"), F.size(F.filter(F.slice(p, 1, i + 1), lambda x: x == g)))))

    def against(g: Column, name: str, own: list[str]) -> Column:
        a, b = _bounds(len(own), threshold)
        common = F.size(F.array_intersect(g, F.array(*map(F.lit, own))))
        return F.when(F.size(g).between(a, b), F.struct(
            (F.lit(-2.0) * common / (F.size(g) + len(own))).alias("order"), F.lit(name).alias("license"),
            common.alias("common"), F.size(g).alias("bigrams")))

    best = F.transform(grams, lambda g: F.array_min(F.array_compact(F.array(*[against(g, *k) for k in known]))))
    found = units.select("_id", (F.col("_at") + F.when(F.col("_many"), 0).otherwise(1)).cast("long").alias("unit"),
                         F.explode(F.filter(best, lambda x: x["order"] <= -threshold)).alias("_best"))
    return found.select(F.col("_id").alias(id_col), "unit", "_best.license", F.round(-F.col("_best.order"), 4).alias("dice"),
                        F.col("_best.bigrams").cast("long").alias("bigrams"), F.col("_best.common").cast("long").alias("common"))


def query(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, grams))}])" for i, (name, grams) in enumerate(template_bigrams(TEMPLATES)))
    return rf"""
WITH t(tid, license, grams) AS (VALUES {rows}),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 0 AS unit, text AS unit_text FROM l WHERE len(lines) > 1
      UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1)) AS unit, unnest(lines) FROM l),
w AS (SELECT doc_id, unit, list_filter(string_split(regexp_replace(lower(unit_text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM u),
g AS (SELECT doc_id, unit, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS gs FROM w WHERE len(ws) BETWEEN 2 AND 200),
b AS (SELECT doc_id, unit, list_transform(range(1, len(gs) + 1), lambda i: gs[i] || '#' || len(list_filter(gs[1:i], lambda x: x = gs[i]))) AS grams FROM g),
d AS (SELECT doc_id, unit, license, len(b.grams) AS bigrams, len(list_intersect(b.grams, t.grams)) AS common,
             2.0 * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice FROM b, t)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, license, round(CAST(dice AS DOUBLE), 4) AS dice, CAST(bigrams AS BIGINT) AS bigrams, CAST(common AS BIGINT) AS common
FROM d WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license, common) = 1
"""


ORACLE_SQL = _oracle()
