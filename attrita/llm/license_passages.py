"""Licence passages [native]: notices anywhere in a text, by the Dice coefficient over word bigrams.

``license_scan`` compares whole lines and whole texts.  Here every window of
the normalised text, whatever lines it runs over, is compared with each
template (those of ``license_scan``, full notices, full licence texts):

    dice = 2 * common / (bigrams of the window + bigrams of the template)

Only windows that begin and end on a bigram that counts need a look: cutting
others off raises the coefficient.  A bigram counts in a window as often as in
the template at most, so an occurrence counts unless as many earlier ones lie
in the window.  Steps: texts without any anchor are done (a window that reaches
the threshold misses fewer bigrams than a template has anchors); the others'
template bigrams become rows; each meets those that follow it within the
template's largest window (by bands, so long texts stay linear); running counts
give every window's coefficient.  One row per document and licence: the best
window (ties: more common bigrams, then the earliest and shortest).

The MIT and BSD licences are whole templates; the Apache, GPL, MPL and CC
licences are found by their opening passage.

Edge cases: null and empty texts match nothing; repeated rows give repeated
results; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrita.llm.common import written
from attrita.llm.license_scan import TEMPLATES, THRESHOLD, normalised_words

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:")
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.")
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
    "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>.")
#: Fixed values besides the notices of ``license_scan``.
PASSAGES = (
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
                     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                     "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
                     "holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined "
                  "below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution "
                  "4.0 International Public License"),
    ("GPL-3.0", _GPL_NOTICE),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
                "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but "
                "changing it is not allowed."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or "
            'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
            "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that "
                "creates, contributes to the creation of, or owns Covered Software."),
)


def bigrams(text: str) -> list[str]:
    words = normalised_words(text)
    return [f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)]


def _anchors(grams: list[str], threshold: float) -> set[str]:
    """Bigrams of which any window that reaches the threshold holds one: more
    occurrences than it can miss, those with the longest words."""
    missed = len(grams) * (2 - 2 * threshold) / (2 - threshold) + 1e-9
    chosen, held = set(), 0
    for g, n in sorted(Counter(grams).items(), key=lambda x: (-max(map(len, x[0].split())), x[0])):
        if held > missed:
            break
        chosen.add(g)
        held += n
    return chosen


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + PASSAGES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, license, dice (4 places), start (number of its first word),
    bigrams, common: the best window of each document and licence."""
    known = [(name, g) for name, text in templates if (g := bigrams(text))]
    table = [(gram, t, name, n, len(g), int(len(g) * (2 - threshold) / threshold + 1e-9))
             for t, (name, g) in enumerate(known) for gram, n in Counter(g).items()]
    grams = docs.sparkSession.createDataFrame(
        table, "_gram string, _t int, license string, _times int, _size int, _most int").coalesce(1)
    anchors = sorted(set().union(*(_anchors(g, threshold) for _, g in known)))
    rare = F.array(*map(F.lit, sorted({max(a.split(), key=len) for a in anchors})))
    text = F.trim(F.regexp_replace(F.lower("_text"), r"[^\p{L}\p{N}]+", " "))

    def anchored(t):
        any_of = F.lit(False)
        for a in anchors:
            any_of = any_of | F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(f" {a} "))
        return F.arrays_overlap(F.split(t, " "), rare) & any_of

    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(
        F.col("_text").isNotNull() & F.exists(F.array(text), anchored))
    rows = some.groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.sha2(F.concat(
        F.sha2("_text", 256), F.col("_id").isNull().cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256))
    rows = written(rows, "passages")  # read twice below
    pairs = F.flatten(F.transform(F.array(F.split(text, " ")), lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))))
    hits = rows.select("_key", "_id", "_n", F.posexplode(pairs).alias("_at", "_gram")).join(F.broadcast(grams), "_gram")
    same = Window.partitionBy("_key", "_t", "_gram").orderBy("_at")
    hits = hits.withColumn("_before", F.coalesce(*[  # the occurrence that must lie outside for this one to count
        F.when(F.col("_times") == n, F.lag("_at", n).over(same)) for n in sorted({x[3] for x in table})]))
    starts = hits.select("_key", "_id", "_n", "_t", "license", "_size", "_most", F.col("_at").alias("_from"),
                         F.explode(F.array(F.floor(F.col("_at") / F.col("_most")), F.floor(F.col("_at") / F.col("_most")) + 1)).alias("_band"))
    ends = hits.select("_key", "_t", F.col("_at").alias("_to"), "_before", F.floor(F.col("_at") / F.col("_most")).alias("_band"))
    windows = starts.join(ends, ["_key", "_t", "_band"]).where(
        (F.col("_to") >= F.col("_from")) & (F.col("_to") < F.col("_from") + F.col("_most"))
        & (F.col("_before").isNull() | (F.col("_before") < F.col("_from"))))
    windows = windows.withColumn("common", F.row_number().over(
        Window.partitionBy("_key", "_t", "_from").orderBy("_to")).cast("long")).withColumn(
        "bigrams", (F.col("_to") - F.col("_from") + 1).cast("long")).withColumn(
        "_dice", F.lit(2.0) * F.col("common") / (F.col("bigrams") + F.col("_size")))
    best = windows.where(F.col("_dice") >= threshold).groupBy("_key", "license").agg(
        F.min(F.struct((-F.col("_dice")).alias("order"), (-F.col("common")).alias("less"), "_from", "bigrams", "_id", "_n")).alias("_b"))
    return best.select(F.col("_b._id").alias(id_col), "license", F.round(-F.col("_b.order"), 4).alias("dice"),
                       (F.col("_b._from") + 1).cast("long").alias("start"), F.col("_b.bigrams").alias("bigrams"),
                       (-F.col("_b.less")).alias("common"), F.explode(F.sequence(F.lit(1), F.col("_b._n"))).alias("_copy")).drop("_copy")


def query(spark, sf_dir):
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
