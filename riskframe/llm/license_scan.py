"""Licence statements and notices in documents by Dice coefficient over word bigrams; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Names of public licences, and the opening notices that their texts prescribe.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Unlicense", "Unlicense"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
)
STATEMENTS = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}",
              "This work is licensed under the {}", "This work is licensed under {}",
              "This program is free software released under the {}")
NOTICES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the "
                     "distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def templates() -> list[tuple[str, str]]:
    """(licence, text): every statement form for every name, and the notices."""
    return [(key, form.format(name)) for key, name in NAMES for form in STATEMENTS] + list(NOTICES)


def words_of(text: Column) -> Column:
    """Words of a normalised text: lower case, runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The set of neighbouring pairs of an array of words."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, pairs), F.slice(words, 2, pairs),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def _units(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, digest, scope, at, bigrams): every line, and every run of lines between blank lines that has several."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("scope"), i.alias("at"),
                                                                   x.alias("text")))
    blocks = F.filter(F.transform(F.split(text, "\n[ \t\r]*\n"), lambda x, i: F.struct(
        F.lit("block").alias("scope"), i.alias("at"), x.alias("text"))),
        lambda x: F.contains(F.trim(x["text"]), F.lit("\n")))
    return (documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"),
                             F.explode(F.concat(lines, blocks)).alias("unit"))
            .select("id", "digest", "unit.scope", "unit.at", words_of(F.col("unit.text")).alias("words"))
            .select("id", "digest", "scope", "at", bigrams(F.col("words")).alias("bigrams")))


def scan_licenses(documents: DataFrame, threshold: float = THRESHOLD, known: list[tuple[str, str]] | None = None,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, scope, at, license, dice): the nearest licence of every line or block with a Dice of threshold or more.

    Dice is 2 |A n B| / (|A| + |B|) over the sets of word bigrams. It can reach t only if the smaller set has at least
    t / (2 - t) of the larger one's size, so units and templates outside those bounds never meet. at counts lines, or
    blocks between blank lines, from 0. Ties go to the licence first in order. Null and empty texts and texts of one
    word have no bigrams and give no rows; rows equal in id and text give their rows once. The templates are a stated
    set; their bigrams are sent to all tasks.
    """
    spark = documents.sparkSession
    known = templates() if known is None else known
    ratio = threshold / (2 - threshold)
    stated = F.array(*[F.struct(F.lit(i).alias("form"), F.lit(k).alias("license"), F.lit(t).alias("text"))
                       for i, (k, t) in enumerate(known)])
    forms = (spark.range(1).select(F.inline(stated))
             .select("form", "license", words_of(F.col("text")).alias("words"))
             .select("form", "license", bigrams(F.col("words")).alias("set"))
             .select("form", "license", F.size("set").alias("form_size"), F.explode("set").alias("bigram")))
    bounds = forms.agg(F.min("form_size"), F.max("form_size")).first()
    size = F.size("bigrams")
    units = (_units(documents, id_col, text)
             .where((size >= F.lit(ratio * (bounds[0] or 1))) & (size * ratio <= F.lit(float(bounds[1] or 0))))
             .select("id", "digest", "scope", "at", size.alias("size"), F.explode("bigrams").alias("bigram")))
    met = units.join(F.broadcast(forms), (units["bigram"] == forms["bigram"])
                     & (F.col("size") * ratio <= F.col("form_size")) & (F.col("form_size") * ratio <= F.col("size")))
    common = (met.groupBy("id", "digest", "scope", "at", "size", "form", "license", "form_size")
              .agg(F.count_distinct(units["bigram"]).alias("common")))
    dice = (2 * F.col("common") / (F.col("size") + F.col("form_size"))).alias("dice")
    return (common.select("id", "digest", "scope", "at", "license", dice).where(F.col("dice") >= threshold)
            .groupBy("id", "digest", "scope", "at")
            .agg(F.max("dice").alias("dice"), F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"))
            .select(F.col("id").alias(id_col), "scope", "at", "license", "dice"))
