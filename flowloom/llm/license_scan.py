"""Licence scan: Dice coefficient over word bigrams against licence templates, all in DataFrame functions.

A document is compared as a whole, line by line, and sentence by sentence. Texts are
normalised (A-Z in lower case, everything but letters and digits of ASCII one blank) and become
sets of word bigrams. Two sets of n and m bigrams with Dice >= t have
`m*t/(2-t) <= n <= m*(2-t)/t`, which prunes templates for a unit. Such a unit also shares more
than a certain number of the template's bigrams, so it holds a word of any selection that touches
enough of them; documents and units without one of these words are left out before bigrams are made.

Defined results: NULL, empty and one-word texts match nothing. A row per document and licence;
rows with one doc_id (NULL included) are one document. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and texts of public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
THRESHOLD = 0.8
#: Words too common to select documents by.
COMMON = set("the of and to in is a for that this with by or on as it be at any an are was not from no you can do all".split())


def _bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(m: int, t: float) -> tuple[int, int]:
    """The least and the greatest number of bigrams of a unit that can reach t with a template of m."""
    return math.ceil(m * t / (2 - t) - 1e-9), math.floor(m * (2 - t) / t + 1e-9)


def selecting_words(bigrams: list[str], t: float) -> set[str]:
    """Words of which every unit with Dice >= t holds one: they touch all but fewer bigrams than it must share."""
    m = len(bigrams)
    needed = m - math.ceil(t * (m + bounds(m, t)[0]) / 2 - 1e-9) + 1
    left, chosen = set(bigrams), set()
    while len(bigrams) - len(left) < needed:
        counts = Counter(w for b in left for w in set(b.split()))
        best = max(counts, key=lambda w: (w not in COMMON and len(w) > 2, counts[w], len(w), w))
        chosen.add(best)
        left = {b for b in left if best not in b.split()}
    return chosen


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`(doc_id, unit, license, shared, unit_bigrams, template_bigrams)` for each distinct unit of a document that matches."""
    sets = {k: _bigrams(v) for k, v in sorted(templates.items())}
    words = sorted(set().union(*(selecting_words(b, threshold) for b in sets.values())))
    held = F.col("low").rlike("|".join(words))
    known = F.array(*[
        F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("m"),
                 F.lit(bounds(len(b), threshold)[0]).alias("low"), F.lit(bounds(len(b), threshold)[1]).alias("high"))
        for k, b in sets.items()])
    texts = docs.select("doc_id", lowered(F.col("text")).alias("low")).where(held)
    sentences = F.regexp_replace("low", r"([.!?])\s+", "$1\n")
    units = texts.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.concat(F.array("low"), F.split("low", "\n"), F.split(sentences, "\n")),
        lambda u: F.trim(F.regexp_replace(u, "[^a-z0-9]+", " "))))).alias("low")).where(held)
    split = units.withColumn("w", F.split("low", " ")).where("size(w) >= 2")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1),
                                         lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))
    sized = split.select("doc_id", F.col("low").alias("unit"), pairs.alias("b"))
    n = F.size("b")
    met = sized.select("doc_id", "unit", "b", F.explode(F.filter(known, lambda t: n.between(t["low"], t["high"]))).alias("t"))
    shared = F.size(F.array_intersect("b", "t.bigrams"))
    found = met.select("doc_id", "unit", F.col("t.license").alias("license"), shared.alias("shared"),
                       n.alias("unit_bigrams"), F.col("t.m").alias("template_bigrams"))
    return found.where(2 * F.col("shared") >= threshold * (F.col("unit_bigrams") + F.col("template_bigrams")))


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`(doc_id, license, n_units, dice)`: the licences of each document and the best coefficient of its units."""
    dice = 2.0 * F.col("shared") / (F.col("unit_bigrams") + F.col("template_bigrams"))
    return matches(docs, templates, threshold).groupBy("doc_id", "license").agg(
        F.count_distinct("unit").alias("n_units"), F.max(dice).alias("dice"))


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{b}'" for b in _bigrams(v))) for k, v in templates.items())
    return f"""
with templates(license, bigrams) as (values {rows}),
texts as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
pieces as (
  select doc_id, unnest([low]) as u from texts union all
  select doc_id, unnest(string_split(low, chr(10))) from texts union all
  select doc_id, unnest(string_split(regexp_replace(low, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) from texts),
units as (select distinct doc_id, trim(regexp_replace(u, '[^a-z0-9]+', ' ', 'g')) as unit from pieces),
sets as (
  select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b
  from (select doc_id, unit, string_split(unit, ' ') as w from units) where len(w) >= 2),
scored as (
  select doc_id, unit, license, 2.0::double * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) as dice,
         len(list_intersect(b, bigrams)) as shared, len(b) + len(bigrams) as total
  from sets join templates on len(b) between len(bigrams) * {threshold} / (2 - {threshold}) - 1e-9
                                and len(bigrams) * (2 - {threshold}) / {threshold} + 1e-9)
select doc_id, license, count(distinct unit) as n_units, max(dice) as dice
from scored where 2 * shared >= {threshold} * total group by doc_id, license
"""
