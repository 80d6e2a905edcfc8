"""Licence scans: normalised text against licence templates by Dice coefficient.

A document's units are its sentences, lines and paragraphs.  Unit and template are
compared as sets of word bigrams A and B by 2 |A n B| / (|A| + |B|).  A coefficient of
t needs |A| between t / (2 - t) |B| and (2 - t) / t |B|, so a unit's size leaves few
candidate templates, and it needs a share of the template's bigrams, so every match
holds one of a few word lists: documents and units without any are not looked at.

A notice among other words of its sentence is found by windows: neighbouring bigrams
within the same size bounds, the first and the last of them in the template.  As it is
the best of many, a window's coefficient is to be above t.  Of windows that overlap the
best one counts, and none that a matching unit has counted already.

Everything is one expression of built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least coefficient of a match.
LEAST = Fraction(4, 5)

#: (licence, wording): notices, identifiers and the sentences of common licence texts (fixed values).
#: A sentence that several licences share has their family's name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-2.0", "Licensed under the Apache License 2.0."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Licensed under the BSD License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "under the terms of the BSD license"),
    ("bsd-2-clause", "Distributed under the BSD 2-Clause License."),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "Distributed under the BSD 3-Clause License."),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("cc-by-3.0", "Licensed under CC BY 3.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa-3.0", "Licensed under CC BY-SA 3.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("cc0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-2.0", "under GPLv2"),
    ("gpl-2.0", "under the GPLv2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("gpl-3.0", "under GPLv3"),
    ("gpl-3.0", "under the GPLv3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit", "MIT License (MIT)"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
)

#: Ends of sentences, lines and paragraphs.
_SENTENCE, _LINE, _PARAGRAPH = r"[.!?]\s+", r"\n", r"\n[ \t\r]*\n"
_NO_WORD = r"[^\p{L}\p{N}]+"


def template_bigrams(wording: str) -> list[str]:
    """The distinct word bigrams of a wording, in order."""
    words = re.sub(r"[\W_]+", " ", wording.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


#: Shorter words are parts of too many others to look for alone.
_LONG = 5


def required(wording: str, least: Fraction = LEAST) -> list[list[str]]:
    """Word lists of which one is present throughout in every match with a wording.

    A match has t |B| / (2 - t) of the wording's |B| bigrams or more.  Without any word
    of a set that occurs in more than the rest of them it cannot: one of the set is
    present.  Long words come first; where they do not suffice, what is left without
    them is either needed whole, or short words are added.
    """
    bigrams = [tuple(b.split()) for b in template_bigrams(wording)]
    needed = math.ceil(least * len(bigrams) / (2 - least))
    left, found = set(bigrams), []
    for word in sorted({w for b in bigrams for w in b}, key=lambda w: (-len(w), w)):
        if len(left) < needed:
            break
        if len(word) < _LONG and len(left) == needed:
            return [*found, sorted({w for b in left for w in b}, key=lambda w: (-len(w), w))]
        if any(word in b for b in left):
            left -= {b for b in left if word in b}
            found.append([word])
    return found


def conditions(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[list[str]]:
    """The word lists of all wordings, without those that follow from a shorter word."""
    every = {tuple(words) for _, wording in templates for words in required(wording)}
    single = {w[0] for w in every if len(w) == 1}
    single = {w for w in single if not any(o != w and o in w for o in single)}
    several = [w for w in every if len(w) > 1 and not any(o in x for x in w for o in single)]
    return sorted([w] for w in single) + sorted(map(list, several))


def _may_match(text: Column, lists: list[list[str]]) -> Column:
    found = F.lit(False)
    for words in lists:
        whole = F.lit(True)
        for word in words:
            whole = whole & F.contains(text, F.lit(word))
        found = found | whole
    return found


def _words(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, _NO_WORD, " "))


def _pairs(words: Column) -> Column:
    """All bigrams of normalised words, in order."""
    pair = lambda x: F.concat_ws(" ", F.get(x, F.lit(0)), F.get(x, F.lit(1)))
    neighbours = lambda w: F.transform(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b")), lambda z: F.when(z["b"].isNotNull(), pair(F.array(z["a"], z["b"]))))
    # transform over a one-element array names the words, so they are split once.
    return F.array_compact(F.get(F.transform(F.array(F.split(words, " ")), neighbours), F.lit(0)))


def _best(unit_bigrams: Column, table: Column) -> Column:
    """The best (dice, licence) of a unit among the templates whose size can match."""
    t, n = float(LEAST), F.size(unit_bigrams)
    sized = F.filter(table, lambda x: (n * (2 - t) + 1e-9 >= x["size"] * t) & (x["size"] * (2 - t) + 1e-9 >= n * t))
    dice = F.transform(sized, lambda x: F.struct((2.0 * F.size(F.array_intersect(unit_bigrams, x["bigrams"])) / (n + x["size"])).alias("dice"), x["licence"].alias("licence")))
    good = F.filter(dice, lambda x: x["dice"] >= t)
    # Of equal coefficients the licence first in the alphabet.
    return F.aggregate(good, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("licence")), lambda a, x: F.when((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["licence"] < a["licence"])), x).otherwise(a))


_WINDOWS = "array<struct<loss:double,licence:string,start:int,end:int,words:string>>"


def _windows(words: Column, pairs: Column, table: Column) -> Column:
    """The matching windows of a sentence's bigrams that overlap no better one."""
    t, n = float(LEAST), F.size(pairs)
    # A match has t / (2 - t) of the template's bigrams, wherever its window is.
    able = F.filter(table, lambda x: F.size(F.array_intersect(pairs, x["bigrams"])) * (2 - t) + 1e-9 >= x["size"] * t)

    def of(x: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_contains(x["bigrams"], F.get(pairs, i)))
        sized = lambda i, j: ((j - i + 1) * (2 - t) + 1e-9 >= x["size"] * t) & (x["size"] * (2 - t) + 1e-9 >= (j - i + 1) * t)
        spans = lambda h: F.flatten(F.transform(h, lambda i, at: F.transform(F.filter(F.slice(h, at + 1, x["size"] * 2), lambda j: sized(i, j)), lambda j: F.struct(i.alias("start"), (j + 1).alias("end")))))
        sets = F.transform(F.get(F.transform(F.array(hits), spans), F.lit(0)), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.array_distinct(F.slice(pairs, w["start"] + 1, w["end"] - w["start"])).alias("set")))
        scored = F.transform(sets, lambda w: F.struct((-2.0 * F.size(F.array_intersect(w["set"], x["bigrams"])) / (F.size(w["set"]) + x["size"])).alias("loss"), x["licence"].alias("licence"), w["start"].alias("start"), w["end"].alias("end")))
        return F.filter(scored, lambda w: w["loss"] < -t - 1e-9)

    ranked = F.array_sort(F.flatten(F.transform(able, of)))
    text = lambda w: F.array_join(F.slice(F.split(words, " "), w["start"] + 1, w["end"] - w["start"] + 1), " ")
    spelled = F.transform(ranked, lambda w: F.struct(w["loss"].alias("loss"), w["licence"].alias("licence"), w["start"].alias("start"), w["end"].alias("end"), text(w).alias("words")))
    return F.aggregate(spelled, F.array().cast(_WINDOWS), lambda kept, w: F.when(F.exists(kept, lambda k: (w["start"] <= k["end"]) & (k["start"] <= w["end"])), kept).otherwise(F.concat(kept, F.array(w))))


def _embedded(words: Column, whole: Column, table: Column) -> Column:
    """(dice, licence) of the windows of a sentence, without those of its matching units."""
    around = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    within = F.filter(whole, lambda m: F.contains(around(words), around(m["words"])))
    rest = F.aggregate(within, around(words), lambda left, m: F.replace(left, around(m["words"]), F.lit(" | ")))
    windows = F.get(F.transform(F.array(_pairs(words)), lambda p: _windows(words, p, table)), F.lit(0))
    new = F.filter(windows, lambda w: ~F.exists(within, lambda m: m["best"]["licence"] == w["licence"]) | F.contains(rest, around(w["words"])))
    return F.transform(new, lambda w: F.struct((-w["loss"]).alias("dice"), w["licence"].alias("licence")))


_NOTICES = "array<struct<dice:double,licence:string>>"


def notices(low: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """The best (dice, licence) of each unit of a lower-case text that matches a notice,
    and of each notice among other words of a sentence."""
    lists = conditions(templates)
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("bigrams")) for name, w in templates if (b := template_bigrams(w))])
    units = F.array_distinct(F.concat(F.split(low, _SENTENCE), F.split(low, _LINE), F.split(low, _PARAGRAPH)))
    worded = lambda parts: F.transform(F.filter(parts, lambda u: _may_match(u, lists)), _words)
    scored = F.transform(worded(units), lambda w: F.struct(F.get(F.transform(F.array(F.array_distinct(_pairs(w))), lambda b: _best(b, table)), F.lit(0)).alias("best"), w.alias("words")))
    whole = F.filter(scored, lambda m: m["best"]["dice"] > 0)
    sentences = worded(F.array_distinct(F.split(low, _SENTENCE)))
    both = lambda m: F.concat(F.transform(m, lambda x: x["best"]), F.flatten(F.transform(sentences, lambda w: _embedded(w, m, table))))
    return F.get(F.transform(F.array(whole), both), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, best_licence, best_dice, n_notices) of every row of `docs`.

    `licences` lists the distinct licences by name, separated by commas.  A text without
    a notice (a null or empty one too) has none: '', null, 0.0 and 0.  Repeated rows stay.
    """
    low = docs.select("doc_id", F.lower("text").alias("low"))
    # The cheap condition is a column of its own, so that it runs as generated code.
    flagged = low.select("doc_id", "low", F.coalesce(_may_match(F.col("low"), conditions()), F.lit(False)).alias("maybe"))
    found = flagged.select("doc_id", F.when(F.col("maybe"), notices(F.col("low"))).otherwise(F.array().cast(_NOTICES)).alias("found"))
    top = F.aggregate("found", F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("licence")), lambda a, x: F.when((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["licence"] < a["licence"])), x).otherwise(a))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.col("found.licence"))), ",").alias("licences"),
        F.nullif(top["licence"], F.lit("")).alias("best_licence"),
        F.round(top["dice"], 6).alias("best_dice"),
        F.size("found").alias("n_notices"),
    )


def oracle() -> str:
    """DuckDB SQL of `scan` over the table documents, windows included."""
    t = float(LEAST)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(b)})" for i, (name, w) in enumerate(TEMPLATES) for b in template_bigrams(w))
    return f"""
WITH RECURSIVE template(t, licence, bigram) AS (VALUES {rows}),
sizes AS (SELECT t, licence, count(*) AS size FROM template GROUP BY ALL),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, lower(text) AS low FROM documents),
units AS (
  SELECT DISTINCT r, unit FROM (
    SELECT r, unnest(regexp_split_to_array(low, '[.!?]\\s+')) AS unit FROM rows_
    UNION ALL SELECT r, unnest(regexp_split_to_array(low, '\\n')) FROM rows_
    UNION ALL SELECT r, unnest(regexp_split_to_array(low, '\\n[ \\t\\r]*\\n')) FROM rows_)
), worded AS (
  SELECT r, unit, string_split(trim(regexp_replace(unit, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units
), pairs AS (
  SELECT DISTINCT r, unit, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM worded
), unit_size AS (SELECT r, unit, count(*) AS n FROM pairs GROUP BY ALL),
shared AS (SELECT r, unit, t, count(*) AS both_ FROM pairs JOIN template USING (bigram) GROUP BY ALL),
scored AS (
  SELECT r, unit, licence, 2.0 * both_ / (n + size) AS dice
  FROM shared JOIN unit_size USING (r, unit) JOIN sizes USING (t)
), matched AS (
  SELECT r, unit, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence FROM scored WHERE dice >= {t} GROUP BY r, unit
), lists AS (SELECT t, licence, list(bigram) AS b, count(*) AS size FROM template GROUP BY t, licence
), sentence AS (
  SELECT DISTINCT r, unit FROM (SELECT r, unnest(regexp_split_to_array(low, '[.!?]\\s+')) AS unit FROM rows_)
), said AS (
  SELECT r, unit, array_to_string(w, ' ') AS words, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM sentence JOIN worded USING (r, unit)
), hit AS (
  SELECT r, unit, p, t, pos FROM (SELECT r, unit, p, unnest(p) AS bigram, generate_subscripts(p, 1) AS pos FROM said) JOIN template USING (bigram)
), span AS (
  SELECT a.r, a.unit, l.licence, l.size, l.b, a.pos AS lo, z.pos AS hi, list_distinct(a.p[a.pos : z.pos]) AS own
  FROM hit a JOIN hit z ON a.r = z.r AND a.unit = z.unit AND a.t = z.t AND z.pos >= a.pos JOIN lists l ON l.t = a.t
  WHERE (z.pos - a.pos + 1) * (2 - {t}) + 1e-9 >= l.size * {t} AND l.size * (2 - {t}) + 1e-9 >= (z.pos - a.pos + 1) * {t}
), judged AS (
  SELECT r, unit, licence, lo, hi, 2.0 * len(list_intersect(own, b)) / (len(own) + size) AS dice FROM span
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r, unit ORDER BY dice DESC, licence, lo, hi) AS k FROM judged WHERE dice > {t} + 1e-9
), walk AS (
  SELECT r, unit, 1::BIGINT AS k, [{{'lo': lo, 'hi': hi, 'licence': licence, 'dice': dice}}] AS kept FROM ranked WHERE k = 1
  UNION ALL SELECT w.r, w.unit, w.k + 1, CASE WHEN len(list_filter(w.kept, lambda x: x.lo <= c.hi + 1 AND c.lo <= x.hi + 1)) = 0
    THEN list_append(w.kept, {{'lo': c.lo, 'hi': c.hi, 'licence': c.licence, 'dice': c.dice}}) ELSE w.kept END
  FROM walk w JOIN ranked c ON c.r = w.r AND c.unit = w.unit AND c.k = w.k + 1
), windows AS (
  SELECT r, unit, unnest(arg_max(kept, k), recursive := true) FROM walk GROUP BY r, unit
), whole AS (
  SELECT m.r, m.licence, array_to_string(w, ' ') AS words FROM matched m JOIN worded USING (r, unit)
), held AS (
  SELECT s.r, s.unit, list(h.licence) AS licences, list(' ' || h.words || ' ' ORDER BY length(h.words) DESC) AS parts
  FROM said s JOIN whole h ON h.r = s.r AND contains(' ' || s.words || ' ', ' ' || h.words || ' ') GROUP BY s.r, s.unit
), left_over AS (
  SELECT s.r, s.unit, s.w, coalesce(h.licences, []) AS licences, list_reduce(list_prepend(' ' || s.words || ' ', coalesce(h.parts, [])), lambda text, part: replace(text, part, ' | ')) AS rest
  FROM said s LEFT JOIN held h ON h.r = s.r AND h.unit = s.unit
), embedded AS (
  SELECT x.r, x.dice, x.licence FROM windows x JOIN left_over o ON o.r = x.r AND o.unit = x.unit
  WHERE NOT list_contains(o.licences, x.licence) OR contains(o.rest, ' ' || array_to_string(o.w[x.lo : x.hi + 1], ' ') || ' ')
), every AS (SELECT r, dice, licence FROM matched UNION ALL SELECT r, dice, licence FROM embedded
), found AS (
  SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, arg_min(licence, (-dice, licence)) AS best_licence,
         max(dice) AS best_dice, count(*) AS n_notices
  FROM every GROUP BY r
)
SELECT doc_id, coalesce(licences, '') AS licences, best_licence, round(coalesce(best_dice, 0.0), 6)::DOUBLE AS best_dice, coalesce(n_notices, 0)::INTEGER AS n_notices
FROM rows_ LEFT JOIN found USING (r)
"""
