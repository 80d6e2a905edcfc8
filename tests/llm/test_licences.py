import random

import duckdb
import pytest

from verdigris.llm import licences


def dice(a, b):
    a, b = set(licences.template_bigrams(a)), set(licences.template_bigrams(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


TEXTS = [
    "Some prose.\nReleased under the MIT License.\nMore prose.",
    "LICENSED under CC  BY-NC 4.0!",
    "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.",
    "Licensed under the Apache License Version 2.0 now",
    "under the license of nothing at all we rest. Licensed cars are here.",
    "licensed under cc by 4 0",
    "",
    None,
    "cc by nc 4 0 " * 3,
    "word " * 5000 + "\n\nAll rights reserved.\n\n" + "word " * 5000,
]


def brute(text):
    import re

    low = (text or "").lower()
    units = {u for p in (licences._SENTENCE, licences._LINE, licences._PARAGRAPH) for u in re.split(p, low)}
    best = []
    for unit in units:
        score = max((dice(unit, w), [-ord(c) for c in name], name) for name, w in licences.TEMPLATES)
        if score[0] >= 0.8:
            best.append((score[0], score[2]))
    return ",".join(sorted({n for _, n in best})), round(max([0.0, *(d for d, _ in best)]), 6), len(best)


def test_matches_brute_force_and_sql(spark, documents):
    docs = documents(*TEXTS, TEXTS[0]).withColumnRenamed("lang", "found")
    rows = licences.scan(docs).orderBy("doc_id").collect()
    assert [(r.licences, r.best_dice, r.n_notices) for r in rows] == [brute(t) for t in [*TEXTS, TEXTS[0]]]
    assert rows[0].licences == "mit" and rows[1].licences == "cc-by-nc-4.0" and rows[6].best_licence is None
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toPandas())
    columns = ["doc_id", "licences", "best_licence", "best_dice", "n_notices"]
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({licences.oracle()}) ORDER BY doc_id").fetchall()
    assert [tuple(r[c] for c in columns) for r in rows] == want
    assert licences.scan(docs.limit(0)).count() == 0


def test_embedded_notices_match_sql(spark, documents):
    """Wordings, parts of them and wordings with another word, among other words."""
    r = random.Random(2)
    wordings = [w.split() for _, w in licences.TEMPLATES]

    def text():
        out = ""
        for _ in range(r.randrange(1, 5)):
            w = list(r.choice(wordings))
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w = w[at : at + r.randrange(2, 30)]
            if r.random() < 0.4 and len(w) > 3:
                w[r.randrange(len(w))] = "xyz"
            out += " ".join(["some", "words"] * r.randrange(2) + w + ["after", "that"] * r.randrange(2)) + r.choice([". ", "\n", "\n\n", ", ", " "])
        return out

    docs = documents(*[text() for _ in range(150)], "... is licensed under the mit license and nobody")
    columns = ["doc_id", "licences", "best_licence", "best_dice", "n_notices"]
    got = [tuple(row[c] for c in columns) for row in licences.scan(docs).orderBy("doc_id").collect()]
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toPandas())
    assert got == c.sql(f"SELECT {', '.join(columns)} FROM ({licences.oracle()}) ORDER BY doc_id").fetchall()
    assert sum(row[4] for row in got) > 100


@pytest.mark.parametrize("name, wording", licences.TEMPLATES)
def test_required_words_miss_no_match(name, wording):
    """Whatever share of a wording's bigrams a match lacks, one word list is left."""
    bigrams = licences.template_bigrams(wording)
    lists = licences.required(wording)
    needed = -(-2 * len(bigrams) // 3)
    for start in range(len(bigrams) - needed + 1):
        words = {w for b in bigrams[start : start + needed] for w in b.split()}
        assert any(all(w in words for w in one) for one in lists)


def test_the_plan_is_native(spark, documents):
    plan = licences.scan(documents("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


@pytest.mark.parametrize(
    "text, want, n",
    [
        ("This project is licensed under the MIT License.", "mit", 1),
        ("This file is released under the MIT License.", "mit", 1),
        ("Copyright 2021 Acme Corp, all rights reserved.", "all-rights-reserved", 1),
        ("the whole of this little program, said he, is released\nunder the MIT License and nothing else in the world", "mit", 1),
        ("You may take it as licensed under the MIT License or, if you like that more, as licensed under the Apache License, Version 2.0, whichever it is", "apache-2.0,mit", 2),
        ("some prose about it\nReleased under the MIT License.\nand this other part is licensed under the MIT License too", "mit", 2),
        ("all of this is, they say, work licensed under the GNU General Public License, version 3, as is what follows below", "gpl-3.0", 1),
        ("Licensed under the Apache License 2.0", "apache-2.0", 1),
        ("// SPDX-License-Identifier: MIT", "mit", 1),
        ("# SPDX-License-Identifier: GPL-2.0-or-later and more", "gpl-2.0", 1),
        ("Licensed under CC BY-SA 3.0.", "cc-by-sa-3.0", 1),
        ("Distributed under the BSD 3-Clause License.", "bsd-3-clause", 1),
        ("You may use this file under the terms of the BSD license as follows:", "bsd", 1),
        ("This project is under GPLv3.", "gpl-3.0", 1),
        ("Licence: MIT License (MIT)", "mit", 1),
        ("all rights of way were reserved by the county, under the license of 1980", "", 0),
    ],
)
def test_notice_within_a_longer_sentence(spark, documents, text, want, n):
    row = licences.scan(documents(text)).first()
    assert (row.licences, row.n_notices) == (want, n)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Copyright (c) 2020 Acme\n\n" + MIT, "mit"),
        (GPL2, "gpl,gpl-2.0"),
        (GPL2.replace("version 2", "version 3").replace("software;", "software:").replace("Foundation;", "Foundation,"), "gpl,gpl-3.0"),
        (GPL2.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1"), "gpl,lgpl-2.1"),
        (GPL2.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), "agpl-3.0,gpl"),
        (GPL2.replace("GNU General", "GNU Lesser General").replace("version 2", "version 3"), "gpl,lgpl-3.0"),
        (BSD3, "bsd,bsd-3-clause"),
        (ISC, "isc"),
        (APACHE, "apache-2.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
    ],
)
def test_real_wordings_and_their_versions(spark, documents, text, want):
    rows = licences.scan(documents(text, "Some words before.\n\n" + text.upper() + "\n\nAnd after.")).collect()
    assert [r.licences for r in rows] == [want, want]
