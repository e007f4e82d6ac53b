"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences (at line ends and at '.', '!' or '?' before white space or the end), a sentence is
normalised (lower case, everything but a-z and 0-9 to single spaces) and looked up in the table of known sentences.
A known sentence may also run over line ends, with or without comment marks and empty lines at them: it has to begin after
a break and to end before one, and of several that begin at one place the longest counts.  ``n_sentences`` counts the
pieces between breaks.
What is left is the row's sequence of known identifiers with the number of unknown sentences in front of each; more than
``MOST_BETWEEN`` of these between two sentences part them.  From its start, the first rule of the ordered rules whose identifiers come next in that sequence is a match and its sentences are
used up; where no rule matches, one identifier is passed.  All of it happens within a row: no shuffle, no state.  The tables of sentences and rules are
literals of fixed size.

Cases: null and empty texts have no sentences and no match; texts of any length are scanned whole; repeated rows and
null ``doc_id`` give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences as they stand in licence texts and notices; their place, from 1, is their identifier.
SENTENCES = (
    "Released under the MIT License.",
    "Licensed under the MIT License.",
    "This project is licensed under the terms of the MIT license.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "See the License for the specific language governing permissions and limitations under the License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY 4.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "This is free and unencumbered software released into the public domain.",
    "All rights reserved.",
)

# Rules in the order in which they are tried, longer ones first; numbers are identifiers of SENTENCES.
RULES = (
    ("Apache-2.0", (7, 8, 9)),
    ("GPL-3.0-or-later", (12, 13, 14)),
    ("MIT", (4, 5)),
    ("BSD-3-Clause", (25, 26)),
    ("Apache-2.0", (7, 8)),
    ("MPL-2.0", (28, 29)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (3,)),
    ("MIT", (4,)),
    ("Apache-2.0", (6,)),
    ("Apache-2.0", (7,)),
    ("GPL-3.0-only", (10,)),
    ("GPL-2.0-only", (11,)),
    ("GPL-3.0-or-later", (12,)),
    ("LGPL-3.0-only", (15,)),
    ("AGPL-3.0-only", (16,)),
    ("CC-BY-NC-4.0", (17,)),
    ("CC-BY-4.0", (18,)),
    ("CC-BY-SA-4.0", (19,)),
    ("CC-BY-NC-SA-4.0", (20,)),
    ("CC-BY-ND-4.0", (21,)),
    ("CC-BY-4.0", (22,)),
    ("CC-BY-SA-4.0", (23,)),
    ("CC-BY-NC-4.0", (24,)),
    ("BSD-2-Clause", (25,)),
    ("ISC", (27,)),
    ("MPL-2.0", (28,)),
    ("Unlicense", (30,)),
    ("all-rights-reserved", (31,)),
)

# Known sentences and rules of ``scan`` only, numbered and tried after those that the SQL shares.
FURTHER_SENTENCES = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "Apache License",
    "Version 2.0, January 2004",
    "Licensed under the MIT license (see LICENSE)",
    "Licensed under the BSD License.",
    "The MIT License (MIT)",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Mozilla Public License Version 2.0",
    "GNU GENERAL PUBLIC LICENSE",
    "GNU LESSER GENERAL PUBLIC LICENSE",
    "GNU AFFERO GENERAL PUBLIC LICENSE",
    "Version 2, June 1991",
    "Version 2.1, February 1999",
    "Version 3, 29 June 2007",
    "Version 3, 19 November 2007",
)
FURTHER_RULES = (
    ("MPL-2.0", (28, 36)),
    ("GPL-2.0-or-later", (32,)),
    ("AGPL-3.0-or-later", (33,)),
    ("LGPL-2.1-or-later", (34,)),
    ("ISC", (35,)),
    ("GPL-2.0-only", (37,)),
    ("GPL-2.0-only", (38,)),
    ("Apache-2.0", (39, 40)),
    ("MIT", (41,)),
    ("BSD", (42,)),
    ("MIT", (43, 4, 5, 44)),
    ("MIT", (43, 4, 5)),
    ("MIT", (4, 5, 44)),
    ("BSD-3-Clause", (25, 45, 46, 26)),
    ("BSD-2-Clause", (25, 45, 46)),
    ("MPL-2.0", (47,)),
    ("GPL-2.0", (48, 51)),
    ("LGPL-2.1", (49, 52)),
    ("GPL-3.0", (48, 53)),
    ("LGPL-3.0", (49, 53)),
    ("AGPL-3.0", (50, 54)),
)

# Licences that a tag may name; each is a sentence and a rule of its own.
TAGGED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")
TAG = "SPDX-License-Identifier: "

#: Unknown sentences that may stand between two sentences of a rule.
MOST_BETWEEN = 10

BREAK = r"[.!?]+\s+|\n+|[.!?]+\z"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def normal(sentence: str) -> str:
    """SQL of a normalised sentence; the same in Spark and, with 'g' added, elsewhere."""
    return f"trim(regexp_replace(lower({sentence}), '[^a-z0-9]+', ' '))"


def known_sentences(sentences: tuple[str, ...] = SENTENCES) -> list[tuple[str, int]]:
    """Normalised known sentences and their identifiers.  A break inside one ends it there, as it does in a text."""
    import re

    out: dict[str, int] = {}
    for i, s in enumerate(sentences, 1):
        head = next(x for x in re.split(BREAK.replace(r"\z", r"\Z"), s) if x)
        out.setdefault(re.sub("[^a-z0-9]+", " ", head.lower()).strip(), i)
    return list(out.items())


def spans(text: Column, known: list[tuple[str, int]]) -> Column:
    """Known sentences of a text in their order, also those that run over line ends: normalised (s), and the unknown sentences in front (gap)."""
    # Lower case leaves capitals free as marks: S for the end of a sentence, L for line ends, K around a known sentence.
    marked = F.regexp_replace(F.lower(text), r"[.!?]+(?:\s+|\z)", "S")
    marked = F.regexp_replace(F.regexp_replace(marked, r"\n+", "L"), "[^a-z0-9SL]+", " ")
    one = "|".join(s.replace(" ", "[ L]+") for s, _ in sorted(known, key=lambda k: -len(k[0])))
    pieces = F.split(F.regexp_replace(marked, f"(^|[SL]) *({one})(?= *(?:[SL]|\\z))", "$1K$2K"), "K")  # gap, sentence, gap, sentence, ..., gap
    own = F.transform(pieces, lambda s, i: F.struct(F.regexp_replace(s, "[ L]+", " ").alias("s"), F.size(F.filter(F.split(F.get(pieces, i - 1), "[SL]"), lambda g: F.trim(g) != "")).alias("gap"), (i % 2 == 1).alias("known")))
    return F.filter(own, lambda x: x["known"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, known (identifiers), licences (in order of their place) of every row."""
    known = known_sentences(SENTENCES + FURTHER_SENTENCES + tuple(TAG + n for n in TAGGED))
    tags = tuple((n, (len(SENTENCES) + len(FURTHER_SENTENCES) + i,)) for i, n in enumerate(TAGGED, 1))
    place = "array_position(array(" + ", ".join(_quoted(s) for s, _ in known) + "), s.s)"
    number = "element_at(array(0, " + ", ".join(str(i) for _, i in known) + f"), cast({place} as int) + 1)"
    ordered = sorted(RULES + FURTHER_RULES + tags, key=lambda r: -len(r[1]))
    rules = "array(" + ", ".join(f"named_struct('licence', {_quoted(n)}, 'ids', array({', '.join(map(str, ids))}))" for n, ids in ordered) + ")"
    # The first rule that fits at p; where none does, null.
    fits = f"get(filter(rules, r -> slice(known, p, size(r.ids)) = r.ids and forall(slice(gaps, p + 1, size(r.ids) - 1), g -> g <= {MOST_BETWEEN})), 0)"
    found = f"transform(sequence(1, size(known)), p -> {fits})"
    # Where rules begin: the places that no rule before them has used up.
    starts = "aggregate(sequence(1, size(known)), named_struct('next', 1, 'at', cast(array() as array<int>)), (a, p) -> if(p < a.next or firsts[p - 1] is null, a, named_struct('next', p + size(firsts[p - 1].ids), 'at', concat(a.at, array(p)))), a -> a.at)"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(text, BREAK).alias("raw"), spans(text, known).alias("spans"))
    ids = cut.select("doc_id", F.expr("size(filter(raw, s -> trim(s) <> ''))").alias("n_sentences"), F.expr(f"transform(spans, s -> {number})").alias("known"), F.col("spans.gap").alias("gaps"))
    each = ids.withColumn("rules", F.expr(rules)).withColumn("firsts", F.when(F.size("known") > 0, F.expr(found)))
    done = each.withColumn("licences", F.when(F.size("known") > 0, F.expr(f"transform({starts}, p -> firsts[p - 1].licence)")).otherwise(F.array().cast("array<string>")))
    return done.select("doc_id", "n_sentences", F.size("known").alias("n_known"), "known", "licences")


def oracle() -> str:
    """The digest of ``scan`` as SQL for another engine: recursion over the sequence of known identifiers."""

    def sql(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    known = ", ".join(f"({sql(s)}, {i})" for s, i in known_sentences())
    rules = ", ".join(f"({k}, {sql(n)}, {list(ids)}::INT[])" for k, (n, ids) in enumerate(RULES))
    return f"""
        WITH RECURSIVE known(s, i) AS (VALUES {known}), rules(k, licence, ids) AS (VALUES {rules}),
        cut AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BREAK}'), lambda s: trim(s) <> '') AS sentences FROM documents),
        flat AS (SELECT doc_id, generate_subscripts(sentences, 1) AS place, unnest(sentences) AS s FROM cut),
        ids AS (SELECT doc_id, list(known.i::INT ORDER BY place) AS ids, list(place ORDER BY place) AS places FROM flat
                JOIN known ON known.s = trim(regexp_replace(lower(flat.s), '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
        walk AS (SELECT doc_id, ids, places, 1 AS p, '' AS found FROM ids
            UNION ALL
            SELECT w.doc_id, w.ids, w.places, w.p + coalesce(len(m.ids), 1), w.found || coalesce(',' || m.licence, '')
            FROM walk w LEFT JOIN LATERAL (SELECT r.licence, r.ids FROM rules r
                WHERE list_slice(w.ids, w.p, w.p + len(r.ids) - 1) = r.ids
                  AND len(list_filter(range(w.p + 1, w.p + len(r.ids)), lambda q: w.places[q] - w.places[q - 1] - 1 > {MOST_BETWEEN})) = 0 ORDER BY r.k LIMIT 1) m ON true
            WHERE w.p <= len(w.ids)),
        done AS (SELECT doc_id, len(ids) AS n, found FROM walk WHERE p > len(ids))
        SELECT c.doc_id, len(c.sentences)::INT AS n_sentences, coalesce(d.n, 0)::INT AS n_known,
               coalesce(substr(d.found, 2), '') AS licences
        FROM cut c LEFT JOIN done d USING (doc_id)
    """
