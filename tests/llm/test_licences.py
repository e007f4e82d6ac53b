"""Notices, tags, titles and whole bodies that users meet, and what lies too far apart."""

import pytest

from quadrat.llm import licenses as L

GPL2 = "/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General\n * Public License as published by the Free Software Foundation; version 2 of the License.\n */\nint main;"
APACHE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS"
BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
)
NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
CASES = [
    (GPL2, ["GPL-2.0-only"]),
    (APACHE, ["Apache-2.0"]),
    ("# SPDX-License-Identifier: MIT\nimport os", ["MIT"]),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("Licensed under the MIT license (see LICENSE)", ["MIT"]),
    ("Licensed under the BSD License.", ["BSD"]),
    (f"{L.SENTENCES[24]}\n\nSome text.\n\n{NEITHER}", ["BSD-3-Clause"]),
    (f"{L.SENTENCES[24]}\n" + "".join(f"Unrelated line {i}.\n" for i in range(50)) + NEITHER, ["BSD-2-Clause"]),
    ("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + L.SENTENCES[3] + "\n\n" + L.SENTENCES[4] + "\n", ["MIT"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", ["GPL-3.0"]),
    ("We like the Apache License and version 2.0, January 2004 of it.", []),
    ("An SPDX-License-Identifier: MIT in running prose.", []),
    (("MIT License\n" * 3) + "Licensed under the MIT License.\n" * 200, ["MIT"] * 200),
]


def test_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in L.scan(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("name", L.TAGGED)
def test_every_tag_is_a_rule(spark, name):
    (row,) = L.scan(spark.createDataFrame([(1, f"x\n{L.TAG}{name}\ny")], "doc_id long, text string")).collect()
    assert row.licences == [name] and row.n_known == 1


def test_the_bound_between_sentences(spark):
    text = lambda n: L.SENTENCES[24] + "\n" + "".join(f"Line {i}.\n" for i in range(n)) + NEITHER
    docs = spark.createDataFrame([(n, text(n)) for n in (L.MOST_BETWEEN, L.MOST_BETWEEN + 1)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in L.scan(docs).collect()} == {L.MOST_BETWEEN: ["BSD-3-Clause"], L.MOST_BETWEEN + 1: ["BSD-2-Clause"]}
