"""License scans on the notices as they are published, wrapped and behind comment marks."""

import re
import textwrap

import pytest

from barlight.llm import licenses as L

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain."

TEXTS = [
    (APACHE, ["Apache-2.0"]), (GPL, ["GPL-3.0-or-later"]), (GPL.replace("version 3", "version 2").replace("software:", "software;"), ["GPL-2.0-or-later"]),
    (BSD2, ["BSD-2-Clause"]), (BSD3.format("copyright holder"), ["BSD-3-Clause"]), (BSD3.format("Regents of the University of Somewhere"), ["BSD-3-Clause"]),
    (MIT, ["MIT"]), (f"MIT License\n\nCopyright (c) 2024 Somebody\n\n{MIT}", ["MIT"]), (ISC, ["ISC"]), (UNLICENSE, ["Unlicense"]), (f"{MIT}\n\n{APACHE}", ["MIT", "Apache-2.0"]),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]), ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", ["BSD-3-Clause"]), ("Some prose. Released under the MIT License.", ["MIT"]),
    ("The MIT License is short.", []), ("Nothing is licensed under the Apache License, Version 2.0 here", []), ("We spoke about the MIT License.\nMIT License", []), ("", []), (None, []),
]


def wrapped(text, mark, width):
    return "\n".join(f"{mark}{line}" for block in text.split("\n\n") for line in [*textwrap.wrap(block, width), ""])


def licenses(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in sorted(L.scanned(df).collect(), key=lambda r: r["row"].doc_id)]


def test_as_published(spark):
    assert licenses(spark, [t for t, _ in TEXTS]) == [x for _, x in TEXTS]


@pytest.mark.parametrize("mark", ["# ", " * ", "// ", "-- ", "", "\t; "])
@pytest.mark.parametrize("width", [30, 70, 1000])
def test_wrapped_and_commented(spark, mark, width):
    assert licenses(spark, [wrapped(t, mark, width) for t, _ in TEXTS[:11]]) == [x for _, x in TEXTS[:11]]


def test_every_sentence_has_a_hint_in_one_piece():
    assert all(re.search(L.HINT, v) for v in L.SENTENCES.values())
    assert all(i in L.SENTENCES for _, _, seq in L.RULES for i in seq)


def test_odd_rows(spark):
    rows = [(1, MIT, "r", 1), (1, MIT, "r", 1), (None, "word " * 200_000 + "\n" + UNLICENSE, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, licenses long")
    got = L.scanned(df)
    assert sorted(r.licenses for r in got.collect()) == [["MIT"], ["MIT"], ["Unlicense"]] and got.select("row.*").columns == df.columns and L.scanned(df.where("false")).count() == 0


@pytest.mark.parametrize("filler", ["\n", ". ", "/", " / ", "! \n", "a. ", "license / ", "\t \n"])
def test_long_runs_of_breaks(spark, filler):
    texts = [filler * 1_000_000 + "\nReleased under the MIT License.", "Released under the MIT License.\n" + filler * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = L.scanned(spark.createDataFrame([(0, "x. Released under the MIT License.")], "doc_id long, text string")).first().licenses
    assert [r.licenses for r in L.scanned(df).orderBy("row.doc_id").collect()] == [want, want] and want
