from __future__ import annotations

from tradeloom.llm import licenses

APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\");\n"
    "you may not use this file except in compliance with the License.\n"
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
)


def scanned(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, identifiers int, licenses string")
    return [(r.doc_id, list(r.identifiers), list(r.licenses), r.unmatched) for r in licenses.scan(df).collect()]


def test_rules_in_order(spark):
    rows = [
        (1, APACHE),
        (2, "Some words.\nReleased under the MIT License.\nMore. LICENSED under CC BY-NC 4.0.\nReleased under the MIT License."),
        (3, "This work is licensed under the\ngnu general public license, version 3. And so on."),
        (4, "Permission: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. All rights reserved."),
        (5, "I read about the MIT License once. Released under the MIT License of old."),
        (6, "a " * 60_000 + ". Released under the MIT License. " + "b " * 60_000),
    ]
    assert scanned(spark, rows) == [
        (1, ["ApacheNotice2", "ApacheCompliance", "ApacheCopy"], ["Apache-2.0"], 0),
        (2, ["MitNotice", "CcByNc4", "MitNotice"], ["MIT", "CC-BY-NC-4.0"], 0),
        (3, ["Gpl3Notice"], ["GPL-3.0-only"], 0),
        (4, ["MitInclude", "AllRights"], ["Proprietary"], 1),
        (5, [], [], 0),
        (6, ["MitNotice"], ["MIT"], 0),
    ]


def test_spent_sentences_are_not_matched_again(spark):
    known = {"a": "A", "b": "B", "c": "C"}
    rules = [("AB", ("A", "B")), ("AC", ("A", "C")), ("B", ("B",))]
    df = spark.createDataFrame([(1, "a. a. b. c."), (2, "a. b. a. b. b."), (3, "a. c. b.")], "doc_id bigint, text string")
    got = {r.doc_id: (list(r.licenses), r.unmatched) for r in licenses.scan(df, known=known, rules=rules).collect()}
    assert got == {1: (["AB"], 2), 2: (["AB", "B"], 0), 3: (["AC", "B"], 0)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n.;!"), (None, "Released under the MIT License."), (4, "All rights reserved"), (4, "All rights reserved")]
    assert scanned(spark, rows) == [
        (1, [], [], 0), (2, [], [], 0), (3, [], [], 0), (None, ["MitNotice"], ["MIT"], 0),
        (4, ["AllRights"], ["Proprietary"], 0), (4, ["AllRights"], ["Proprietary"], 0),
    ]
    assert scanned(spark, rows[:1]) and licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")


def test_official_texts(spark):
    texts = {
        "MIT": [MIT, MIT.replace("KIND, EXPRESS OR\nIMPLIED", "KIND,\nEXPRESS OR IMPLIED")],
        "BSD-2-Clause": [BSD2],
        "BSD-3-Clause": [BSD3],
        "MPL-2.0": [MPL, MPL.replace("\n", " "), MPL.replace("\n", " ").split(" If")[0]],
        "GPL-3.0-or-later": [GPL3, GPL3.replace("\n", " "), GPL3.split("\n\n")[0], GPL3.replace(", either", "; either")],
        "GPL-2.0-or-later": [GPL2, GPL2.replace("\n", " "), GPL2.split("\n\n")[0], GPL2.replace("; either", ", either")],
    }
    rows = [(name, f"Copyright 2020 A\n\n{text}") for name, some in texts.items() for text in some]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert [(r.doc_id, list(r.licenses), r.unmatched) for r in licenses.scan(df).collect()] == [(name, [name], 0) for name, _ in rows]
