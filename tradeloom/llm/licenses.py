"""Licence recognition by sentences and ordered rules, by functions of Spark alone.

A text is cut into sentences, each is normalised to lower-case words, and known
sentences are mapped to identifiers. The sequence of identifiers is then matched
against rules in their order; a rule is a run of identifiers. What a rule has
matched is spent, so a later, more general rule does not match it again.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.shared import BLANK

# Normalised sentences of public licence texts and notices, and the rules over them.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "ApacheNotice2",
    "licensed under the apache license version 2 0 the license": "ApacheNotice2",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitNotice",
    "licensed under the mit license": "MitNotice",
    "this software is released under the mit license": "MitNotice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitInclude",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "this program is licensed under the gnu general public license version 3": "Gpl3Notice",
    "this work is licensed under the gnu general public license version 2": "Gpl2Notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2OrLater",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "at your option any later version": "GplLater",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Notice",
    "this source code form is subject to the terms of the mozilla public license v": "Mpl2Notice",
    "this source code form is subject to the terms of the mozilla public": "Mpl2Notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "Mpl2Copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "Mpl2Copy",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nd 4 0": "CcByNd4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
}
# Real notices are cut within: the GPL's at its colon or semicolons and before "(at", capitals at each line break.
_TERMS = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
for _version in ("3", "2"):
    _either = f"either version {_version} of the license or"
    SENTENCES |= {
        f"{_TERMS} {_either} at your option any later version": f"Gpl{_version}OrLater",
        f"{_TERMS} {_either}": f"Gpl{_version}Or",
        f"{_either} at your option any later version": f"GplVersion{_version}OrLater",
        f"{_either}": f"GplVersion{_version}",
    }
_AS_IS = "the software is provided as is without warranty of any kind express or implied".split()
SENTENCES |= {" ".join(_AS_IS[:n]): "MitAsIs" for n in range(6, len(_AS_IS) + 1)}


def _or_later(version: str) -> list[tuple[str, tuple[str, ...]]]:
    """Rules for the notice of a GPL version, longest first."""
    terms = (
        (f"Gpl{version}OrLater",),
        (f"Gpl{version}Or", "GplLater"),
        ("GplTerms", f"GplVersion{version}OrLater"),
        ("GplTerms", f"GplVersion{version}", "GplLater"),
    )
    ends = ((("GplFree",), ("GplReceived",)), ((), ("GplReceived",)), (("GplFree",), ()), ((), ()))
    return [(f"GPL-{version}.0-or-later", (*first, *run, *last)) for first, last in ends for run in terms]


RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("ApacheNotice2", "ApacheCompliance", "ApacheCopy", "ApacheSee")),
    ("Apache-2.0", ("ApacheNotice2", "ApacheCompliance", "ApacheCopy")),
    ("Apache-2.0", ("ApacheNotice2", "ApacheCompliance")),
    ("Apache-2.0", ("ApacheNotice2",)),
    ("MIT", ("MitNotice", "MitGrant", "MitInclude", "MitAsIs")),
    ("MIT", ("MitGrant", "MitInclude", "MitAsIs")),
    ("MIT", ("MitNotice", "MitInclude", "MitAsIs")),
    ("MIT", ("MitInclude", "MitAsIs")),
    ("MIT", ("MitNotice",)),
    ("ISC", ("IscGrant",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    *_or_later("3"),
    *_or_later("2"),
    ("GPL-3.0-only", ("Gpl3Notice",)),
    ("GPL-2.0-only", ("Gpl2Notice",)),
    ("LGPL-3.0-only", ("Lgpl3Notice",)),
    ("MPL-2.0", ("Mpl2Notice", "Mpl2Copy")),
    ("MPL-2.0", ("Mpl2Notice",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("Unlicense", ("Unlicense",)),
    ("Proprietary", ("AllRights",)),
]

CUT = "\x01"
# Ends of sentences: an end mark before a blank, an empty line, and a line that does not go on in lower case.
ENDS = (rf"([.!?;:]){BLANK}+", rf"\n{BLANK}*\n", rf"\n({BLANK}*[^a-z\x20\x09-\x0D])")
STARTS = (f"$1{CUT}", CUT, f"{CUT}$1")


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order; those without a letter or digit are left out."""
    whole = text
    for end, start in zip(ENDS, STARTS, strict=True):
        whole = F.regexp_replace(whole, end, start)
    lower = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(lower, f"[^a-z0-9{CUT}]+", " ")
    return F.filter(F.transform(F.split(words, CUT), lambda one: F.trim(one)), lambda one: one != "")


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; sentences in between are passed over."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    found = F.transform(sentences(text), lambda sentence: F.element_at(table, sentence))
    return F.filter(found, lambda one: one.isNotNull())


def scan(
    df: DataFrame,
    *,
    known: dict[str, str] = SENTENCES,
    rules: list[tuple[str, tuple[str, ...]]] = RULES,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, identifiers array, licenses array, unmatched int) of every row.

    ``licenses`` names each licence once, in the order of the rules that matched;
    ``unmatched`` counts identifiers no rule has spent. Null, empty and
    licence-free texts have empty arrays. Repeated rows and null keys are kept.
    """
    listed = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(_run(run)).alias("run")) for name, run in rules]
    )
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = rows.select("key", identifiers(F.col("text"), known).alias("identifiers"))

    def match(held: Column, rule: Column) -> Column:
        # The bar keeps what stood before and after a spent run from forming a new run.
        spent = F.struct(
            F.replace(held["left"], rule["run"], F.lit("|")).alias("left"),
            F.array_append(held["names"], rule["name"]).alias("names"),
        )
        return F.when(F.position(rule["run"], held["left"]) > 0, spent).otherwise(held)

    sequence = F.concat_ws("", F.transform("identifiers", lambda one: F.concat(F.lit("<"), one, F.lit(">"))))
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))
    matched = F.when(F.size("identifiers") > 0, F.aggregate(listed, start, match)).otherwise(start)
    return named.select("key", "identifiers", matched.alias("matched")).select(
        F.col("key").alias(key),
        "identifiers",
        F.array_distinct("matched.names").alias("licenses"),
        F.length(F.regexp_replace("matched.left", "[^<]", "")).alias("unmatched"),
    )


def _run(names: tuple[str, ...]) -> str:
    return "".join(f"<{name}>" for name in names)
