r"""Licence scans by sentence rules, in DataFrame operations alone.

A text is normalised (lower-cased, every run of other characters than letters, digits and bytes
above ASCII made one space, ends of sentences and lines marked; so comment marks go with the spaces)
and known licence sentences are found between ends, also where they are wrapped over lines. A
document's ordered identifiers are then matched against the ordered rules: a rule holds when its
identifiers occur in its order, with or without others between them, unless a rule of another
licence that holds has them all and more. All of it happens within a row: no shuffle, and a sentence
that a third of all documents share costs nothing more.

A null or empty text has no sentences. Texts of any length are scanned whole, in one pass a pattern.
Rows that repeat are rows of their own; an empty table gives an empty result. Only doc_id and text are
read; further columns, of clashing names too, do not matter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a sentence ends: closing marks before white space, or a line break.
BOUNDARY = r"[.!?]+[\x09-\x0D\x20]+|[\x0A-\x0D]+"

# Sentences of public licences and licence notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc0-notice": "Released under CC0 1.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-title": "Apache License Version 2.0, January 2004",
    "mpl-title": "Mozilla Public License Version 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}

# Licences and the sentences that speak for them, in order.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice-kept", "mit-as-is")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Apache-2.0", ("apache-title",)),
    ("MPL-2.0", ("mpl-title",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-title",)),
]

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without H and S, which no lower-cased text holds and ``lines`` puts for ends.
NOT_WORD_OR_END = r"[\x00-\x2F\x3A-\x47\x49-\x52\x54-\x60\x7B-\x7F]+"


def normal_form(sentence: str) -> str:
    """The normal form of a known sentence, as ``sentence_ids`` computes it for texts."""
    return re.sub(NOT_WORD, " ", sentence.lower()).strip(" ")


def catalogue(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifier by normal form. A known sentence that holds a boundary is known by its parts."""
    out: dict[str, str] = {}
    for name, text in sentences.items():
        parts = [p for p in map(normal_form, re.split(BOUNDARY, text)) if p]
        for i, part in enumerate(parts):
            out[part] = name if len(parts) == 1 else f"{name}.{i + 1}"
    return out


def expanded(rules: list[tuple[str, tuple[str, ...]]], known: dict[str, str]) -> list[tuple[str, tuple[str, ...]]]:
    """Rules over the identifiers of parts."""
    names = set(known.values())
    parts = lambda s: [s] if s in names else sorted((n for n in names if n.rpartition(".")[0] == s), key=lambda n: int(n.rpartition(".")[2]))
    return [(licence, tuple(p for s in ids for p in parts(s))) for licence, ids in rules]


def lines(text: Column) -> Column:
    """Lower-cased words between spaces, with ``H`` where a sentence ends by its marks and ``S`` where only a line does.

    Marks before and within a line (those of comments too) go with the spaces. Every step is linear, in long runs as well.
    """
    text = F.lower(F.coalesce(text, F.lit("")))
    for pattern, put in ((r"[.!?][\x09-\x0D\x20]+", "H"), (r"[\x0A-\x0D]+", "S"), (NOT_WORD_OR_END, " "), (" ?S[ S]*", "S"), ("[ S]?H[ HS]*", "H")):
        text = F.regexp_replace(text, pattern, put)
    return F.concat(F.lit("S"), F.trim(text), F.lit("S"))


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """The ordered identifiers of a text's known sentences.

    A known sentence starts and ends where a sentence or line does; lines may end within it, sentences not.
    """
    forms = sorted(known, key=len, reverse=True)
    pattern = "[HS](?=(" + "|".join(f.replace(" ", "[ S]") for f in forms) + ")[HS])"
    # The longest at each place; shorter ones that end with a line of it are known sentences too.
    found = F.regexp_extract_all(lines(text), F.lit(pattern), F.lit(1))
    held = lambda s, f: (F.translate(F.substring(s, 1, len(f)), "S", " ") == f) & F.substring(s, len(f) + 1, 1).isin("", "S")
    names = lambda s: F.array_compact(F.array(*(F.when(held(s, f), F.lit(known[f])) for f in reversed(forms))))
    return F.flatten(F.transform(found, names))


def licence_matches(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """``doc_id, sentence_ids (array), licences (sorted array)`` of every document."""
    known = catalogue(sentences)
    rows = docs.select("doc_id", sentence_ids(F.col("text"), known).alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    meets = lambda ids: line.rlike(ordered_pattern(ids))
    parts = expanded(rules, known)
    # A rule gives way to those of other licences that ask for all it asks for and more.
    wider = lambda mine, ids: [i for other, i in parts if other != mine and len(i) > len(ids) and re.search(ordered_pattern(ids), f",{','.join(i)},")]
    held = [F.when(reduce(lambda a, b: a & ~b, map(meets, wider(licence, ids)), meets(ids)), F.lit(licence)) for licence, ids in parts]
    return rows.withColumn("licences", F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))))


def ordered_pattern(ids: tuple[str, ...]) -> str:
    """Matches ``,id,id,...,`` that hold the identifiers in this order."""
    return "," + ",(?:.*,)?".join(i.replace(".", "[.]") for i in ids) + ","
