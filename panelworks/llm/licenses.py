"""Licence scans by sentence rules.

Texts are cut to parts at line feeds and at full stops and colons before white space. A run of parts
that reads as a known licence sentence, letters and digits only, becomes its identifier, so wrapped and
commented texts and one-line titles are found alike. Sentences are the known ones and what lies between
them, ended by full stops, colons, blank lines and short lines. A licence rule is an ordered sequence of
identifiers; it matches where they stand in a document in that order, at most GAP sentences between them.
Rules go in order of precedence, and a sentence serves one match only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = re.compile(r"(\n|(?<=[.:;])[ \t\r]+)")
_PLAIN = re.compile("[^a-z0-9]")
#: Words or numbers in front of a line or a sentence that are no part of it.
_FRONT = re.compile(r"\s*(?:(?:REM|dnl|@?rem)\s+)?[^A-Za-z0-9(]*(?:\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]\s+)?")
#: A shorter line is not taken for a wrapped one.
WRAP = 40
#: Every known sentence has one of these words in it.
_HINT = re.compile("licen|permission|software|redistribut|program|copyright|rights", re.I)

#: Sentences between two of a rule's identifiers at most.
GAP = 2

# Opening and grant sentences of public licences, as identifiers and their wording.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-notice": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "bync4-notice": "Licensed under CC BY-NC 4.0.",
    "by4-notice": "Licensed under CC BY 4.0.",
    "bysa4-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "reserved": "All rights reserved.",
}
# Other wordings of the same; * is a name.
WORDINGS = [
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-grant", "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0."),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mit-keep", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer."),
    ("bsd-endorse", "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-endorse", "Neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-endorse", "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission."),
]
# Licences as ordered sentence identifiers, in order of precedence.
# 'All rights reserved.' in the copyright notice of a licence belongs to it.
RULES = [
    ("BSD-3-Clause", ["reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["reserved", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["reserved", "apache-grant", "apache-copy", "apache-basis"]),
    ("MIT", ["mit-title", "reserved", "mit-grant", "mit-keep"]),
    ("MIT", ["reserved", "mit-grant", "mit-keep"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-basis"]),
    ("MIT", ["mit-title", "mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["bync4-notice"]),
    ("CC-BY-SA-4.0", ["bysa4-notice"]),
    ("CC-BY-4.0", ["by4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("LicenseRef-proprietary", ["reserved"]),
]


def normalised(sentence: str) -> str:
    """Lower-case letters and digits only."""
    return "".join(c for c in sentence.lower() if c.isascii() and c.isalnum())


_ALL = [*SENTENCES.items(), *WORDINGS]
_IDS = {normalised(text): name for name, text in _ALL if "*" not in text}
#: (words before a name, words after it, identifier)
_NAMED = [(*map(normalised, text.split("*")), name) for name, text in _ALL if "*" in text]
#: Letters and digits of a name at most.
_NAME = 100
#: All beginnings of known sentences.
_BEGIN = frozenset(plain[:n] for plain in [*_IDS, *(before for before, _, _ in _NAMED)] for n in range(1, len(plain) + 1))
_FIRST = frozenset(re.match("[a-z]+", _PLAIN.sub(" ", text.lower()))[0] for _, text in _ALL)
_STARTS = re.compile(rf"[\W_]*(?:{'|'.join(sorted(_FIRST))})\b", re.I)


def _named(plain: str) -> str | None:
    return next((name for before, after, name in _NAMED if plain.startswith(before) and plain.endswith(after) and len(before) + len(after) < len(plain) <= len(before) + len(after) + _NAME), None)


def _opens(plain: str) -> bool:
    """Whether more text can make it a known sentence."""
    return plain in _BEGIN or any(plain.startswith(before) and len(plain) < len(before) + len(after) + _NAME for before, after, _ in _NAMED)


def known_sentences(text: str) -> tuple[list[tuple[int, str]], int]:
    """(place, identifier) of the known sentences in order, and the number of all sentences."""
    cut = _END.split(text)
    parts, seps = cut[::2], [*cut[1::2], "\n"]
    hint = _HINT.search(text)
    found, place, within, i = [], 0, False, 0
    while i < len(parts):
        part, best = parts[i], None
        front = _FRONT.match(part).end() if hint else 0
        if hint and _STARTS.match(part, front):
            plain, j = _PLAIN.sub("", part[front:].lower()), i
            while True:
                if name := _IDS.get(plain) or _named(plain):
                    best = name, j
                j += 1
                if j == len(parts) or not _opens(plain):
                    break
                more = parts[j][_FRONT.match(parts[j]).end() if seps[j - 1] == "\n" and parts[j].lstrip()[:3].lower() in ("rem", "dnl") else 0 :]
                plain += _PLAIN.sub("", more.lower())
        if best:
            place += within
            found.append((place, best[0]))
            place, within, i = place + 1, False, best[1] + 1
            continue
        bare = part.strip(" \t\r*/#;%-")
        if not bare:  # a blank line
            place, within = place + within, False
        elif part.rstrip()[-1] in ".:" or seps[i] == "\n" and len(bare) < WRAP:
            place, within = place + 1, False
        else:
            within = True
        i += 1
    return found, max(1, place + within)


def match_rules(found: list[tuple[int, str]]) -> list[dict]:
    """Matches in (place, identifier) pairs sorted by place: by rule, then by place; no place twice.

    A rule is tried from each place of its first sentence and looks no farther than its gaps allow, so a text of very
    many sentences takes time in proportion.
    """
    places: dict[str, list[int]] = {}
    for at, (_, name) in enumerate(found):
        places.setdefault(name, []).append(at)
    gone, hits = [False] * len(found), []
    for license_id, ids in RULES:
        for first in places.get(ids[0], ()):
            if gone[first]:
                continue
            taken = [first]
            for at in range(first + 1, len(found) if len(ids) > 1 else 0):
                if len(taken) == len(ids) or found[at][0] - found[taken[-1]][0] > GAP + 1:
                    break
                if not gone[at] and found[at][1] == ids[len(taken)]:
                    taken.append(at)
            if len(taken) == len(ids):
                hits.append({"license": license_id, "sentences": [found[i][1] for i in taken], "first": found[first][0], "last": found[taken[-1]][0]})
                for i in taken:
                    gone[i] = True
    return sorted(hits, key=lambda h: (h["first"], h["license"]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, sizes = [], []
        for text in batch.column(1).to_pylist():
            found, n = known_sentences(text or "")
            hits.append(match_rules(found))
            sizes.append(n)
        kind = pa.list_(pa.struct([("license", pa.string()), ("sentences", pa.list_(pa.string())), ("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, kind), pa.array(sizes, pa.int32())], names=["doc_id", "hits", "n_sentences"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, hits, n_sentences) for every row of ``docs`` (doc_id, text).

    hits: array of (license, sentences, first, last) in the order of the text. Null and empty texts have
    none (and one empty sentence); null ids and repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hits = "array<struct<license: string, sentences: array<string>, first: int, last: int>>"
    return rows.mapInArrow(_scan, f"doc_id {kind}, hits {hits}, n_sentences int")
