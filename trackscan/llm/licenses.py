"""License scans by sentence rules (operator 7), in DataFrame functions only.

A text is normalised (ASCII lower case, anything but letters and digits to one space) with marks where a
sentence ends and where a line does; what stands before a line's first letter or digit, such as a comment's
prefix, goes. A web address ends a sentence, and one of the words that open known sentences begins one where it is
capitalised, so that titles and copyright lines without a full stop stand apart. Known licence sentences are found
between marks; a line end may fall inside them, a paragraph's end or punctuation only where the canonical text has
it. The identifiers of a text, in order, are matched against rules: ordered sequences of identifiers that follow
each other when unknown sentences are left out. Of rules that begin alike the longest applies, and each sentence
counts once. The SQL twin instead tries every known sentence at every mark.

Defined results: null and empty texts have no sentences and no licences; very long texts are scanned whole; a
sentence that repeats counts each time; the licences of a text are sorted, each once, whatever the order of rows;
equal rows have equal results; other columns aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence notices, normalised, by identifier (one character each).
SENTENCES = {
    "a": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "b": ["you may not use this file except in compliance with the license"],
    "c": ["you may obtain a copy of the license at"],
    "d": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "e": ["see the license for the specific language governing permissions and limitations under the license"],
    "f": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "g": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "h": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "i": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "j": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "k": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "l": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "m": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "n": ["you should have received a copy of the gnu general public license along with this program"],
    "o": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "p": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "q": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "r": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "s": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "t": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "u": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "v": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "w": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "x": ["all rights reserved"],
    "y": ["spdx license identifier mit"],
    "z": ["spdx license identifier apache 2 0"],
}
#: Licences and the identifier sequences that name them.
RULES = [
    ("Apache-2.0", "abcde"), ("Apache-2.0", "abc"), ("Apache-2.0", "a"), ("Apache-2.0", "z"),
    ("MIT", "ghi"), ("MIT", "gh"), ("MIT", "f"), ("MIT", "y"),
    ("GPL-3.0-or-later", "kmn"), ("GPL-3.0-or-later", "k"), ("GPL-2.0-or-later", "lmn"), ("GPL-2.0-or-later", "l"),
    ("GPL-3.0-only", "j"), ("CC-BY-NC-4.0", "o"), ("CC-BY-4.0", "p"), ("CC-BY-SA-4.0", "q"),
    ("BSD-3-Clause", "rstu"), ("BSD-2-Clause", "rst"), ("MPL-2.0", "v"), ("ISC", "w"), ("Proprietary", "x"),
]
#: Words that open known sentences and, capitalised, begin one.
OPENERS = (
    "Permission is hereby", "Permission to use", "Licensed under", "This work is licensed", "Redistribution and use", "Redistributions of source", "Redistributions in binary",
    "This program is", "You should have", "You may obtain", "Unless required", "See the License", "The above copyright", "Neither the name", "This Source Code Form", "All rights reserved",
)
ADDRESS = r"(?i)https?://[^\s]+"
#: Every known sentence holds one of these words: a text without them needs no cutting.
ANCHOR = "(?i)licen|permission|permitted|redistribut|copyright|rights reserved|free software|warrant|gnu general"
#: The same words where lines may end between them.
MET = ANCHOR.replace(" ", "[^a-z0-9]+")
#: Words of known sentences that the canonical text parts by one of . ! ? ; : and white space.
PARTED = ("identifier mit", "identifier apache", "license v 2", "software you", "foundation either", "warranty without")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _by_length() -> list[tuple[str, str]]:
    return sorted(RULES, key=lambda r: (-len(r[1]), r[1]))


def _marked(text: Column) -> Column:
    """A text normalised, with | where a sentence or paragraph ends and / where another line does."""
    own = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), ADDRESS, " . ")
    own = F.regexp_replace(F.translate(own, "|/", "  "), f"( )({'|'.join(OPENERS)})\\b", "|$2")
    own = F.concat(F.lit("|"), F.translate(own, UPPER, LOWER), F.lit("|"))
    for pattern, mark in (
        (r"[\r\n][^a-z0-9|\r\n]*+[\r\n][^a-z0-9]*+", "|"), (r"[\r\n]+[^a-z0-9|]*+", "/"), (r"[.!?;:]+(?=[ \t|/])", "|"),
        ("[^a-z0-9|/]+", " "), (r"[ /]*\|[ /|]*", "|"), (" */ *", "/"),
    ):
        own = F.regexp_replace(own, pattern, mark)
    return own


def _pattern() -> str:
    """The known sentences between marks, longest first."""
    found = []
    for s in sorted((s for group in SENTENCES.values() for s in group), key=lambda s: (-len(s), s)):
        for words in PARTED:
            head, last = words.rsplit(" ", 1)
            s = s.replace(words, f"{head}[ /|]{last}")
        found.append(re.sub(r" (?!/)", "[ /]", s))
    return f"(?<=[|/])({'|'.join(found)})(?=[|/])"


def sentences(text: Column) -> Column:
    """The known sentences of a text, normalised, in order."""
    return F.transform(F.regexp_extract_all(_marked(text), F.lit(_pattern()), F.lit(1)), lambda s: F.translate(s, "|/", "  "))


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, one character each, in order."""
    known = F.create_map(*[F.lit(x) for i, group in SENTENCES.items() for s in group for x in (s, i)])
    found = F.array_join(F.transform(sentences(text), lambda s: F.element_at(known, s)), "")
    return F.when(text.rlike(MET), found).otherwise(F.lit(""))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, identifiers (the sentences met), and licenses (array, sorted, each once) of each text.

    A regular expression of all rules, longest first, runs over the identifiers, so that each sentence
    is used by one rule.
    """
    each = docs.select(F.col(key), identifiers(F.col(text)).alias("identifiers"))
    rules = F.regexp_extract_all("identifiers", F.lit("(" + "|".join(seq for _, seq in _by_length()) + ")"), F.lit(1))
    names = F.create_map(*[F.lit(x) for name, seq in RULES for x in (seq, name)])
    licenses = F.when(F.col("identifiers") == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(rules, lambda r: F.element_at(names, r)))))
    return each.select(key, F.coalesce("identifiers", F.lit("")).alias("identifiers"), F.coalesce(licenses, F.array().cast("array<string>")).alias("licenses"))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "identifiers", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    variants = []
    for i, group in SENTENCES.items():
        for s in group:
            forms = [s]
            for words in PARTED:
                head, last = words.rsplit(" ", 1)
                forms += [f.replace(words, f"{head}|{last}") for f in forms if words in f]
            variants += [f"('{i}', '{f}')" for f in forms]
    names = "MAP {" + ", ".join(f"'{seq}': '{name}'" for name, seq in RULES) + "}"
    rules = "(" + "|".join(seq for _, seq in _by_length()) + ")"
    own = f"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '{ADDRESS}', ' . ', 'g')"
    own = f"regexp_replace(translate({own}, '|/', '  '), ' ({'|'.join(OPENERS)})\\b', '|\\1', 'g')"
    own = f"'|' || translate({own}, '{UPPER}', '{LOWER}') || '|'"
    for pattern, mark in (
        (r"[\r\n][^a-z0-9|\r\n]*[\r\n][^a-z0-9]*", "|"), (r"[\r\n]+[^a-z0-9|]*", "/"), (r"[.!?;:]+([ \t|/])", r"|\1"),
        ("[^a-z0-9|/]+", " "), (r"[ /]*\|[ /|]*", "|"), (" */ *", "/"),
    ):
        own = f"regexp_replace({own}, '{pattern}', '{mark}', 'g')"
    return f"""
WITH known(id, sentence) AS (VALUES {', '.join(variants)}),
cut AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
marked AS (SELECT r, {own} AS m FROM cut WHERE regexp_matches(coalesce(text, ''), '{MET}')),
places AS (SELECT r, m, translate(m, '/', ' ') AS flat, unnest(list_filter(range(1, length(m)), lambda i: m[i] IN ('|', '/'))) AS p FROM marked),
met AS (
  SELECT r, p, p + length(sentence) AS finish, id FROM places JOIN known ON starts_with(substr(flat, p + 1), sentence) AND m[p + length(sentence) + 1] IN ('|', '/')
), longest AS (SELECT r, p, max(finish) AS finish, arg_max(id, finish) AS id FROM met GROUP BY r, p),
kept AS (SELECT * FROM longest a WHERE NOT EXISTS (SELECT 1 FROM longest b WHERE a.r = b.r AND b.p < a.p AND b.finish >= a.finish)),
ids AS (SELECT r, string_agg(id, '' ORDER BY p) AS identifiers FROM kept GROUP BY r),
named AS (
  SELECT doc_id, coalesce(identifiers, '') AS identifiers, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(identifiers, ''), '{rules}'), lambda r: ({names})[r]))) AS licenses
  FROM cut LEFT JOIN ids USING (r)
)
SELECT doc_id, identifiers, CAST(len(licenses) AS BIGINT) AS n_licenses, coalesce(array_to_string(licenses, ','), '') AS licenses FROM named
"""


ORACLE_SQL = _sql()
