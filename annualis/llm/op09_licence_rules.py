"""Licence recognition by sentence rules.

A text is cut into pieces at stops, colons, semicolons, list marks and line ends; each is normalised
(lower case, words and version numbers only).  A sentence is a run of pieces, so that a sentence
wrapped over lines, commented out or with a semicolon in it is the same as on one line; the longest
known sentence from each piece on gives its identifier.  The identifiers, in text order, are then
matched against ordered rules: a rule is a sequence of identifiers and names a licence; the first
rules of the list are tried first, and what a rule has matched is used up, so that a specific
licence wins over a general notice.

Everything is a function of one row (no shuffle): texts without any word of the table's are
answered by one pattern test."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier -> normalised licence sentence (public licence texts and notices).
SENTENCES = {
    "Apache2Ref": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license",
                   "this file is licensed under the apache license version 2.0", "released under the apache license version 2.0",
                   "this work is licensed under the apache license version 2.0", "released under the apache license 2.0",
                   "licensed under the apache license 2.0"],
    "Apache2Use": ["you may not use this file except in compliance with the license"],
    "Apache2Copy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0",
                    "you may obtain a copy of the license at https www.apache.org licenses license 2.0"],
    "Apache2AsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                    "without warranties or conditions of any kind either express or implied"],
    "Apache1Ref": ["licensed under the apache license version 1.0", "licensed under the apache license version 1.1"],
    "MITRef": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license",
               "distributed under the mit license", "this project is licensed under the mit license", "the project is licensed under the mit license",
               "this software is licensed under the mit license", "mit license", "the mit license"],
    "MITGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
                 "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
                 "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
                 "to the following conditions"],
    "MITNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "GPL3Ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
                "released under the gnu general public license version 3", "licensed under the gnu gpl version 3", "licensed under the gpl version 3"],
    "GPL2Ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2",
                "released under the gnu general public license version 2", "licensed under the gnu gpl version 2", "licensed under the gpl version 2"],
    "GPL1Ref": ["this work is licensed under the gnu general public license version 1", "licensed under the gnu general public license version 1"],
    "GPLAnyRef": ["licensed under the gnu general public license", "this work is licensed under the gnu general public license",
                  "released under the gnu general public license"],
    "GPLFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                "the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2Free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
                 "by the free software foundation either version 2 of the license or at your option any later version"],
    "GPL3Only": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as "
                 "published by the free software foundation"],
    "GPL2Only": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as "
                 "published by the free software foundation"],
    "LGPL21Free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                   "published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "LGPL3Free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
                  "published by the free software foundation either version 3 of the license or at your option any later version"],
    "AGPL3Free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
                  "published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPLNoWarranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                      "merchantability or fitness for a particular purpose"],
    "LGPLNoWarranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
                       "merchantability or fitness for a particular purpose"],
    "LGPL21Ref": ["licensed under the gnu lesser general public license version 2.1", "this work is licensed under the gnu lesser general public license version 2.1"],
    "LGPL3Ref": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "AGPL3Ref": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "BSDRedistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDNoEndorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission"],
    "BSD2Ref": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "BSD3Ref": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "BSDRef": ["licensed under the bsd license", "released under the bsd license"],
    "MPL2Ref": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "MPL2Copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
                 "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"],
    "ISCGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
                 "above copyright notice and this permission notice appear in all copies"],
    "CCBYRef": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CCBY3Ref": ["licensed under cc by 3.0", "this work is licensed under cc by 3.0"],
    "CCBYSARef": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0",
                  "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CCBYSA3Ref": ["licensed under cc by sa 3.0"],
    "CCBYNCRef": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0",
                  "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CCBYNC3Ref": ["licensed under cc by nc 3.0"],
    "CCBYNDRef": ["licensed under cc by nd 4.0"],
    "CCBYNCSARef": ["licensed under cc by nc sa 4.0"],
    "CCBYNCNDRef": ["licensed under cc by nc nd 4.0"],
    "CC0Ref": ["released under cc0 1.0", "licensed under cc0 1.0", "to the extent possible under law the author has waived all copyright to this work"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "PublicDomain": ["released into the public domain", "this work is in the public domain"],
    "AllRights": ["all rights reserved"],
}
# Identifiers of the SPDX line, as written there.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC",
        "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"]
SENTENCES |= {f"SPDX-{name}": ["spdx license identifier " + name.lower().replace("-", " ")] for name in SPDX}
# Clauses with a name in them, and the form that the table has.
SLOTS = [(r"neither[ |]the[ |]names?[ |]of[ |].{1,100}?[ |]nor[ |]the[ |]names[ |]of[ |](?:its|their|any|the)[ |]contributors",
          "neither the name of the copyright holder nor the names of its contributors")]
# Ordered rules, (licence, sequence of sentence identifiers).
RULES = [
    *((name, [f"SPDX-{name}"]) for name in SPDX),
    ("Apache-2.0", ["Apache2Ref", "Apache2Use", "Apache2Copy", "Apache2AsIs"]),
    ("MIT", ["MITRef", "MITGrant", "MITNotice"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("GPL-3.0-or-later", ["GPLFree", "GPLNoWarranty"]),
    ("GPL-2.0-or-later", ["GPL2Free", "GPLNoWarranty"]),
    ("BSD-3-Clause", ["BSDRedistribute", "BSDNoEndorse"]),
    ("MPL-2.0", ["MPL2Ref", "MPL2Copy"]),
    ("GPL-3.0-only", ["GPL3Only", "GPLNoWarranty"]),
    ("GPL-2.0-only", ["GPL2Only", "GPLNoWarranty"]),
    ("LGPL-2.1-or-later", ["LGPL21Free", "LGPLNoWarranty"]),
    ("LGPL-3.0-or-later", ["LGPL3Free", "LGPLNoWarranty"]),
    ("AGPL-3.0-or-later", ["AGPL3Free", "GPLNoWarranty"]),
    ("GPL-3.0-only", ["GPL3Only"]),
    ("GPL-2.0-only", ["GPL2Only"]),
    ("LGPL-2.1-or-later", ["LGPL21Free"]),
    ("LGPL-3.0-or-later", ["LGPL3Free"]),
    ("AGPL-3.0-or-later", ["AGPL3Free"]),
    ("GPL-3.0-or-later", ["GPLFree"]),
    ("GPL-2.0-or-later", ["GPL2Free"]),
    ("Apache-2.0", ["Apache2Ref"]),
    ("Apache-1.x", ["Apache1Ref"]),
    ("MIT", ["MITRef"]),
    ("MIT", ["MITGrant"]),
    ("GPL-3.0", ["GPL3Ref"]),
    ("GPL-2.0", ["GPL2Ref"]),
    ("GPL-1.0", ["GPL1Ref"]),
    ("GPL", ["GPLAnyRef"]),
    ("LGPL-2.1", ["LGPL21Ref"]),
    ("LGPL-3.0", ["LGPL3Ref"]),
    ("AGPL-3.0", ["AGPL3Ref"]),
    ("BSD-2-Clause", ["BSD2Ref"]),
    ("BSD-3-Clause", ["BSD3Ref"]),
    ("BSD", ["BSDRef"]),
    ("BSD-2-Clause", ["BSDRedistribute"]),
    ("MPL-2.0", ["MPL2Ref"]),
    ("ISC", ["ISCGrant"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSARef"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCNDRef"]),
    ("CC-BY-NC-4.0", ["CCBYNCRef"]),
    ("CC-BY-NC-3.0", ["CCBYNC3Ref"]),
    ("CC-BY-SA-4.0", ["CCBYSARef"]),
    ("CC-BY-SA-3.0", ["CCBYSA3Ref"]),
    ("CC-BY-ND-4.0", ["CCBYNDRef"]),
    ("CC-BY-4.0", ["CCBYRef"]),
    ("CC-BY-3.0", ["CCBY3Ref"]),
    ("CC0-1.0", ["CC0Ref"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-Domain", ["PublicDomain"]),
]
#: Only texts and sentences with one of these words can hold a sentence of the table.
HINT = "(?i)licen[cs]|permission|copyright|redistribut|public domain|rights reserved|warrant|mpl|cc0|unencumbered"
#: As HINT, with words that stand on two lines.
WRAPPED_HINT = HINT.replace("public domain", r"public\W+domain").replace("rights reserved", r"rights\W+reserved")
#: Piece ends: a list mark or comment word at a line's start, a stop, question or exclamation mark
#: before white space or the end (a full stop inside a version number ends nothing), a line end,
#: a colon or semicolon before white space.
BREAK = r"(?im)^\W*(?:\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)]|(?:dnl|rem)\b)(?=\s)|[.!?]+(?:\s+|\z)|[\r\n]+|[:;](?=\s)"
#: What is not kept of a sentence: everything but letters, digits and stops between them.
NOISE = r"[^a-z0-9.]+|\.(?:[^a-z0-9]|$)"
SEPARATOR = "|"
#: Stands where a rule has used up identifiers; what lies on both sides of it is no sequence.
USED = "~"
#: Ends a piece in the normalised text.
END = "|"


def sentence_pattern(sentences: list[str]) -> str:
    """Pattern of any of the normalised sentences, as a run of whole pieces; the longest first."""
    runs = [re.escape(x).replace(r"\ ", f"[ {END}]") for x in sorted(sentences, key=lambda x: (-len(x), x))]
    return rf"(?<![^{END}])(?:{'|'.join(runs)})(?![^{END}])"


def sentence_ids(text: Column, known: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    pairs = [(s, i) for i, ss in known.items() for s in ss]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    pieces = F.transform(F.split(text, BREAK), lambda s: F.trim(F.regexp_replace(F.lower(s), NOISE, " ")))
    plain = F.regexp_replace(F.array_join(F.filter(pieces, lambda s: s != ""), END), " +", " ")
    for slot, name in SLOTS:
        plain = F.regexp_replace(plain, slot, name)
    found = F.regexp_extract_all(plain, F.lit(sentence_pattern([s for s, _ in pairs])), 0)
    ids = F.transform(found, lambda s: table[F.translate(s, END, " ")])
    return F.when(text.rlike(WRAPPED_HINT), ids).otherwise(F.array().cast("array<string>"))


def licences(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Licences that the identifier sequence stands for, in rule order, each once."""
    key = lambda seq: "".join(SEPARATOR + i + SEPARATOR for i in seq)
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(key(seq)).alias("seq")) for name, seq in rules])
    # every identifier between separators of its own, so that equal sequences side by side are all used up
    start = F.struct(F.concat(F.lit(SEPARATOR), F.array_join(ids, SEPARATOR * 2), F.lit(SEPARATOR)).alias("left"),
                     F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.contains(acc["left"], rule["seq"])
        left = F.when(hit, F.replace(acc["left"], rule["seq"], F.lit(USED))).otherwise(acc["left"])
        return F.struct(left.alias("left"), F.when(hit, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    done = F.aggregate(table, start, step, lambda a: a["found"])
    return F.when(F.size(ids) > 0, done).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sentences, licences): one row per input row; the identifiers found, in text
    order, and the licences they stand for, in rule order.

    Null and empty texts have none; extra columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sentences"))
    return rows.select(F.col("id").alias(id_col), "sentences", licences(F.col("sentences")).alias("licences"))


def licences_sql() -> str:
    """DuckDB SQL for ``scan_licences`` of documents with both lists joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(i)})" for i, ss in SENTENCES.items() for s in ss)
    steps, last = [], "s0"
    for n, (name, seq) in enumerate(RULES, 1):
        key = quote("".join(SEPARATOR + i + SEPARATOR for i in seq))
        steps.append(f"s{n} AS MATERIALIZED (SELECT n, replace(l, {key}, '{USED}') AS l, "
                     f"CASE WHEN contains(l, {key}) AND NOT list_contains(f, {quote(name)}) THEN list_append(f, {quote(name)}) ELSE f END AS f FROM {last})")
        last = f"s{n}"
    slotted = "trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+|\\.(?:[^a-z0-9]|$)', ' ', 'g'), ' +', ' ', 'g'))"
    for slot, name in SLOTS:
        slotted = f"regexp_replace({slotted}, {quote(slot)}, {quote(name)}, 'g')"
    return f"""
WITH known(s, i) AS (VALUES {values}),
numbered AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT n, unnest(x) AS s, generate_subscripts(x, 1) AS k
        FROM (SELECT n, string_split_regex(text, '[.!?]+(?:\\s+|$)|[\\r\\n]+') AS x FROM numbered WHERE regexp_matches(text, {quote(HINT)}))),
plain AS (SELECT n, k, {slotted} AS s
          FROM cut WHERE regexp_matches(s, {quote(HINT)})),
ids AS (SELECT n, list(i ORDER BY k) AS i FROM plain JOIN known USING (s) GROUP BY n),
s0 AS (SELECT n, '|' || array_to_string(i, '||') || '|' AS l, CAST([] AS VARCHAR[]) AS f FROM ids),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(i, ','), '') AS sentences, coalesce(array_to_string(f, ','), '') AS licences
FROM numbered LEFT JOIN ids USING (n) LEFT JOIN {last} USING (n)"""
