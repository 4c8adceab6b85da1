"""License scans by sentence rules.

Texts are normalised, and known licence sentences in them, wrapped or not, mapped
to identifiers; the sequence of identifiers is then matched against ordered rules,
of which the first that fits names the licence. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (ASCII lower case, runs of other characters than a-z and 0-9 as one space).
SENTENCES = {
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache2_licensed": "licensed under the apache license version 2 0",
    "apache2_header": "licensed under the apache license version 2 0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl2_work": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl_distributed": "distributed under the boost software license version 1 0",
    "epl2_available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "mit0_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd_style": "use of this source code is governed by a bsd style license that can be found in the license file",
    "mit_style": "use of this source code is governed by an mit style license that can be found in the license file",
    "all_rights": "all rights reserved",
    "apache2_title": "apache license version 2 0 january 2004",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "gpl2_title": "gnu general public license version 2 june 1991",
}
# Licence identifiers as they stand after "SPDX-License-Identifier:".
SPDX = (
    "MIT", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "MIT-0",
)
# Older identifiers, and what they are called now.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
SENTENCES |= {f"spdx:{name}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in (*SPDX, *SPDX_OLD)}
SENTENCES |= {f"spdx:{a}|{b}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", f"{a} or {b}".lower()) for a, b in (("MIT", "Apache-2.0"), ("Apache-2.0", "MIT"))}
# Titles by which a sentence says that something is licensed, released and so on under a licence.
STATED = {
    "mit license": "mit_licensed", "expat license": "mit_licensed", "apache license version 2 0": "apache2_licensed", "apache license 2 0": "apache2_licensed", "apache 2 0 license": "apache2_licensed", "apache license v2 0": "apache2_licensed",
    "gnu general public license version 3": "gpl3_work", "gnu general public license v3 0": "gpl3_work", "gnu gpl v3": "gpl3_work", "gpl v3": "gpl3_work", "gplv3": "gpl3_work", "gnu general public license version 2": "gpl2_work", "gnu general public license v2 0": "gpl2_work",
    "gpl v2": "gpl2_work", "gplv2": "gpl2_work", "mozilla public license version 2 0": "mpl2_stated", "mozilla public license 2 0": "mpl2_stated", "mpl 2 0": "mpl2_stated", "bsd 3 clause license": "bsd3_stated", "3 clause bsd license": "bsd3_stated",
    "bsd 2 clause license": "bsd2_stated", "2 clause bsd license": "bsd2_stated", "isc license": "isc_stated", "zlib license": "zlib_stated", "boost software license version 1 0": "bsl_distributed", "eclipse public license 2 0": "epl2_stated", "eclipse public license version 2 0": "epl2_stated",
    "gnu affero general public license version 3": "agpl3_stated", "gnu lesser general public license version 3": "lgpl3_stated", "gnu lesser general public license version 2 1": "lgpl21_stated", "unlicense": "unlicense_stated",
    "creative commons attribution 4 0 international license": "cc_by_4", "creative commons attribution sharealike 4 0 international license": "cc_by_sa_4", "creative commons attribution noncommercial 4 0 international license": "cc_by_nc_4",
}
#: What stands before a title: who (or nothing), how, and under.
STATING = (
    "(?:(?:this|the|our) (?:software|program|code|source code|project|work|library|file|package|module|repository|document|documentation|tool) (?:is|are) (?:free software )?)?"
    "(?:(?:dual |made )?(?:licensed|released|distributed|available|published|provided|covered)(?: and distributed)?) under (?:the )?(?:terms of (?:the )?)?"
)
# Ordered rules; a rule fits if its identifiers occur in a document in this order, others between them or not.
RULES = [
    *((name, [f"spdx:{name}"]) for name in SPDX),
    *((now, [f"spdx:{old}"]) for old, now in SPDX_OLD.items()),
    ("MIT OR Apache-2.0", [r"spdx:MIT\|Apache-2.0"]),
    ("Apache-2.0 OR MIT", [r"spdx:Apache-2.0\|MIT"]),
    ("AGPL-3.0-or-later", ["agpl_free"]),
    ("AGPL-3.0-only", ["agpl3_stated"]),
    ("LGPL-3.0-only", ["lgpl3_stated"]),
    ("LGPL-2.1-only", ["lgpl21_stated"]),
    ("EPL-2.0", ["epl2_stated"]),
    ("MPL-2.0", ["mpl2_stated"]),
    ("BSD-3-Clause", ["bsd3_stated"]),
    ("BSD-2-Clause", ["bsd2_stated"]),
    ("ISC", ["isc_stated"]),
    ("Zlib", ["zlib_stated"]),
    ("Unlicense", ["unlicense_stated"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("EPL-2.0", ["epl2_available"]),
    ("BSL-1.0", ["bsl_distributed"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("Apache-2.0", ["apache2_header", "apache2_comply", "apache2_basis"]),
    ("Apache-2.0", ["apache2_licensed"]),
    ("Apache-2.0", ["apache2_header"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-2.0-only", ["gpl2_work"]),
    ("LGPL-2.1-or-later", ["lgpl_free"]),
    ("MPL-2.0", ["mpl2_subject"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_redistribution"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_released"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["mit_style"]),
    ("MIT-0", ["mit0_grant"]),
    ("BSD-3-Clause", ["bsd_style"]),
    ("ISC", ["isc_grant"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["apache2_title"]),
    ("GPL-3.0-only", ["gpl3_title"]),
    ("GPL-2.0-only", ["gpl2_title"]),
    ("proprietary", ["all_rights"]),
]
#: Each known sentence holds one of these, so other documents need no splitting.
ANCHORS = ("license", "licensed", "permission", "warranty", "redistribution", "copyright", "software", "rights", "gpl", "mpl")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Known sentences whose official wording has an end of a sentence (or a colon and a line break) within: the words before it.
WITHIN = {
    "gpl_free": ("free software", "software foundation"),
    "gpl2_free": ("free software", "software foundation"),
    "lgpl_free": ("free software", "software foundation"),
    "lgpl3_free": ("free software", "software foundation"),
    "agpl_free": ("free software", "software foundation"),
    "gpl_hope": ("without any warranty",),
    "mpl2_subject": ("license v",),
}
#: Stands for an end of a sentence: no lowered text has it.
END = "E"


def marked(text: Column) -> Column:
    """The normalised text: words joined by a blank, by a line break where the text has one that may be wrapping, or by END
    after . ! ? ; and white space, after a colon that ends a line, at blank lines and around bullets."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), "\r\n?", "\n")
    for pattern, by in (
        (r"(?md)^[^a-z0-9\n]*(?<![-+])[-+•][ \t]+", END),  # bullets, but not the comment mark --
        (r"(?md)^[^a-z0-9\nE]+", ""),  # comment marks, so that lines of them alone are blank
        (r"(?md)^(?:dnl|rem)[ \t]+", ""),
        (r"(?md)^([0-9a-z]{1,2}\))[ \t]+", f"{END}$1{END}"),
        (r"[.!?;][\x20\x09-\x0D]+|:[ \t]*\n|\n[\x20\x09-\x0D]*\n", END),
        (r"[^a-z0-9\nE]+", " "),
        (r"[ \nE]*E[ \nE]*", END),
        (r" ?\n[ \n]*", "\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit(END), F.trim(out), F.lit(END))


def _one_of(known: dict[str, str], stated: dict[str, str]) -> str:
    """Known sentences, the longest first, as they occur in a marked text: from a line's or sentence's begin to such an end,
    wrapped anywhere, with ends within only where WITHIN has them; then sentences that state a title."""

    def gaps(name: str, sentence: str) -> str:
        done, parts = "", []
        for word in sentence.split(" "):
            parts += [f"[ \n{END}]" if done.endswith(WITHIN.get(name, ())) else "[ \n]"] * bool(parts) + [re.escape(word)]
            done = f"{done} {word}"
        return "".join(parts)

    longest = sorted(known.items(), key=lambda x: -len(x[1]))
    every = [gaps(*x) for x in longest]
    if stated:
        every.append(STATING.replace(" ", "[ \n]") + f"(?:{'|'.join(gaps('', t) for t in sorted(stated, key=len, reverse=True))})")
    return f"(?<=[\n{END}])(?:{'|'.join(every)})(?=[\n{END}])"


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_sentences (known ones, repeats counted), sentence_ids (joined by
    a blank, in text order), license (that of the first rule that fits, else null), rule (its number from 1, or null).

    A known sentence counts where it is whole lines or sentences of the text, wrapped or not; of those that begin at one
    place the longest counts. A sentence that says that something is licensed (or released, available and so on) under a
    title of STATED counts like a known one. SCAN_SQL states the same for sentences that stand on one line and hold no end within.
    Null and empty texts hold no sentence; repeated rows each get a row; an empty table gives an empty one; only
    doc_id and text are read. Whole texts are scanned; nothing is shuffled.
    """
    stated = STATED if known is None else {}
    known, rules = known or SENTENCES, rules or RULES
    names = F.create_map(*[F.lit(x) for pairs in ({v: k for k, v in known.items()}, stated) for pair in pairs.items() for x in pair])
    named = lambda s: F.coalesce(F.try_element_at(names, s), F.try_element_at(names, F.regexp_replace(s, f"^{STATING}", "")))
    lowered = F.translate("text", UPPER, LOWER)
    anchored = F.rlike(lowered, F.lit("|".join(ANCHORS))) if known is SENTENCES else F.col("text").isNotNull()
    hits = F.regexp_extract_all(marked(F.col("text")), F.lit(_one_of(known, stated)), F.lit(0))
    found = F.when(anchored, F.transform(hits, lambda s: named(F.translate(s, f"\n{END}", "  "))))
    rows = docs.select("doc_id", F.coalesce(F.array_join(found, " "), F.lit("")).alias("sentence_ids"))
    padded = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    fits = F.coalesce(*[F.when(padded.rlike(" " + " (?:.* )?".join(ids) + " "), F.lit(n)) for n, (_, ids) in enumerate(rules, 1)])
    counted = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", " "))).cast("long")
    matched = rows.withColumn("rule", F.when(F.col("sentence_ids") != "", fits))
    return matched.select("doc_id", counted.alias("n_sentences"), "sentence_ids", F.coalesce(*[F.when(F.col("rule") == n, F.lit(name)) for n, (name, _) in enumerate(rules, 1)]).alias("license"), "rule")


def _scan_sql(docs: str) -> str:
    known = ", ".join(f"('{sentence}', '{name}')" for name, sentence in SENTENCES.items())
    stated = ", ".join(f"('{title}', '{name}')" for title, name in STATED.items())
    fits = " ".join(f"WHEN regexp_matches(' ' || ids || ' ', ' {' (?:.* )?'.join(ids)} ') THEN {n}" for n, (_, ids) in enumerate(RULES, 1))
    names = ", ".join(f"'{name}'" for name, _ in RULES)
    return rf"""
WITH known(sentence, name) AS (VALUES {known}), stated(title, name) AS (VALUES {stated}),
s AS (SELECT rowid, doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[\n\r]+') AS list
      FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM {docs})),
e AS (SELECT rowid, unnest(list) AS sentence, unnest(range(len(list))) AS place FROM s),
p AS (SELECT rowid, place, trim(regexp_replace(sentence, '[^a-z0-9]+', ' ', 'g')) AS words FROM e),
i AS (SELECT rowid, place, coalesce(known.name, stated.name) AS name FROM p LEFT JOIN known ON words = known.sentence LEFT JOIN stated ON regexp_extract(words, '^{STATING}(.+)$', 1) = stated.title),
m AS (SELECT rowid, string_agg(name, ' ' ORDER BY place) AS ids, count(*) AS n FROM i WHERE name IS NOT NULL GROUP BY rowid),
r AS (SELECT s.doc_id, coalesce(m.n, 0) AS n_sentences, coalesce(m.ids, '') AS ids FROM s LEFT JOIN m USING (rowid)),
f AS (SELECT *, CASE {fits} END AS rule FROM r)
SELECT doc_id, n_sentences, ids AS sentence_ids, CASE WHEN rule IS NOT NULL THEN [{names}][rule] END AS license, rule FROM f
"""


SCAN_SQL = _scan_sql("documents")
