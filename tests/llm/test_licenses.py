from rookery.llm import licenses

SCHEMA = "doc_id long, text string, license string, rule int"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t, "own", 7) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    return [tuple(r)[1:] for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_sequences_of_sentences_name_a_license(spark):
    got = scanned(
        spark,
        [
            "Some words.\nReleased under the MIT License.\nMore words.",
            f"{MIT}:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "Licensed under the Apache License, Version 2.0",
            "we talk of the mit license and of all rights reserved seats",
            "All rights reserved. Licensed under CC-BY-NC-4.0!",
            "licensed under cc by 4.0; licensed under cc by 4.0",
            "",
            None,
            "word " * 200_000 + "\nAll rights reserved.",
        ],
    )
    assert [r[2] for r in got] == ["MIT", "MIT", "Apache-2.0", None, "CC-BY-NC-4.0", "CC-BY-4.0", None, None, "proprietary"]
    assert got[1][:2] == (2, "mit_grant mit_notice") and got[4][:2] == (2, "all_rights cc_by_nc_4") and got[5][0] == 2 and got[7] == (0, "", None, None)


def test_earlier_rules_win_and_order_counts(spark):
    known, rules = {"a": "first", "b": "second", "c": "third"}, [("AB", ["a", "b"]), ("BA", ["b", "a"]), ("C", ["c"])]
    df = spark.createDataFrame([(1, "First.\nthird\nSECOND", "", 0), (2, "second\nfirst", "", 0), (3, "third", "", 0), (4, "firstsecond", "", 0), (4, "firstsecond", "", 0)], SCHEMA)
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(df, known, rules).collect() if r["license"]) == [(1, "AB"), (2, "BA"), (3, "C")]
    assert licenses.scan(df.limit(0)).collect() == []


#: The official texts as their publishers wrap them.
WRAPPED = {
    "MIT": """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS BE LIABLE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause": """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright
and related or neighboring rights to this work.""",
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.",
}


def test_official_texts_count_however_they_are_wrapped_and_commented(spark):
    styles = {
        "plain": lambda t: t,
        "one line": lambda t: "\n".join(" ".join(p.split("\n")) for p in t.split("\n\n")),
        "dos": lambda t: t.replace("\n", "\r\n"),
        **{m: lambda t, m=m: "\n".join(f"{m} {x}".rstrip() for x in t.split("\n")) for m in ("//", "#", ";;", "--", "rem", ">")},
        "block": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint x;",
        "box": lambda t: "\n".join(f"/* {x:<80} */" for x in t.split("\n")),
    }
    cases = [(name, style, f(text)) for name, text in WRAPPED.items() for style, f in styles.items()]
    got = scanned(spark, [c[2] for c in cases])
    assert [(n, s, r[2]) for (n, s, _), r in zip(cases, got, strict=True)] == [(n, s, n) for n, s, _ in cases]
    plain = {n: r[1] for (n, s, _), r in zip(cases, got, strict=True) if s == "plain"}
    assert plain["MIT"] == "mit_grant mit_notice as_is" and plain["Apache-2.0"] == "apache2_header apache2_comply apache2_basis"
    assert plain["GPL-3.0-or-later"] == "gpl_free gpl_hope" and plain["BSD-3-Clause"] == "all_rights bsd_redistribution bsd_endorse"


def test_ends_of_sentences_and_blank_lines_still_part(spark):
    got = scanned(spark, ["Licensed under the Apache.\nLicense, Version 2.0", "Released under\n\nthe MIT License", "- Released under\n- the MIT License", "Released under the MIT License. All rights\nreserved.", "a) All rights\nreserved"])
    assert [r[1] for r in got] == ["", "", "", "mit_released all_rights", "all_rights"]


def test_more_known_licences(spark):
    texts = {
        "AGPL-3.0-or-later": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n",
        "Zlib": "/* Permission is granted to anyone to use this software for any purpose,\n * including commercial applications, and to alter it and redistribute it\n * freely, subject to the following restrictions:\n */",
        "EPL-2.0": " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at\n",
        "BSD-3-Clause": "// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.\n",
        "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)\n",
        "LGPL-2.1-or-later": "/* SPDX-License-Identifier: LGPL-2.1-or-later */\n",
        "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_sentences_that_state_a_title(spark):
    cases = {
        "This software is licensed under the MIT License.": "MIT",
        "The code is released under the terms of the\nApache License, Version 2.0.": "Apache-2.0",
        "Our library is available under the BSD 3-Clause License!": "BSD-3-Clause",
        "Made available under the Eclipse Public License 2.0": "EPL-2.0",
        "This project is distributed under GPLv3.": "GPL-3.0-only",
        "This document is licensed under the Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT OR Apache-2.0",
        "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": "GPL-3.0-only",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "Apache-2.0",
        "This software is not licensed under the MIT License of old.": None,
        "we licensed under the mit license": None,
        "It is under the MIT License.": None,
    }
    assert [r[2] for r in scanned(spark, list(cases))] == list(cases.values())
