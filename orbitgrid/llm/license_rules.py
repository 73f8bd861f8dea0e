"""License scans by sentence-rule recognition (operator 7).

A text is cut into pieces at line ends and after marks, and the pieces are normalised (lower case,
runs of other characters than a-z and 0-9 to one space). A known licence sentence is a run of whole
pieces that, joined by spaces, is its normalised form: so it may be wrapped over lines and hold marks
of its own ("v. 2.0"). Of known sentences that begin at one piece the longest counts. The sequence of
their identifiers in a text is then matched against ordered licence rules: a rule is a sequence of
identifiers that must occur side by side, known sentences being all that counts as a neighbour.

An enumerator of one letter or digit before a sentence does not count. A hole `{}` in a known sentence
stands for up to fifteen words, such as a holder's name.

It runs within each row: no shuffle, no join. Only texts with one of `KEYWORDS` are normalised;
every known sentence has one, in one word. Null and empty texts have no sentence and no licence.
Sentences that repeat are recognised each time; a licence is reported once. Repeated rows are scanned
each, texts of any length whole; an empty table gives an empty one. Columns named like a result are
replaced. The DuckDB form knows only sentences of one piece, without holes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the licences of the GNU project, by their short name.
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = (("3.0", "Unported"), ("4.0", "International"))
#: Class of each licence that a rule can name.
CLASSES = {
    "permissive": ("MIT", "MIT-0", "X11", "JSON", "BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Apache-2.0", "Zlib", "BSL-1.0", "PostgreSQL", "Unlicense", "CC0-1.0", "WTFPL", "Artistic-2.0", *(f"CC-BY-{v}" for v, _ in CC_VERSIONS)),
    "copyleft": (
        *(f"{k}-{v if '.' in v else v + '.0'}-{end}" for k, v in GNU_VERSIONS for end in ("only", "or-later")), *(f"{k}-{v if '.' in v else v + '.0'}" for k, v in GNU_VERSIONS),
        "MPL-2.0", "EPL-2.0", "CDDL-1.0", "EUPL-1.2", *(f"CC-BY-SA-{v}" for v, _ in CC_VERSIONS),
    ),
    "restricted": ("proprietary", *(f"CC-{k}-{v}" for k in CC if "N" in k for v, _ in CC_VERSIONS)),
}
CLASS_OF = {name: kind for kind, names in CLASSES.items() for name in names}
#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-grant-free": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "x11-liability": "IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "x11-name": "Except as contained in this notice, the name of {} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {}.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Licensed under the BSD License.",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-name": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl-verbatim": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "artistic-title": "The Artistic License 2.0",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-hope-other": "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl2-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "cddl-notice": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "eupl-notice": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "This work is licensed under CC0 1.0.",
    "cc0-title": "Creative Commons Legal Code CC0 1.0 Universal",
    "rights-reserved": "All rights reserved under copyright.",
    "rights-reserved-all": "All rights reserved.",
    **{f"{k}-{v}-later".lower(): f"{{}} is free software: you can redistribute it and/or modify it under the terms of the {GNU[k]} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version." for k, v in GNU_VERSIONS},
    **{f"{k}-{v}-only".lower(): f"{{}} is free software: you can redistribute it and/or modify it under the terms of the {GNU[k]} version {v} as published by the Free Software Foundation." for k, v in GNU_VERSIONS},
    **{f"{k}-{v}-only-of".lower(): f"{{}} is free software: you can redistribute it and/or modify it under the terms of the {GNU[k]} as published by the Free Software Foundation, version {v} of the License." for k, v in GNU_VERSIONS},
    **{f"{k}-{v}-notice".lower(): f"This work is licensed under the {GNU[k]}, version {v}." for k, v in GNU_VERSIONS},
    **{f"cc-{k}-{v}-{form}".lower(): f"This work is licensed under {article} Creative Commons {name} {v} {where} License." for k, name in CC.items() for v, where in CC_VERSIONS for form, article in (("a", "a"), ("the", "the"))},
    **{f"spdx-{name}".lower(): f"SPDX-License-Identifier: {name}" for name in CLASS_OF if name not in ("BSD", "proprietary")},
}
#: (licence, identifiers that follow each other), in order: the first rule that fits names a text's main licence.
ORDERED = (
    *((f"{k}-{v if '.' in v else v + '.0'}", (f"{k}{v}-title".lower(), "gnu-verbatim")) for k, v in GNU_VERSIONS),
    *((f"{k}-{v if '.' in v else v + '.0'}-or-later", (f"{k}-{v}-later".lower(), hope)) for k, v in GNU_VERSIONS for hope in ("gpl-hope", "gpl-hope-other")),
    *((f"{k}-{v if '.' in v else v + '.0'}-only", (f"{k}-{v}-{form}".lower(),)) for k, v in GNU_VERSIONS for form in ("only", "only-of", "notice")),
    *((f"{k}-{v if '.' in v else v + '.0'}-or-later", (f"{k}-{v}-later".lower(),)) for k, v in GNU_VERSIONS),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-title", "epl2-terms")),
    ("EPL-2.0", ("epl2-notice",)),
    ("CDDL-1.0", ("cddl-notice",)),
    ("EUPL-1.2", ("eupl-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    *((f"CC-{k}-{v}", (f"cc-{k}-{v}-{form}".lower(),)) for k in sorted(CC, key=len, reverse=True) for v, _ in CC_VERSIONS for form in ("a", "the") if k != "BY"),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("Apache-2.0", ("apache-notice-you", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-notice-you",)),
    ("Apache-2.0", ("apache-notice",)),
    ("JSON", ("mit-grant", "mit-keep", "json-good")),
    ("X11", ("mit-grant", "mit-keep", "mit-as-is", "x11-liability", "x11-name")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT-0", ("mit-grant-free", "mit-as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-notice",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("BSL-1.0", ("boost-notice",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("WTFPL", ("wtfpl-title", "wtfpl-verbatim")),
    ("Artistic-2.0", ("artistic-title",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    *((f"CC-BY-{v}", (f"cc-by-{v}-{form}",)) for v, _ in CC_VERSIONS for form in ("a", "the")),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC0-1.0", ("cc0-title",)),
    *((name, (f"spdx-{name}".lower(),)) for name in CLASS_OF if name not in ("BSD", "proprietary")),
    ("proprietary", ("rights-reserved",)),
    ("proprietary", ("rights-reserved-all",)),
)
#: The same with each licence's class.
RULES = tuple((name, CLASS_OF[name], ids) for name, ids in ORDERED)
#: Beginnings of the words licence, permission, (re)distribute, warranty, copyright, reserved, unencumbered, liable,
#: creative, evil, authorization, advertising and EUPL; the first letter apart, since that is what most places fail at.
KEYWORDS = "(?i)(?<![a-z])[lpdrwcuae](?:icen[sc]|ermission|istribut|edistribut|arrant|opyright|eserved|nencumbered|iable|reative|vil|uthorization|dvertising|upl)"
#: Words that a hole stands for, in a normalised text; one that begins a sentence does not reach into the pieces before, nor begin with an enumerator.
HOLE, FIRST_HOLE = "[a-z0-9]+(?:[ \n][a-z0-9]+){0,14}?", "[a-z0-9]{2,}(?: [a-z0-9]+){0,14}?"
#: A piece ends at a line's end, or at a mark that white space follows.
END = r"([.!?:])[\x20\x09-\x0D]+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


def known_sentences() -> dict[str, str]:
    """Identifier of each normalised sentence without holes."""
    return {normalised(s): i for i, s in SENTENCES.items() if "{}" not in s}


def pattern(sentence: str) -> str:
    """A sentence, wrapped or not, with its holes as a pattern for normalised text."""
    return normalised(sentence.replace("{}", " hole0hole ")).replace(" ", "[ \n]").replace("hole0hole", FIRST_HOLE if sentence.startswith("{}") else HOLE, 1).replace("hole0hole", HOLE)


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, a line end before and after each; empty ones are left out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.translate(F.regexp_replace(text, END, "$1\n"), upper, lower), "[^a-z0-9\n]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), plain, F.lit("\n")), " ?\n[ \n]*", "\n")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*(F.lit(x) for pair in known_sentences().items() for x in pair))
    # whole sentences before those with holes, which they may fit too; of each kind the longest first
    first = sorted(SENTENCES.items(), key=lambda x: ("{}" in x[1], -len(x[1])))
    found = F.regexp_extract_all(pieces(text), F.lit(f"(?<=\n|\n[0-9a-z] )({'|'.join(pattern(s) for _, s in first)})(?=\n)"), F.lit(1))
    found = F.when(F.coalesce(text.rlike(KEYWORDS), F.lit(False)), found).otherwise(F.array().cast("array<string>"))
    with_holes = [(i, f"^{pattern(s)}$") for i, s in first if "{}" in s]
    held = lambda s: F.coalesce(*(F.when(s.rlike(p), F.lit(i)) for i, p in with_holes))
    return F.transform(found, lambda s: F.coalesce(F.try_element_at(known, F.translate(s, "\n", " ")), held(s)))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with sentence_ids, licenses (of all rules that fit, in rule order), license and license_class (the first's)."""
    line = F.concat(F.lit("|"), F.array_join("sentence_ids", "|"), F.lit("|"))
    fits = [line.contains("|" + "|".join(ids) + "|") for _, _, ids in RULES]
    names = F.array_distinct(F.array_compact(F.array(*(F.when(f, F.lit(r[0])) for f, r in zip(fits, RULES, strict=True)))))
    kinds = F.array_compact(F.array(*(F.when(f, F.lit(r[1])) for f, r in zip(fits, RULES, strict=True))))
    return (
        docs.withColumn("sentence_ids", sentence_ids(F.col(text_col)))
        .withColumn("licenses", names)
        .withColumns({"license": F.get("licenses", F.lit(0)), "license_class": F.get(kinds, F.lit(0))})
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licenses (joined by commas), license and license_class of every document."""
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license", "license_class")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(field: int) -> str:
    whens = " ".join(f"WHEN contains(line, '|{'|'.join(r[2])}|') THEN '{r[field]}'" for r in RULES)
    return f"CASE {whens} END"


_FIRST = {name: i for i, (name, _, _) in reversed(list(enumerate(RULES)))}
ORACLE_SQL = f"""
WITH known(plain, id) AS (VALUES {", ".join(f"({_quoted(p)}, {_quoted(i)})" for p, i in known_sentences().items())}),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?:])[\\x20\\x09-\\x0D]+', '\\1\n', 'g'), '\n')) AS x, generate_subscripts(string_split(regexp_replace(text, '([.!?:])[\\x20\\x09-\\x0D]+', '\\1\n', 'g'), '\n'), 1) AS i
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, string_agg(id, '|' ORDER BY i) AS ids FROM s JOIN known
  ON plain = trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
l AS (SELECT doc_id, coalesce(ids, '') AS ids, '|' || coalesce(ids, '') || '|' AS line FROM documents LEFT JOIN k USING (doc_id))
SELECT doc_id, replace(ids, '|', ',') AS sentence_ids,
  array_to_string(list_filter([{", ".join("CASE WHEN " + " OR ".join(f"contains(line, '|{'|'.join(r[2])}|')" for r in RULES if r[0] == name) + f" THEN '{name}' END" for name in sorted(_FIRST, key=_FIRST.get))}], lambda x: x IS NOT NULL), ',') AS licenses,
  {_case(0)} AS license, {_case(1)} AS license_class FROM l
"""
