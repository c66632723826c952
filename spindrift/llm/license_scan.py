"""Licence scans by sentence rules, in DataFrame functions only.

A text becomes one line of lower-case words in which two marks stand: one where
a sentence ends (a sentence mark before white space, a colon before a capital,
a blank line), one at any other line break.  Known sentences are looked for
whole, from mark to mark, across marks and line breaks inside them, so wrapped
and commented headers are found; table and text are normalised alike.  Known
sentences map to identifiers; what is left is cut at sentence ends, and a
sentence that mentions a licence is ``unknown``.

The identifiers, in order, are then matched against the rules, longest first: a
rule is an ordered sequence of identifiers, with up to ``gap`` other identifiers
between two of them.  Identifiers that no rule takes are reported as they are.

A sentence that names a licence may begin with "this work is", "licensed under
the" and the like.  The tables are fixed and small; they stand in the plan as
literals.  Null and empty texts have no sentences and the empty list of
licences; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier, then what licences say, as they write it.
SENTENCES: dict[str, list[str]] = {
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "as-is-mit": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl-3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "lgpl-2-grant": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-3-grant": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-details": ["See the GNU Lesser General Public License for more details."],
    "agpl-3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-details": ["See the GNU Affero General Public License for more details."],
    "mpl-2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl-2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution."],
    "bsd-head": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "bsl-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "all-rights": ["All rights reserved."],
}

#: Identifier, names of the licence as texts write them, identifiers of SPDX.
NAMES: dict[str, tuple[list[str], list[str]]] = {
    "mit-name": (["MIT License", "MIT Licence", "MIT/X11 License", "Expat License"], ["MIT"]),
    "isc-name": (["ISC License"], ["ISC"]),
    "apache-2-name": (["Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")', "Apache License 2.0", "Apache 2.0 License", "Apache License Version 2.0, January 2004"], ["Apache-2.0"]),
    "gpl-2-name": (["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GNU General Public License Version 2, June 1991"], ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"]),
    "gpl-3-name": (["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GNU General Public License Version 3, 29 June 2007"], ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"]),
    "lgpl-2-name": (["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"]),
    "lgpl-3-name": (["GNU Lesser General Public License, version 3", "LGPLv3"], ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"]),
    "agpl-3-name": (["GNU Affero General Public License, version 3", "AGPLv3"], ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "mpl-2-name": (["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"], ["MPL-2.0"]),
    "epl-2-name": (["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License - v 2.0"], ["EPL-2.0"]),
    "bsl-name": (["Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"], ["BSL-1.0"]),
    "zlib-name": (["zlib License"], ["Zlib"]),
    "unlicense-name": (["Unlicense"], ["Unlicense"]),
    "bsd-name": (["BSD License", "BSD-style License"], []),
    "bsd-2-name": (["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"], ["BSD-2-Clause"]),
    "bsd-3-name": (["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"], ["BSD-3-Clause"]),
    "cc0-name": (["CC0 1.0", "CC0 1.0 Universal"], ["CC0-1.0"]),
    **{
        f"cc-{code.lower()}-4-name": ([f"CC {code} 4.0", f"Creative Commons {words} 4.0 International License", f"Creative Commons {words} 4.0 International"], [f"CC-{code}-4.0"])
        for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    },
}

#: Licence, then the identifiers that it needs in order.  The first rule that matches at a place takes it.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-name", "isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("Apache-2.0", ["apache-2-name", "apache-comply", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-2-name", "apache-comply"]),
    ("GPL-3.0", ["gpl-3-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0", ["gpl-2-grant", "gpl-warranty", "gpl-details"]),
    ("LGPL-2.1", ["lgpl-2-grant", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-3.0", ["lgpl-3-grant", "lgpl-warranty", "lgpl-details"]),
    ("AGPL-3.0", ["agpl-3-grant", "gpl-warranty", "agpl-details"]),
    ("MPL-2.0", ["mpl-2-form", "mpl-2-copy"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-domain", "unlicense-grant"]),
    ("ISC", ["isc-grant"]),
    ("GPL-3.0", ["gpl-3-grant"]),
    ("GPL-2.0", ["gpl-2-grant"]),
    ("LGPL-2.1", ["lgpl-2-grant"]),
    ("LGPL-3.0", ["lgpl-3-grant"]),
    ("AGPL-3.0", ["agpl-3-grant"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("EPL-2.0", ["epl-2-terms"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-domain"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("MIT", ["mit-name"]),
    ("ISC", ["isc-name"]),
    ("Apache-2.0", ["apache-2-name"]),
    ("GPL-2.0", ["gpl-2-name"]),
    ("GPL-3.0", ["gpl-3-name"]),
    ("LGPL-2.1", ["lgpl-2-name"]),
    ("LGPL-3.0", ["lgpl-3-name"]),
    ("AGPL-3.0", ["agpl-3-name"]),
    ("MPL-2.0", ["mpl-2-name"]),
    ("EPL-2.0", ["epl-2-name"]),
    ("BSL-1.0", ["bsl-name"]),
    ("Zlib", ["zlib-name"]),
    ("Unlicense", ["unlicense-name"]),
    ("BSD", ["bsd-name"]),
    ("BSD-2-Clause", ["bsd-2-name"]),
    ("BSD-3-Clause", ["bsd-3-name"]),
    ("CC0-1.0", ["cc0-name"]),
    ("CC-BY-4.0", ["cc-by-4-name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-name"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-name"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4-name"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4-name"]),
]

STOP, BREAK, OPEN, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"  # a sentence's end, a line's end, around a known sentence
#: What may stand before a licence's name.
BEFORE = r"(?:(?:this|the) (?:work|file|software|project|program|text|document|library|code|material|content|package)s? (?:is|are) )?(?:(?:dual |re)?(?:licensed|released|distributed|published|provided|(?:made )?available) under (?:the )?(?:terms of (?:the )?)?|licen[cs]e |the )?"
SPDX = "spdx license identifier "
MENTION = r"licen[cs]e|copyright|redistribut|warrant(y|ies)\b|public domain|permission is"
#: What a text must hold to have a known sentence or to mention a licence; spares the others all the rest.
ANCHOR = r"(?i)licen[cs]|copyright|redistribut|warrant|public domain|permission|endorse|rights reserved|\bcc0\b|\bcc[ -]by\b|\bl?a?gpl|\bmpl\b|free to copy|creative commons"


def plain(text: str) -> str:
    """A sentence of the table in the words that ``marked`` makes of it."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


KNOWN = {plain(v): name for name, variants in SENTENCES.items() for v in variants}
NAMED = {plain(v): name for name, (names, _) in NAMES.items() for v in names}
TAGGED = {SPDX + plain(v): name for name, (_, tags) in NAMES.items() for v in tags}


def _longest_first(found: dict[str, str]) -> str:
    return "|".join(sorted(found, key=lambda v: (-len(v), v)))


def known_pattern() -> str:
    """A known sentence between marks, which may stand between its words too."""
    words = f"(?:{_longest_first(KNOWN | TAGGED)}|{BEFORE}(?:{_longest_first(NAMED)}))"
    return f"([{STOP}{BREAK}] )({words.replace(' ', f' (?:[{STOP}{BREAK}] )?')})(?= [{STOP}{BREAK}])"


def marked(text: Column) -> Column:
    """Lower-case words, one space between two, and marks; a mark at both ends."""
    for pattern, by in (
        (f"[{STOP}{BREAK}{OPEN}{CLOSE}]", " "),
        (r"\r\n?", "\n"),
        (r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*+", f" {STOP} "),
        (r"""([.!?;]["')\]]?)\s+""", f"$1 {STOP} "),
        (r":[ \t]+([A-Z])", f" {STOP} $1"),
        (r"\n", f" {BREAK} "),
    ):
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{STOP}{BREAK}]+", " ")
    return F.regexp_replace(F.concat(F.lit(f"{STOP} "), text, F.lit(f" {STOP}")), f"[{STOP}{BREAK} ]*{STOP}[{STOP}{BREAK} ]*", f" {STOP} ")


def _known(sentence: Column) -> Column:
    """The identifier of a known sentence."""
    bare = F.regexp_replace(sentence, f"[{STOP}{BREAK}] ", "")
    table = lambda found: F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    return F.coalesce(F.try_element_at(table(KNOWN | TAGGED | NAMED), bare), F.try_element_at(table(NAMED), F.regexp_replace(bare, f"^{BEFORE}", "")))


def identifiers(text: Column) -> Column:
    """Identifiers of a text's sentences in order; ``unknown`` for others that mention a licence."""
    none = F.array().cast("array<string>")
    parts = F.split(F.regexp_replace(marked(text), known_pattern(), f"$1{OPEN}$2{CLOSE}"), OPEN)

    def unknown(rest: Column) -> Column:
        said = F.filter(F.split(F.regexp_replace(rest, f" {BREAK} ", " "), STOP), lambda s: s.rlike(MENTION))
        return F.transform(said, lambda s: F.lit("unknown"))

    def of(part: Column, k: Column) -> Column:
        halves = F.split(part, CLOSE)
        return F.when(k == 0, unknown(part)).otherwise(F.concat(F.array(_known(F.element_at(halves, 1))), unknown(F.element_at(halves, 2))))

    return F.when(text.rlike(ANCHOR), F.flatten(F.transform(parts, of))).otherwise(none)


def _rule_pattern(gap: int) -> str:
    """Matches one rule at a place in ``<id><id>...``; rules in order."""
    between = f"(?:<[a-z0-9-]+>){{0,{gap}}}?" if gap else ""
    return "|".join(between.join(f"<{name}>" for name in need) for _, need in RULES)


def licences(ids: Column, gap: int = 2) -> Column:
    """Licences of a sequence of identifiers, in order of place, each once."""
    joined = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    taken = F.regexp_extract_all(joined, F.lit(f"({_rule_pattern(gap)})"), F.lit(1))
    name = lambda part: F.coalesce(*[F.when(part.rlike("^" + (f"(?:<[a-z0-9-]+>){{0,{gap}}}?" if gap else "").join(f"<{n}>" for n in need) + "$"), F.lit(licence)) for licence, need in RULES])
    return F.array_distinct(F.transform(taken, name))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2) -> DataFrame:
    """``(id, sentence_ids, licences, n_unknown)`` for every row.

    A rule may skip up to ``gap`` sentences between two of its own that mention
    a licence; sentences that mention none don't count.
    """
    named = docs.select(F.col(id_col).alias("id"), identifiers(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sentence_ids"))
    return named.select(
        "id",
        "sentence_ids",
        F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>")).otherwise(licences(F.col("sentence_ids"), gap)).alias("licences"),
        F.size(F.filter("sentence_ids", lambda i: i == "unknown")).cast("long").alias("n_unknown"),
    )


def op10_license_scan(spark, sf_dir):
    from .common import table

    out = scan(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        F.size("licences").cast("long").alias("n_licences"),
        "n_unknown",
    )
