"""The licence scan in DuckDB SQL, with tables of its own: what licences say in bare words.

It shares nothing with ``license_scan`` but the names of identifiers, so a fault
in either's table or patterns shows as a difference.
"""

from __future__ import annotations

#: Identifier and bare words of a sentence, one to a line.
_SENTENCES = """
mit-grant permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
mit-notice the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-notice the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software
as-is-mit the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-liability in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
isc-grant permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc-grant permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc-as-is the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
apache-comply you may not use this file except in compliance with the license
apache-copy you may obtain a copy of the license at http www apache org licenses license 2 0
apache-copy you may obtain a copy of the license at https www apache org licenses license 2 0
apache-copy you may obtain a copy of the license at
apache-as-is unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-see see the license for the specific language governing permissions and limitations under the license
gpl-3-grant this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-grant this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-warranty this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl-details see the gnu general public license for more details
lgpl-2-grant this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-grant this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-warranty this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
lgpl-details see the gnu lesser general public license for more details
agpl-3-grant this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-details see the gnu affero general public license for more details
mpl-2-form this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2-copy if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0
mpl-2-copy if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0
epl-2-terms this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0
epl-2-terms this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which accompanies this distribution
bsd-head redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-source redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-binary redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-endorse neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
zlib-as-is this software is provided as is without any express or implied warranty
zlib-grant permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
unlicense-domain this is free and unencumbered software released into the public domain
unlicense-grant anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
bsl-grant permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
all-rights all rights reserved
mit-name spdx license identifier mit
isc-name spdx license identifier isc
apache-2-name spdx license identifier apache 2 0
gpl-2-name spdx license identifier gpl 2 0
gpl-2-name spdx license identifier gpl 2 0 only
gpl-2-name spdx license identifier gpl 2 0 or later
gpl-3-name spdx license identifier gpl 3 0
gpl-3-name spdx license identifier gpl 3 0 only
gpl-3-name spdx license identifier gpl 3 0 or later
lgpl-2-name spdx license identifier lgpl 2 1
lgpl-2-name spdx license identifier lgpl 2 1 only
lgpl-2-name spdx license identifier lgpl 2 1 or later
lgpl-3-name spdx license identifier lgpl 3 0
lgpl-3-name spdx license identifier lgpl 3 0 only
lgpl-3-name spdx license identifier lgpl 3 0 or later
agpl-3-name spdx license identifier agpl 3 0
agpl-3-name spdx license identifier agpl 3 0 only
agpl-3-name spdx license identifier agpl 3 0 or later
mpl-2-name spdx license identifier mpl 2 0
epl-2-name spdx license identifier epl 2 0
bsl-name spdx license identifier bsl 1 0
zlib-name spdx license identifier zlib
unlicense-name spdx license identifier unlicense
bsd-2-name spdx license identifier bsd 2 clause
bsd-3-name spdx license identifier bsd 3 clause
cc0-name spdx license identifier cc0 1 0
cc-by-4-name spdx license identifier cc by 4 0
cc-by-sa-4-name spdx license identifier cc by sa 4 0
cc-by-nd-4-name spdx license identifier cc by nd 4 0
cc-by-nc-4-name spdx license identifier cc by nc 4 0
cc-by-nc-sa-4-name spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4-name spdx license identifier cc by nc nd 4 0
"""
#: Identifier and bare words of a licence's name.
_NAMES = """
mit-name mit license
mit-name mit licence
mit-name mit x11 license
mit-name expat license
isc-name isc license
apache-2-name apache license version 2 0
apache-2-name apache license version 2 0 the license
apache-2-name apache license 2 0
apache-2-name apache 2 0 license
apache-2-name apache license version 2 0 january 2004
gpl-2-name gnu general public license version 2
gpl-2-name gnu general public license v2 0
gpl-2-name gnu gpl version 2
gpl-2-name gplv2
gpl-2-name gnu general public license version 2 june 1991
gpl-3-name gnu general public license version 3
gpl-3-name gnu general public license v3 0
gpl-3-name gnu gpl version 3
gpl-3-name gplv3
gpl-3-name gnu general public license version 3 29 june 2007
lgpl-2-name gnu lesser general public license version 2 1
lgpl-2-name lgplv2 1
lgpl-3-name gnu lesser general public license version 3
lgpl-3-name lgplv3
agpl-3-name gnu affero general public license version 3
agpl-3-name agplv3
mpl-2-name mozilla public license v 2 0
mpl-2-name mozilla public license version 2 0
mpl-2-name mozilla public license 2 0
epl-2-name eclipse public license version 2 0
epl-2-name eclipse public license 2 0
epl-2-name eclipse public license v 2 0
bsl-name boost software license version 1 0
bsl-name boost software license version 1 0 august 17th 2003
zlib-name zlib license
unlicense-name unlicense
bsd-name bsd license
bsd-name bsd style license
bsd-2-name bsd 2 clause license
bsd-2-name bsd 2 clause simplified license
bsd-2-name simplified bsd license
bsd-3-name bsd 3 clause license
bsd-3-name bsd 3 clause new or revised license
bsd-3-name new bsd license
cc0-name cc0 1 0
cc0-name cc0 1 0 universal
cc-by-4-name cc by 4 0
cc-by-4-name creative commons attribution 4 0 international license
cc-by-4-name creative commons attribution 4 0 international
cc-by-sa-4-name cc by sa 4 0
cc-by-sa-4-name creative commons attribution sharealike 4 0 international license
cc-by-sa-4-name creative commons attribution sharealike 4 0 international
cc-by-nd-4-name cc by nd 4 0
cc-by-nd-4-name creative commons attribution noderivatives 4 0 international license
cc-by-nd-4-name creative commons attribution noderivatives 4 0 international
cc-by-nc-4-name cc by nc 4 0
cc-by-nc-4-name creative commons attribution noncommercial 4 0 international license
cc-by-nc-4-name creative commons attribution noncommercial 4 0 international
cc-by-nc-sa-4-name cc by nc sa 4 0
cc-by-nc-sa-4-name creative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-sa-4-name creative commons attribution noncommercial sharealike 4 0 international
cc-by-nc-nd-4-name cc by nc nd 4 0
cc-by-nc-nd-4-name creative commons attribution noncommercial noderivatives 4 0 international license
cc-by-nc-nd-4-name creative commons attribution noncommercial noderivatives 4 0 international
"""
#: Licence and what it needs, first match first.
_RULES = """
MIT mit-name mit-grant mit-notice as-is-mit
MIT mit-grant mit-notice as-is-mit
MIT mit-grant mit-notice
ISC isc-name isc-grant isc-as-is
ISC isc-grant isc-as-is
Apache-2.0 apache-2-name apache-comply apache-copy apache-as-is
Apache-2.0 apache-2-name apache-comply
GPL-3.0 gpl-3-grant gpl-warranty gpl-details
GPL-2.0 gpl-2-grant gpl-warranty gpl-details
LGPL-2.1 lgpl-2-grant lgpl-warranty lgpl-details
LGPL-3.0 lgpl-3-grant lgpl-warranty lgpl-details
AGPL-3.0 agpl-3-grant gpl-warranty agpl-details
MPL-2.0 mpl-2-form mpl-2-copy
BSD-3-Clause bsd-head bsd-source bsd-binary bsd-endorse
BSD-2-Clause bsd-head bsd-source bsd-binary
Zlib zlib-as-is zlib-grant
Unlicense unlicense-domain unlicense-grant
ISC isc-grant
GPL-3.0 gpl-3-grant
GPL-2.0 gpl-2-grant
LGPL-2.1 lgpl-2-grant
LGPL-3.0 lgpl-3-grant
AGPL-3.0 agpl-3-grant
MPL-2.0 mpl-2-form
EPL-2.0 epl-2-terms
Zlib zlib-grant
Unlicense unlicense-domain
BSL-1.0 bsl-grant
MIT mit-name
ISC isc-name
Apache-2.0 apache-2-name
GPL-2.0 gpl-2-name
GPL-3.0 gpl-3-name
LGPL-2.1 lgpl-2-name
LGPL-3.0 lgpl-3-name
AGPL-3.0 agpl-3-name
MPL-2.0 mpl-2-name
EPL-2.0 epl-2-name
BSL-1.0 bsl-name
Zlib zlib-name
Unlicense unlicense-name
BSD bsd-name
BSD-2-Clause bsd-2-name
BSD-3-Clause bsd-3-name
CC0-1.0 cc0-name
CC-BY-4.0 cc-by-4-name
CC-BY-SA-4.0 cc-by-sa-4-name
CC-BY-ND-4.0 cc-by-nd-4-name
CC-BY-NC-4.0 cc-by-nc-4-name
CC-BY-NC-SA-4.0 cc-by-nc-sa-4-name
CC-BY-NC-ND-4.0 cc-by-nc-nd-4-name
"""


def _rows(block: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" ", 1)) for line in block.split("\n") if line]


def _sql() -> str:
    """Marks are single letters of the private range: q a sentence's end, r a line's end, s and t around a known sentence."""
    q, r, s, t = map(chr, range(0xE010, 0xE014))
    said, names = _rows(_SENTENCES), _rows(_NAMES)
    one_of = lambda found: "|".join(sorted((v for _, v in found), key=len, reverse=True))
    thing = "((this|the) (work|file|software|project|program|text|document|library|code|material|content|package)s? (is|are) )?"
    given = "(((dual |re)?(licensed|released|distributed|published|provided|available|made available) under (the )?(terms of (the )?)?)|licence |license |the )?"
    # RE2 has no look-ahead, so each mark stands twice: one ends a sentence, the next begins one
    words = f"({one_of(said)}|{thing}{given}({one_of(names)}))".replace("(", "(?:").replace(" ", f" (?:[{q}{r}] [{q}{r}] )?")
    gap = "(?:<[a-z0-9-]+>){0,2}?"
    rules = [(k, licence, gap.join(f"<{n}>" for n in need.split())) for k, (licence, need) in enumerate(_rows(_RULES))]
    values = lambda found: ",\n  ".join(str(row).replace('"', "'") for row in found)
    return rf"""
WITH said(id, words) AS (VALUES
  {values(said)}),
names(id, words) AS (VALUES
  {values(names)}),
rules(k, licence, pattern) AS (VALUES
  {values(rules)}),
held AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[{q}{r}{s}{t}]', ' ', 'g'), '\r\n?', chr(10), 'g') AS x FROM documents
  WHERE regexp_matches(text, '(?i)licen[cs]|copyright|redistribut|warrant|public domain|permission|endorse|rights reserved|\bcc0\b|\bcc[ -]by\b|\bl?a?gpl|\bmpl\b|free to copy|creative commons')),
cut AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
    '\n[^\pL\pN\n]*\n[^\pL\pN]*', ' {q} ', 'g'), '([.!?;]["'')\]]?)\s+', '\1 {q} ', 'g'), ':[ \t]+([A-Z])', ' {q} \1', 'g'), '\n', ' {r} ', 'g') AS x FROM held),
line AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('{q} ' || regexp_replace(lower(x), '[^\pL\pN{q}{r}]+', ' ', 'g') || ' {q}',
    '[{q}{r} ]*{q}[{q}{r} ]*', ' {q} ', 'g'), '{q}', '{q} {q}', 'g'), '{r}', '{r} {r}', 'g') AS x FROM cut),
found AS (SELECT doc_id, string_split(regexp_replace(x, '([{q}{r}]) ({words}) ([{q}{r}])', '\1{s}\2{t}\3', 'g'), '{s}') AS parts FROM line),
part AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS part FROM found),
known AS (SELECT doc_id, k, 0 AS j, regexp_replace(split_part(part, '{t}', 1), '[{q}{r}] ', '', 'g') AS words FROM part WHERE k > 1),
named AS (SELECT doc_id, k, j, coalesce(a.id, b.id, c.id) AS id FROM known LEFT JOIN said a ON a.words = known.words LEFT JOIN names b ON b.words = known.words
  LEFT JOIN names c ON c.words = regexp_replace(known.words, '^{thing}{given}', '')),
rest AS (SELECT doc_id, k, string_split(replace(CASE k WHEN 1 THEN part ELSE split_part(part, '{t}', 2) END, ' {r} {r} ', ' '), '{q}') AS said FROM part),
other AS (SELECT doc_id, k, generate_subscripts(said, 1) AS j, unnest(said) AS said FROM rest),
ids AS (SELECT * FROM named UNION ALL SELECT doc_id, k, j, 'unknown' FROM other WHERE regexp_matches(said, 'licen[cs]e|copyright|redistribut|warranty\b|warranties\b|public domain|permission is')),
g AS (SELECT doc_id, string_agg(id, ',' ORDER BY k, j) AS ids, string_agg('<' || id || '>', '' ORDER BY k, j) AS tags, count(*) FILTER (id = 'unknown') AS n_unknown FROM ids GROUP BY doc_id),
pieces AS (SELECT doc_id, regexp_extract_all(tags, (SELECT string_agg(pattern, '|' ORDER BY k) FROM rules)) AS p FROM g),
piece AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS pos FROM pieces),
licence AS (SELECT doc_id, pos, (SELECT arg_min(licence, k) FROM rules WHERE regexp_full_match(p, pattern)) AS licence FROM piece),
once AS (SELECT doc_id, licence, min(pos) AS pos FROM licence GROUP BY ALL),
l AS (SELECT doc_id, string_agg(licence, ',' ORDER BY pos) AS licences, count(*) AS n FROM once GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences, coalesce(n, 0)::BIGINT AS n_licences, coalesce(n_unknown, 0)::BIGINT AS n_unknown
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP10_SQL = _sql()
