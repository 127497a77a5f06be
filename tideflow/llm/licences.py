"""Licence recognition by sentence rules.

A text is cut into pieces after [.!?:] with a blank and at line ends, and each is normalised (lower
case, runs of other characters than letters and digits to one space). A run of pieces that together
are a known licence sentence is found, so a sentence may be wrapped over lines or hold a full stop
itself. The identifiers found, in page order, form a sequence; a rule is an ordered list of
identifiers that must occur consecutively in it. The sequence is matched from its start with the
longest rule that fits, and identifiers that a rule has used are not used again, so that the
sentences of a three-clause licence do not name the two-clause one too.

Everything is a function of one row and of fixed tables: no shuffle, no Python.

Defined results: one row for each input row; a null or empty text has no sentence and no licence;
licences are named in the order of their first match, each once, its sentences are counted each
time; an empty table gives an empty result. Extra columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import text_of

# Identifiers and wording of public licence sentences, by licence family.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "author-disclaims": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "zlib-provided": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0."],
    "unlicense-dedication": ["This is free and unencumbered software released into the public domain."],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-unless": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2-redistribute": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-redistribute": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-redistribute": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-provided": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "artistic2-notice": ["Licensed under the Artistic License 2.0.", "This is free software, licensed under the Artistic License 2.0."],
    "wtfpl-grant": ["You just DO WHAT THE FUCK YOU WANT TO."],
    "cc-by-nc4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nd4-notice": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa4-notice": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0-notice": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["All rights reserved.", "All Rights Reserved."],
}
# Ordered rules (licence, identifiers in order).
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-notice"]),
    ("MIT-0", ["mit0-grant", "as-is"]),
    ("ISC", ["isc-grant", "author-disclaims"]),
    ("0BSD", ["0bsd-grant", "author-disclaims"]),
    ("Zlib", ["zlib-provided", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Unlicense", ["unlicense-dedication", "unlicense-grant"]),
    ("Unlicense", ["unlicense-dedication"]),
    ("Apache-2.0", ["apache2-notice", "apache2-copy", "apache2-unless"]),
    ("Apache-2.0", ["apache2-notice", "apache2-copy"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("BSD-4-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("Artistic-2.0", ["artistic2-notice"]),
    ("WTFPL", ["wtfpl-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4-notice"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa4-notice"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("proprietary", ["reserved"]),
]


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known() -> dict[str, str]:
    """normalised sentence -> identifier."""
    return {normalised(x): name for name, forms in SENTENCES.items() for x in forms}


def marked(ids: list[str]) -> str:
    """Identifiers as they stand in a sequence: no one is the end or the beginning of another."""
    return "".join(f"<{i}>" for i in ids)


def rule_pattern() -> str:
    """All rules, the longest first, so that the first that fits is the longest."""
    return "|".join(marked(ids) for _, ids in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, identifiers, licences): recognised sentences and licences of each row, comma-joined in order."""
    table = F.create_map(*[F.lit(x) for pair in sorted(known().items()) for x in pair])
    names = F.create_map(*[F.lit(x) for licence, ids in RULES for x in (marked(ids), licence)])
    pieces = F.concat(F.lit("\n"), F.regexp_replace("__text", r"([.!?:])[ \t]+", "$1\n"), F.lit("\n"))
    pieces = F.regexp_replace(F.regexp_replace(F.lower(pieces), "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    # longest first: a sentence that goes on in the next piece is not taken for a shorter one
    forms = "|".join(x.replace(" ", "[ \n]") for x in sorted(known(), key=len, reverse=True))
    found = F.transform(F.regexp_extract_all(pieces, F.lit(f"(?<=\n)(?:{forms})(?=\n)"), F.lit(0)), lambda x: F.try_element_at(table, F.translate(x, "\n", " ")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("__text")).select("doc_id", found.alias("__found"))
    sequence = F.array_join(F.transform("__found", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    matches = F.transform(F.regexp_extract_all(sequence, F.lit(rule_pattern()), F.lit(0)), lambda x: F.try_element_at(names, x))
    return rows.select("doc_id", F.size("__found").cast("long").alias("n_sentences"), F.array_join("__found", ",").alias("identifiers"), F.array_join(F.array_distinct(matches), ",").alias("licences"))


def oracle() -> str:
    """The same in DuckDB SQL, by unnesting sentences and joining the known ones; sentences that are wrapped over lines are left to the tests."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    pairs = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(known().items()))
    rules = ", ".join(f"({quoted(marked(ids))}, {quoted(name)})" for name, ids in RULES)
    return rf"""
    WITH known(sentence, id) AS (VALUES {pairs}), rules(ids, licence) AS (VALUES {rules}),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT r, unnest(parts) AS sentence, unnest(range(len(parts))) AS k FROM
          (SELECT r, string_split(regexp_replace(text, '([.!?:])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d)),
    f AS (SELECT r, string_agg(id, ',' ORDER BY k) AS ids, string_agg('<' || id || '>', '' ORDER BY k) AS sequence, count(*) AS n FROM s
          JOIN known ON known.sentence = trim(regexp_replace(lower(s.sentence), '[^a-z0-9]+', ' ', 'g'), ' ') GROUP BY r),
    x AS (SELECT r, unnest(found) AS ids, unnest(range(len(found))) AS k FROM (SELECT r, regexp_extract_all(sequence, {quoted(rule_pattern())}) AS found FROM f)),
    m AS (SELECT r, string_agg(licence, ',' ORDER BY k) AS licences FROM
          (SELECT r, licence, min(k) AS k FROM x JOIN rules USING (ids) GROUP BY r, licence) GROUP BY r)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS identifiers, coalesce(licences, '') AS licences
    FROM d LEFT JOIN f USING (r) LEFT JOIN m USING (r)"""
