import textwrap

from tideflow.llm import licences


def test_licence_sequences(spark):
    full = " ".join(licences.SENTENCES[k][0] for k in ("mit-grant", "mit-condition", "as-is"))
    swapped = "\n".join(licences.SENTENCES[k][0] for k in ("mit-condition", "mit-grant", "as-is"))
    bsd = "\n".join(licences.SENTENCES[k][0] for k in ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"))
    rows = [(1, full), (2, swapped), (3, bsd), (4, "x\nRELEASED   under the mit License!\ny"), (5, "no licence at all"), (6, None)]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "", 3: "BSD-3-Clause", 4: "MIT", 5: "", 6: ""}


MIT = """MIT License

Copyright (c) 2020 Some One

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD2 = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 */
"""
BSD3 = BSD2.replace(" */", """ * 3. Neither the name of the University nor the names of its contributors
 *    may be used to endorse or promote products derived from this software
 *    without specific prior written permission.
 */""")
GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
MPL2 = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_licences_as_files_hold_them(spark):
    want = [
        (MIT, "mit-grant,mit-condition,as-is", "MIT"),
        (BSD2, "bsd-redistribute,bsd-source,bsd-binary", "BSD-2-Clause"),
        (BSD3, "bsd-redistribute,bsd-source,bsd-binary,bsd-endorse", "BSD-3-Clause"),
        (GPL3, "gpl3-redistribute,gpl-warranty,gpl-details", "GPL-3.0-or-later"),
        (MPL2, "mpl2-notice,mpl2-copy", "MPL-2.0"),
        (BSD2 + BSD3 + MIT + MIT, None, "BSD-2-Clause,BSD-3-Clause,MIT"),
        (GPL3.split("#\n")[1], "gpl-warranty,gpl-details", ""),
        ("x; SPDX-License-Identifier: MIT\ny", "", ""),
        ("// SPDX-License-Identifier: Apache-2.0\ny", "apache2-notice", "Apache-2.0"),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(want)], "doc_id long, text string")).collect()}
    for k, (_, ids, names) in enumerate(want):
        assert got[k].licences == names and ids in (None, got[k].identifiers), (k, got[k])


def test_each_licence_sentence_and_rule_is_found_alone_and_wrapped(spark):
    """In the midst of other lines: as one line, wrapped at 72 columns, and wrapped in a comment."""
    wanted = [(name, name, [x]) for name, forms in licences.SENTENCES.items() for x in forms]
    wanted += [(",".join(ids), licence, [licences.SENTENCES[i][0] for i in ids]) for licence, ids in licences.RULES]
    rows, want = [], {}
    for ids, licence, sentences in wanted:
        # a sentence that ends without a full stop, as an address does, ends with its line
        joined = "".join(x + (" " if x[-1] in ".:!" else "\n") for x in sentences)
        wrapped = [x for line in joined.split("\n") for x in textwrap.wrap(line, 72)]
        for mark, lines in (("", sentences), ("", wrapped), (" * ", wrapped)):
            want[len(rows)] = (ids, licence)
            rows.append((len(rows), "\n".join(mark + x for x in ["Some words before", *lines, "and after it"])))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.identifiers for k, r in got.items()} == {k: ids for k, (ids, _) in want.items()}
    names = {licence for licence, _ in licences.RULES}
    assert all(got[k].licences == licence for k, (_, licence) in want.items() if licence in names)
    assert names == {x for r in got.values() for x in r.licences.split(",") if x}
