import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import licenses


@pytest.fixture(scope="module")
def model():
    return licenses.fit([])


def test_held_out_accuracy(model):
    """Notices with words dropped and words around them that training has not seen."""
    text, mark, _ = licenses.examples([], seed=99)
    right = total = false = plain = 0
    for bag, want in zip(licenses._bags(text), mark):
        got = licenses.judge(model, bag, 0.7)
        if want in licenses.NOTICES:
            total += 1
            right += got is not None and got[0] == want
        elif want == licenses.NONE:
            plain += 1
            false += got is not None
    assert right / total > 0.95 and false / plain < 0.005


#: Licences of no family, under names that neither training nor calibration holds.
OTHERS = ("Licensed under the Eiffel Forum License, version 2.", "This file is covered by the Sleepycat License.",
          "This work is licensed under the GNU Free Documentation License, version 1.3.", "Distributed under the WTFPL.",
          "Released under the Microsoft Public License.", "This font software is licensed under the SIL Open Font License, Version 1.1.",
          "Use of this data is governed by the Open Database License.", "Licensed under the Python Software Foundation License, version 2.")


def judged(model, text):
    (_, _, _, _, _, (denied, _)), = licenses.paragraphs(pa.array([text]))
    return licenses.judge(model, licenses._bags([text])[0], 0.7, bool(denied.any()))


def test_other_licences_are_unknown(model):
    got = [judged(model, t) for t in OTHERS]
    assert all(g is None or not g[3] for g in got)
    assert sum(g is not None and g[0] == licenses.UNKNOWN for g in got) >= 6


@pytest.mark.parametrize("text,family", [
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
     "Public License as published by the Free Software Foundation, either version 3 of the License.", "agpl"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or any later version.", "gpl"),
    ("Licensed under CC BY-ND 4.0.", "cc-by-nd"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
    ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
])
def test_near_families_are_told_apart(model, text, family):
    got = judged(model, text)
    assert got[0] == family and got[3]


@pytest.mark.parametrize("text", [
    "This file is not licensed under the Apache License, Version 2.0.",
    "The tool was never released under the MIT License.", "It is no longer distributed under the BSD 3-Clause License.",
    "This project isn't licensed under the terms of the MIT license."])
def test_denied_notices_are_not_confirmed(model, text):
    got = judged(model, text)
    assert got is None or not got[3]


@pytest.mark.parametrize("line,families", [
    ("// SPDX-License-Identifier: ISC", ["isc"]), ("# SPDX-License-Identifier: LGPL-2.1-only", ["lgpl"]),
    ("SPDX-License-Identifier: GPL-2.0-only", ["gpl"]), ("SPDX-License-Identifier: EPL-2.0", ["epl"]),
    ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", ["mit", "apache"]), ("SPDX-License-Identifier: MIT-0", ["unknown"]),
    ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", ["gpl"]), ("SPDX-License-Identifier: Zlib", ["unknown"]),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0 more words", ["cc-by-nc-sa"]), ("SPDX license identifiers are useful", []),
    ("SPDX-License-Identifier:", [])])
def test_spdx_identifiers_are_read_whole(spark, line, families):
    assert licenses.spdx_families(line.lower().encode()) == families


def test_spdx_lines_in_documents(spark, words):  # noqa: F811
    rows = [(1, words(9, 1) + "\n * SPDX-License-Identifier: LGPL-2.1-only\n" + words(9, 2)),
            (2, "SPDX-License-Identifier: Zlib"), (3, "SPDX-License-Identifier: MIT OR BSD-3-Clause")]
    got = {(r.doc_id, r.line, r.family, r.confirmed) for r in licenses.scan(make(spark, rows)).collect()}
    assert got == {(1, 1, "lgpl", True), (2, 0, "unknown", False), (3, 0, "mit", True), (3, 0, "bsd", True)}


def test_scan_finds_the_lines(spark, words):  # noqa: F811
    rng = np.random.default_rng(1)
    rows, want = list(EDGE), set()
    for i, (family, notices) in enumerate(licenses.NOTICES.items()):
        for k, notice in enumerate(notices):
            lines = [words(12, 100 * i + j) for j in range(5)]
            at = int(rng.integers(5))
            lines[at] = notice
            rows.append((10 * i + k, "\n".join(lines)))
            want.add((10 * i + k, at, family))
    rows += [(800, words(20_000, 3) + "\nReleased under the MIT License."), (801, "\n\n\n"), (802, licenses._PLAIN[0])]
    want.add((800, 1, "mit"))
    got = {(r.doc_id, r.line, r.family) for r in licenses.scan(make(spark, rows)).where("confirmed").collect()}
    assert got == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "Released under the MIT License.")] * 2
    assert [r.family for r in licenses.scan(make(spark, rows)).collect()] == ["mit", "mit"]
    assert licenses.scan(make(spark, [])).count() == 0


def test_wrapped_notices_are_confirmed_at_their_first_line(spark, words):  # noqa: F811
    import textwrap
    rows, want = [], set()
    long = [(family, n) for family in ("mit", "bsd", "gpl") for n in licenses.NOTICES[family] if len(n) > 100]
    assert len(long) == 3
    for i, (family, notice) in enumerate(long):
        for j, (width, mark) in enumerate(((80, ""), (76, " * "), (72, "# "), (40, "// "))):
            wrap = [mark + x for x in textwrap.wrap(notice, width)]
            assert len(wrap) > 1
            for k, (before, after) in enumerate((([], []), ([words(12, 7), ""], ["", words(12, 8)]), ([words(12, 9)], [words(12, 10)]))):
                doc = 100 * i + 10 * j + k
                rows.append((doc, "\n".join([*before, *wrap, *after])))
                want.add((doc, len(before), family, True))
    # the parts of a notice far from each other are none
    first, second = textwrap.wrap(long[0][1], 80)[:2]
    rows.append((900, first + "\n\n" + words(30, 1) + "\n\n" + second))
    got = {(r.doc_id, r.line, r.family, r.confirmed) for r in licenses.scan(make(spark, rows)).collect() if r.doc_id < 900 or r.confirmed}
    assert got == want
