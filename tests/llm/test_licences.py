import random
from collections import Counter

from tracelattice.llm import licences as L


def families(text):
    return {f for _, f in L.trained().classify(text)}


def test_held_out_accuracy():
    m, right, of = L.trained(), Counter(), Counter()
    for text, k in L.examples(99):
        of[k] += 1
        right[k] += families(text) == ({m.families[k - 1]} if k else set())
    share = {k: right[k] / of[k] for k in of}
    assert share[0] >= 0.98 and min(share.values()) >= 0.85 and sum(right.values()) / sum(of.values()) >= 0.95, share
    assert not any(families(t) for t in L.EVERYDAY)


def wrapped(text, width, mark):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += (" " if line else "") + w
    return "\n".join(mark + x for x in [*lines, line])


def test_wrapped_and_commented_notices_are_found():
    for family in ("mit", "bsd", "apache", "gpl", "lgpl", "mpl", "unlicense", "zlib"):
        for width, mark in ((40, ""), (60, "# "), (72, " * "), (30, "// ")):
            text = "import os\n\n" + wrapped(" ".join(L.NOTICES[family]), width, mark) + "\n\nprint(1)"
            assert {k for k in L.trained().classify(text)} == {(1, family)}, (family, width, mark)


def test_notices_within_one_long_line():
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))
    for family, names in L.NAMES.items():
        for notice in [*L.NOTICES.get(family, []), f"Licensed under the {names[0]}."]:
            for n in (0, 10, 40, 200):
                assert family in families(f"{prose(n)} {notice} {prose(n)}"), (family, n, notice)


OTHERS = [
    "Licensed under the Eclipse Public License 2.0", "Eclipse Public License - v 1.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "ISC License", "Licensed under the ISC license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "Open Database License (ODbL) v1.0", "This database is made available under the Open Database License", "Licensed under the EUPL, Version 1.2", "Academic Free License 3.0", "Released under the Microsoft Public License", "Common Development and Distribution License 1.0",
    "Licensed under the Open Software License 3.0", "SIL Open Font License, Version 1.1", "Python Software Foundation License Version 2", "Released under the WTFPL", "Universal Permissive License v1.0", "Licensed under the Artistic License 2.0",
]


def test_other_licences_are_given_no_family():
    given = [t for t in OTHERS if families(t)]
    assert len(given) <= 0.05 * len(OTHERS), given


def test_short_names_are_found():
    for text, family in (("Licensed under the Apache License", "apache"), ("MIT License", "mit"), ("Released under the GPL v2", "gpl"), ("license: MIT", "mit"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc")):
        assert families(text) == {family}, text


def test_scan_matches_the_model(spark):
    m = L.trained()
    held = [t for t, _ in L.examples(5)][::23]
    texts = [None, "", "\n\n \n", "no notice at all", "Released under the MIT License.\n\nprose\n \t\nLicensed under CC BY-NC 4.0.", "word " * 20000 + "\nSPDX-License-Identifier: MIT", " ".join(L.NOTICES["mit"]) + " x" * 90 + " ".join(L.NOTICES["apache"])]
    texts += ["\n\n".join(held[i : i + 4]) for i in range(0, len(held), 4)] + [" ".join(held[i : i + 9]) for i in range(0, len(held), 9)] + ["Released under the MIT License."] * 2
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, paragraph string, k string").repartition(3)
    got = {(r.doc_id, r.paragraph, r.family): round(r.probability, 6) for r in L.scan(df).collect()}
    assert got == {(i, k, f): round(p, 6) for i, t in enumerate(texts) for (k, f), p in m.classify(t).items()}
    assert {(4, 0, "mit"), (4, 2, "cc-by-nc"), (5, 0, "mit"), (6, 0, "mit"), (6, 0, "apache")} <= set(got)


def test_null_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "MIT License"), (None, "MIT License"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.family, r.word) for r in L.scan(df).collect()] == [(None, "mit", 0)] * 2


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
