"""License scans: whole texts over several lines, notices inside other text, edits, near wordings, many occurrences, empty tables."""

import textwrap

from tallyforge.llm import licenses

DOC = "doc_id long, text string, line int, license string"
MIT = licenses.NOTICES["MIT"][1]


def found(spark, texts):
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    out = {}
    for r in licenses.find(spark.createDataFrame(rows, DOC)).collect():
        out.setdefault(r.doc_id, []).append((r.line, r.license, r.differing))
    return {k: sorted(v) for k, v in out.items()}


def test_scans(spark):
    wrapped = "Intro line.\n\n" + textwrap.fill(f"Copyright 2020 Someone. {MIT}", 60) + "\nThe end."
    edited = MIT.replace("sublicense, and/or sell", "lend, and/or rent")
    texts = [
        wrapped,
        "words before, Copyright 2020 X. Released under the MIT License. and more words after it",
        "Released under the BSD-2-Clause license",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        edited,
        "Licensed under CC BY-SA 4.0.\nLicensed under CC BY 4.0.\n" * 40,
        "the licence talk of other things, copyright and all",
        None,
        "",
        "x " * 30_000 + "\n" + MIT + "\n" + "y " * 30_000,
        licenses.NOTICES["BSD-3-Clause"][1].replace("[", "").replace("]", ""),
    ]
    got = found(spark, texts)
    assert got[0] == [(2, "MIT", 0)]
    assert got[1] == [(0, "MIT", 0)]
    assert got[2] == [(0, "BSD-2-Clause", 0)]
    assert got[3] == [(0, "LGPL-3.0", 0)]
    assert got[4] == [(0, "GPL-2.0", 0)]
    assert [x[:2] for x in got[5]] == [(0, "MIT")] and 0 < got[5][0][2] <= 4
    assert got[6] == sorted([(2 * k, "CC-BY-SA-4.0", 0) for k in range(40)] + [(2 * k + 1, "CC-BY-4.0", 0) for k in range(40)])
    assert got[10] == [(1, "MIT", 0)]
    assert got[11] == [(0, "BSD-3-Clause", 0)]
    assert not {7, 8, 9} & set(got)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(2**60 + 1, "Released under the MIT License.", 1, "x"), (None, "Released under the MIT License.", 1, "x")] * 2, DOC).coalesce(1)
    assert sorted(str(r.doc_id) for r in licenses.find(docs).collect()) == sorted([str(2**60 + 1)] * 2 + ["None"] * 2)
    assert licenses.find(docs.limit(0)).count() == 0


def plain(text):
    return text.replace("[", "").replace("]", "")


def test_one_row_per_notice_and_tags(spark):
    apache = " ".join(plain(n) for n in licenses.NOTICES["Apache-2.0"])
    gpl = plain(licenses.NOTICES["GPL-3.0"][2])
    texts = [
        apache, f"{apache}\n\n{apache}", gpl, gpl.replace("version 3", "version 2"), "# SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-2.0-or-later\ncode", "SPDX-License-Identifier: Apache-2.0 " + apache,
        gpl.replace("GNU General", "GNU Affero General"), "SPDX-License-Identifier: Other-1.0", "Released under the MIT License.\nReleased under the MIT License.",
    ]
    got = {k: [(line, name) for line, name, _ in v] for k, v in found(spark, texts).items()}
    assert got == {
        0: [(0, "Apache-2.0")], 1: [(0, "Apache-2.0"), (2, "Apache-2.0")], 2: [(0, "GPL-3.0")], 3: [(0, "GPL-2.0")], 4: [(0, "MIT")], 5: [(0, "GPL-2.0")], 6: [(0, "Apache-2.0")] * 2, 7: [(0, "AGPL-3.0")], 9: [(0, "MIT"), (1, "MIT")],
    }


def test_exact_notices_against_a_search_for_their_words(spark):
    """Every place where the words of a single-part notice stand is found, and no exact one beside."""
    import random

    rng = random.Random(3)
    notices = {plain(v[0]): k for k, v in licenses.NOTICES.items() if len(v) == 1 or k in ("MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0")}
    notices |= {f"SPDX-License-Identifier: {t}": k for k, tags in licenses.TAGS.items() for t in tags}
    texts = ["\n".join(rng.choice([*notices] + ["some other words of the text", "a licence is spoken of", "x" * 50] * 9) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    got = sorted((r.doc_id, r.line, r.license) for r in licenses.find(spark.createDataFrame(rows, DOC)).where("exact").collect())
    words = lambda t: [w.lower() for w in licenses._WORD.findall(t)]
    known = {tuple(words(n)): k for n, k in notices.items()}
    want = sorted((k, n, known[w]) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if (w := tuple(words(line))) in known)
    assert got == want and len(want) > 200
