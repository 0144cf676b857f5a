"""Licence notices against planted paragraphs."""

from tablekeep.llm import licenses

PLANTED = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("All rights reserved.", "reserved"),
    ("Licensed under the GNU Lesser General Public License, version 2.1", "lgpl"),
]
ORDINARY = ["He lost his driving licence.", "The permission is still out.", "", "a b c", "They were released under cover of night"]


def test_notices(spark):
    corpus = [(100 + i, f"ordinary line {i} of the corpus with words") for i in range(50)]
    docs = [(i, f"first\n{text}\nlast") for i, (text, _) in enumerate(PLANTED)] + [(50 + i, t) for i, t in enumerate(ORDINARY)]
    docs += [(90, None), (None, PLANTED[0][0]), (0, docs[0][1]), (91, "x " * 20000 + "\n" + "\n".join(t for t, _ in PLANTED))] + corpus
    frame = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, TEXT int")
    got = licenses.licence_notices(frame).collect()
    assert len(got) == len(docs)
    found = {r.doc_id: [(n.paragraph, n.family) for n in r.notices] for r in got}
    for i, (_, family) in enumerate(PLANTED):
        assert found[i] == [(1, family)], i
    assert found[91] == [(k + 1, f) for k, (_, f) in enumerate(PLANTED)] and found[None] == [(0, "mit")]
    assert not any(found[50 + i] for i in range(len(ORDINARY))) and not found[90] and not any(found[i] for i, _ in corpus)
    assert licenses.licence_notices(frame.limit(0)).count() == 0


def test_short_wrapped_and_uncued_notices(spark):
    cases = [
        ("Licensed under Apache 2.0", [(0, "apache")]),
        ("MIT License", [(0, "mit")]),
        ("a title\n\nLicensed under the Apache\nLicense, Version 2.0", [(2, "apache")]),
        ("CC BY-SA 4.0", [(0, "cc-by-sa")]),
        ("Distributed under the GPL", [(0, "gpl")]),
        ("one\n \nThis library is distributed in the hope\nthat it will be useful", [(2, "lgpl")]),
        ("Released under the MIT License.\nLicensed under the Apache\nLicense, Version 2.0", [(0, "mit"), (1, "apache")]),
    ]
    hard = [f"driving licence number {i}, permission is still out, and they were released under cover of night {i}" for i in range(40)]
    docs = [(i, t) for i, (t, _) in enumerate(cases)] + [(100 + i, t) for i, t in enumerate(hard)]
    got = {r.doc_id: [(n.paragraph, n.family) for n in r.notices] for r in licenses.licence_notices(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert not any(got[100 + i] for i in range(len(hard)))


def test_ordinary_sample_is_distinct_and_scored(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licenses, "fit", lambda rows, held: seen.append(([g for g, c in rows if not c], held)) or ({}, []))
    docs = ["a driving license for all"] * 300 + [f"the license of driver {i}" for i in range(30)] + ["no such word here", "MIT License"] * 30
    licenses.train(spark.createDataFrame([(t,) for t in docs], "text string"))
    fitted, held = ([tuple(g) for g in x] for x in seen[0])
    assert len(fitted) + len(held) == len({*fitted, *held}) == 31 and abs(len(fitted) - len(held)) <= 1
    assert all("license" in g for g in fitted + held) and not any("mit" in g for g in fitted + held)
