import re

from blockmill.llm import licenses
from tests.llm.fixtures import documents, nothing

CASES = [
    (500, "Released under the MIT License. And the mit-license again, MIT\nLICENSE", "en", "a", 0),
    (501, "Licensed under the Apache License, Version 2.0.", "en", "a", 0),
    (502, "GNU Lesser General Public License and the Apache license; no mit licenses", "en", "a", 0),
    (503, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "en", "a", 0),
    (504, "a licence, an MİT License, emit license, mit the license", "en", "a", 0),
    (505, "Licensed under CC BY-NC 4.0. " + "word " * 3000, "en", "a", 0),
    (506, "general public license", "en", "a", 0),
    (507, "permission free charge hereby granted is of", "en", "a", 0),
    (508, "Redistribution and use in source and binary forms, with or without modification, are permitted", "en", "a", 0),
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = {label for label, phrase, _ in licenses.NOTICES if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
    base = sorted({b for _, b in places})
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(sorted(found | set(base)))


def test_equals_brute_force(spark):
    docs = documents(spark, CASES)
    rows = licenses.scan_licenses(docs).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word if r.first_word is not None else -1, r.last_word if r.last_word is not None else -1, r.base_labels, r.labels) for r in rows)
    want = []
    for r in docs.collect():
        n, k, a, b, base, labels = brute(r.text)
        want.append((r.doc_id or -1, n, k, -1 if a is None else a, -1 if b is None else b, base, labels))
    assert got == sorted(want)
    score = {r.doc_id: r.score for r in rows}
    assert score[505] == 1.0 and score[507] == 0.0 and 0 < score[503] < 1 and score[506] >= 0.5
    assert all(0 <= s <= 1 for s in score.values())


PROSE = "At 3 they can charge a program for code, if conditions that are met may follow: files, forms, either option, except your work, it was later subject to a purpose. "


def test_long_texts_with_late_notices(spark):
    """Texts with many everyday words of the index keep every notice."""
    texts = [PROSE * 20 + notice + ". " + PROSE for _, _, notice in licenses.NOTICES]
    texts += [PROSE + key for _, key, _ in licenses.NOTICES] + [key + " " + PROSE for _, key, _ in licenses.NOTICES]
    texts += [PROSE + ". ".join(notice for _, _, notice in licenses.NOTICES), " ".join(ws[-1] for ws in (key.split() for _, key, _ in licenses.NOTICES)) + PROSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert {i: (r.base_labels, r.labels) for i, r in got.items()} == {i: brute(t)[4:] for i, t in enumerate(texts)}
    assert all(got[i].score == 1.0 for i in range(len(licenses.NOTICES)))


def test_all_notices_in_one_text(spark):
    """All labels, by the scan and by its SQL."""
    import duckdb
    import pandas as pd

    from blockmill.llm import oracles

    text = PROSE + ". ".join(notice for _, _, notice in licenses.NOTICES) + PROSE * 30
    found = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    documents = pd.DataFrame({"doc_id": [1], "text": [text]})  # noqa: F841
    want = duckdb.connect().execute(oracles.op8_license_scan).fetchone()
    assert tuple(found) == want
    assert found.labels == ",".join(sorted({label for label, _, _ in licenses.NOTICES})) and found.labels.count(",") == 10


def test_plan_has_no_python(spark):
    plan = licenses.scan_licenses(documents(spark, CASES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_rows(spark):
    assert licenses.scan_licenses(nothing(spark)).count() == 0
