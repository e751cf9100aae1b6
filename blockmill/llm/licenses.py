"""Licence scans by a positional index of rare words; DataFrame functions only.

The index holds the notices' words that few notices share, with their positions and IDF. A notice is
looked for at every place where its mandatory phrase's rarest word stands, however many other licence
words a text holds; there the phrase has to stand word by word. A place's score is the IDF of the
notice's index words that stand at their positions around it. Texts without any word that some
mandatory phrase needs can't be labelled and are left out early.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.llm.common import LOWER, UPPER, spread_join, written

#: Fixed by the contract: the words, and the base phrases with their labels.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public notices: label, mandatory phrase, notice.
NOTICES = (
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "mit license", "Released under the MIT License"),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("gpl", "gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "general public license", "distributed under the terms of the General Public License"),
    ("lgpl", "lesser general public license", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "affero general public license", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def _index(notices=NOTICES):
    """Postings of words that at most a third of the notices hold: (notice, word, position, idf)."""
    words = [re.findall(WORDS, text.lower()) for _, _, text in notices]
    seen = Counter(w for ws in words for w in set(ws))
    idf = {w: math.log(len(notices) / n) for w, n in seen.items() if 3 * n <= len(notices)}
    return words, idf


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """docs (doc_id, text) with n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases; first_word and last_word are null without one. score
    is the share of a notice's IDF that the best verified place holds, at least 0.5 with a base phrase
    and 0 without any label. Null text is empty; every row of docs gives one row; equal texts get equal
    values. Columns of docs other than doc_id don't come along.
    """
    words, idf = _index(notices)
    keys = [key.split() for _, key, _ in notices]

    anchors = sorted({max(k, key=lambda w: (len(w) > 5, idf.get(w, 0), len(w), w)) for k in keys} | {"license"})
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.when(text.rlike("(?i)" + "|".join(anchors)), F.md5(text.cast("binary")))  # null: no phrase can stand there
    rows = docs.select("doc_id", name.alias("name"), F.regexp_count(text, F.lit(_WORDS_ANY_CASE)).cast("long").alias("n_words"))
    split = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({WORDS})"), F.lit(1))
    asked = docs.select(name.alias("name"), text.alias("text")).where(F.col("name").isNotNull()).groupBy("name").agg(F.first("text").alias("text"))
    texts = written(asked.select("name", split.alias("words")), "licence-texts")  # once a distinct text

    based = _verified(texts.withColumn("places", _base_places(F.col("words"))), notices, words, idf)
    base = F.array_compact(F.array(*[_labelled(n) for n, _ in sorted(BASE, key=lambda x: x[1])]))
    starts = F.transform("places", lambda p: p["start"])
    labelled = F.array_sort(F.array_distinct(F.concat(base, "found")))
    told = based.select(
        "name", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labelled, ",").alias("labels"),
        F.round(F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)), 6).alias("score"),
    )
    out = spread_join(written(rows, "licence-rows"), written(told, "licence-labels"), "name", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *[F.coalesce(c, none[c]).alias(c) if c in none else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def _base_places(words: Column) -> Column:
    """array<struct<start, phrase>> of all base phrases' places; empty for null words."""
    parts = []
    for phrase, _ in BASE:
        ws = phrase.split()
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), _standing(words, ws))
        parts.append(F.transform(starts, _place(phrase)))
    none = F.array().cast("array<struct<start:int,phrase:string>>")
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, F.concat(*parts)).otherwise(none)


def _standing(words: Column, ws: list[str]):
    def stands(i: Column) -> Column:
        here = F.get(words, i + (len(ws) - 1)) == ws[-1]  # the rarest first
        for k, w in enumerate(ws[:-1]):
            here = here & (F.get(words, i + k) == w)
        return F.coalesce(here, F.lit(False))

    return stands


def _place(phrase: str):
    return lambda i: F.struct(i.alias("start"), F.lit(phrase).alias("phrase"))


def _labelled(phrase: str):
    return F.when(F.exists("places", lambda p: p["phrase"] == phrase), F.lit(dict(BASE)[phrase]))


def _verified(texts: DataFrame, notices, words: list[list[str]], idf: dict[str, float]) -> DataFrame:
    """texts with found (labels of the notices that are verified; may repeat) and score, null without one."""
    rarest = [max(range(len(k)), key=lambda i, k=k: (idf.get(k[i], 0), len(k[i]), k[i])) for k in (key.split() for _, key, _ in notices)]
    seeds = sorted({key.split()[i] for (_, key, _), i in zip(notices, rarest, strict=True)})
    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(seeds))
    texts = texts.withColumn("spots", F.when(F.size("words") > 0, spots).otherwise(F.array().cast("array<int>")))
    shares = [_shares(key.split(), i, ws, idf).alias(f"share{n}") for n, ((_, key, _), i, ws) in enumerate(zip(notices, rarest, words, strict=True))]
    shared = texts.select("name", "places", *shares)
    found = F.array_compact(F.array(*[F.when(F.col(f"share{n}").isNotNull(), F.lit(label)) for n, (label, _, _) in enumerate(notices)]))
    best = F.array_max(F.array(*[f"share{n}" for n in range(len(notices))]))
    return shared.select("name", "places", found.alias("found"), F.when(best > 1, 1.0).otherwise(best).alias("score"))


def _shares(key: list[str], rarest: int, ws: list[str], idf: dict[str, float]) -> Column:
    """The largest share of a notice's IDF around a place of its phrase, null where the phrase never stands."""
    stands = _standing(F.col("words"), key)
    starts = F.filter("spots", lambda i: (i >= rarest) & stands(i - rarest))
    at = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key) + rarest
    held = F.array(*[F.struct(F.lit(p - at).alias("by"), F.lit(w).alias("word"), F.lit(idf[w]).alias("idf")) for p, w in enumerate(ws) if w in idf])
    total = sum(idf.get(w, 0.0) for w in ws)

    def share(i: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            return s + F.when((i + x["by"] >= 0) & (F.get("words", i + x["by"]) == x["word"]), x["idf"]).otherwise(0.0)

        return F.aggregate(held, F.lit(0.0), add) / total

    return F.array_max(F.transform(starts, share) if total else F.transform(starts, lambda i: F.lit(0.0)))
