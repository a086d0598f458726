"""Licence scans by MinHash over overlapping windows, by column functions alone.

Templates and documents are cut into word shingles. A template of L words is looked for in windows of L words
that start every max(1, L // 8) words, so some window holds all but an eighth of an occurrence. Window and template are
compared by `bands` MinHash values of one row each: two sets of similarity s share a band with
probability 1 - (1 - s)^bands, over 0.99999 at s = 0.5 and 18 bands. What the bands retrieve is verified exactly: the share of
the template's shingles that the window and its surroundings (half a length on either side) hold must reach `containment`.

Only windows that can hold a match are built. A template's anchors are words that together are in more than 1 - containment
of its shingles, so a window without any anchor misses too many shingles to match. Texts are searched for
anchors with one pattern, then words.

The templates are the caller's list (`LICENCES` by default), so their signatures are broadcast.

Defined results: null and empty texts and templates match nothing; a template shorter than a shingle is one shingle, found as a run of its
words; each document and licence gives one row with the window that holds most itself, the earliest on ties; repeated rows of
a document give one row; a null id is kept; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwellspark.llm.fingerprints import _LOWER, _UPPER

# Licence notices as their publishers word them.
LICENCES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced",
    "All rights reserved (alone)": "All rights reserved.",
    "MIT (short)": "under the MIT License",
    "MIT (shorter)": "under MIT license",
    "BSD no endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "GPL-2.0": "either version 2 of the License, or (at your option) any later version",
    "LGPL notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC0-1.0": "CC0 1.0 Universal",
}
PARTS = "[^a-z0-9]+"


def template_words(text: str) -> list[str]:
    """Words of a template as `words_of` gives them."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def anchors(words: list[str], n: int, containment: float) -> list[str]:
    """Words of a template without which a window cannot hold `containment` of its shingles: longest first,
    until shingles without any are too many to miss."""
    k = min(n, len(words))
    left = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()
    size, chosen = len(left), []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < containment * size:
            break
        rest = {s for s in left if w not in s}
        if len(rest) < len(left):
            chosen.append(w)
            left = rest
    return chosen


def words_of(text: Column) -> Column:
    """Words of a text: runs of letters a-z (A-Z in lower case) and digits."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), PARTS), lambda w: w != "")


def shingles(words: Column, n: int | Column) -> Column:
    """Distinct n-word shingles of a word array as strings; fewer words are one."""
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))


def signature(sh: Column, bands: int) -> Column:
    """MinHash values, one hash function a band."""
    return F.array(*[F.array_min(F.transform(sh, lambda s, b=b: F.xxhash64(s, F.lit(b)))) for b in range(bands)])


def scan(docs: DataFrame, licences: dict[str, str] | None = None, n: int = 5, containment: float = 0.8, bands: int = 18) -> DataFrame:
    """doc_id, licence, start, stop (words of the best window) and held (share of the template's shingles)."""
    spark: SparkSession = docs.sparkSession
    known = {k: w for k, v in (LICENCES if licences is None else licences).items() if (w := template_words(v or ""))}
    names = list(known)
    if not names:
        return spark.createDataFrame([], "doc_id long, licence string, start int, stop int, held double")
    held_by = {k: anchors(known[k], n, containment) for k in names}
    every, longest = sorted({a for v in held_by.values() for a in v}), max(map(len, known.values()))
    given = spark.createDataFrame([(k, known[k], len(known[k])) for k in names], "licence string, t_words array<string>, size int")
    table = given.withColumn("t_shingles", shingles(F.col("t_words"), n)).select(
        "licence", "size", "t_shingles", F.posexplode(signature(F.col("t_shingles"), bands)).alias("band", "value"))
    asked = spark.createDataFrame(sorted({(len(known[k]), a) for k in names for a in held_by[k]}), "size int, word string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike("(?i)" + "|".join(every)))
    worded = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    spots = worded.select("doc_id", "words", F.explode(F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda s: s["word"].isin(every))).alias("s"))
    # From here on rows carry the words near an anchor alone.
    off = F.greatest(F.lit(0), F.col("s.at") - 2 * longest)
    near = spots.select("doc_id", "s.at", "s.word", off.alias("off"), F.slice("words", off + 1, 4 * longest).alias("context"))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / 8)).cast("int")
    lined = near.join(F.broadcast(asked), "word").withColumn("i", F.explode(F.sequence(  # the templates' anchors: the caller's list
        F.ceil(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1) / step), F.floor(F.col("at") / step))))
    windows = lined.withColumn("start", (F.col("i") * step).cast("int")).select(
        "doc_id", "size", "start", F.slice("context", F.col("start") - F.col("off") + 1, F.col("size")).alias("window"),
        F.slice("context", F.greatest(F.lit(1), F.col("start") - F.col("off") + 1 - F.floor(F.col("size") / 2).cast("int")),
                F.col("size") + 2 * F.floor(F.col("size") / 2).cast("int")).alias("around")).distinct()
    banded = windows.select("doc_id", F.col("size").alias("w_size"), "start", "window", "around",
                            F.posexplode(signature(shingles(F.col("window"), n), bands)).alias("band", "value"))
    found = banded.join(F.broadcast(table), ["band", "value"]).where("w_size = size").select(  # the caller's templates
        "doc_id", "licence", "size", "start", "window", "around", "t_shingles").distinct()
    share = lambda part: F.size(F.array_intersect("t_shingles", shingles(F.col(part), F.least(F.lit(n), F.col("size"))))) / F.size("t_shingles")
    good = found.withColumn("own", share("window")).withColumn("held", share("around")).where(F.col("held") >= containment)
    best = good.groupBy("doc_id", "licence").agg(F.min_by(F.struct("start", "size", "held"), F.struct(-F.col("own"), "start")).alias("b"))
    return best.select("doc_id", "licence", F.col("b.start").alias("start"), (F.col("b.start") + F.col("b.size")).alias("stop"), F.col("b.held").alias("held"))


def scan_sql(licences: dict[str, str] | None = None, n: int = 5, containment: float = 0.8) -> str:
    """The same rows in DuckDB SQL, by meeting every shingle of every document with the templates'."""
    known = {k: template_words(v) for k, v in (LICENCES if licences is None else licences).items()}
    values = ", ".join(f"('{k}', {len(w)}, [{', '.join(repr(x) for x in w)}])" for k, w in known.items())
    return f"""
    WITH t(licence, size, w) AS (VALUES {values}),
    ts AS (SELECT DISTINCT licence, size, least({n}, size) AS k, list_slice(w, i, i + least({n}, size) - 1) AS sh
           FROM (SELECT *, unnest(range(1, greatest(size - {n} + 1, 1) + 1)) AS i FROM t)),
    need AS (SELECT licence, count(*) AS total FROM ts GROUP BY 1),
    d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
    ds AS (SELECT doc_id, k, i - 1 AS pos, list_slice(w, i, i + k - 1) AS sh
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM ts))),
    m AS (SELECT ds.doc_id, ts.licence, ts.size, ts.k, ts.sh, ds.pos, greatest(1, ts.size // 8) AS step FROM ds JOIN ts ON ds.k = ts.k AND ds.sh = ts.sh),
    s AS (SELECT DISTINCT doc_id, licence, size, step * unnest(range(CAST(ceil(greatest(0, pos + k - size) / step) AS BIGINT), pos // step + 1)) AS start FROM m),
    c AS (SELECT s.doc_id, s.licence, s.size, s.start,
                 count(DISTINCT CASE WHEN m.pos >= s.start AND m.pos + m.k <= s.start + s.size THEN m.sh END) AS own,
                 count(DISTINCT CASE WHEN m.pos >= s.start - s.size // 2 AND m.pos + m.k <= s.start + s.size + s.size // 2 THEN m.sh END) AS held
          FROM s JOIN m ON s.doc_id = m.doc_id AND s.licence = m.licence GROUP BY ALL),
    g AS (SELECT c.*, CAST(held AS DOUBLE) / total AS share FROM c JOIN need USING (licence) WHERE CAST(held AS DOUBLE) / total >= {containment})
    SELECT doc_id, licence, CAST(start AS INTEGER) AS start, CAST(start + size AS INTEGER) AS stop, share AS held FROM g
    QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY own DESC, start) = 1"""
