"""License scans: MinHash bands over overlapping text windows, exact shingle containment.

DataFrame functions only. Texts become word hashes and word shingles. Texts
without any shingle of a template can't collide with one in any band and are
left out first. Around the others' template shingles, overlapping windows as
long as a template are signed; windows that share a band with a template are
verified by the share of the template's shingles that the window contains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import ID, TH, identified, stored

#: Words per shingle; a shorter notice is one shingle. Least share of a template's shingles.
WORDS, CONTAINED = 5, 0.8
#: A window with half of the shingles in common meets a template in a band with probability 1 - (1 - 0.5^2)^32 > 0.9998.
BANDS, ROWS = 32, 2
#: Templates' lengths are rounded up by steps of this factor; windows start every eighth of a length.
STEP, STRIDE = 1.25, 8
#: Largest number of templates whose bands are broadcast.
SMALL = 10_000

# Notices as their licences give them.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-short", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string").coalesce(1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often and deep in lambdas the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(h: Column, n: int) -> Column:
    """Hashes of n words in a row, in order; none if there are fewer words. h is a column or a let variable."""
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + F.lit(k)) for k in range(n))))) \
        .otherwise(F.array().cast("array<bigint>"))


def band_hashes(grams: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Band hashes of a set of shingles: each of `rows` least values of seeded rehashes."""
    def signed(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda k: F.array_min(F.transform(g, lambda x: F.xxhash64(x, k))))

    def banded(least: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(least, b * rows + 1, F.lit(rows))))

    return let(grams, lambda g: let(signed(g), banded))


def rounded(length: int) -> int:
    size = 1
    while size < length:
        size = max(size + 1, int(size * STEP))
    return size


def windows_of(length: int, n: int, grams: list[int]) -> Column:
    """Windows (start, distinct shingles, shingles with a margin) of the word hashes h, at multiples of the stride, that hold one of the grams."""
    stride, slack, mine = max(1, length // STRIDE), -(-length // 4), F.lit(grams).cast("array<bigint>")

    def around(s: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda p: F.array_contains(mine, F.get(s, p)))
        starts = F.transform(hits, lambda p: F.sequence(F.ceil(F.greatest(F.lit(0), p - (length - n)) / stride).cast("int"), F.floor(p / stride).cast("int")))

        def window(k: Column) -> Column:
            at = k * stride
            low = F.greatest(F.lit(0), at - slack)
            return F.struct(at.alias("start"), F.array_distinct(F.slice(s, at + 1, F.lit(length - n + 1))).alias("grams"),
                            F.slice(s, low + 1, F.lit(length - n + 1 + slack) + (at - low)).alias("wide"))

        return F.when(F.size(s) > 0, F.transform(F.array_distinct(F.flatten(starts)), window))

    return let(F.col("h"), lambda h: let(shingles(h, n), around))


def scan(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """Rows doc_id, license_id, containment, first_word, n_windows: the templates found in each document.

    containment: share of the template's shingles in the best window,
    first_word: where that window starts (the first of equally good ones),
    n_windows: windows that hold the template. Null or empty texts hold none.
    Rows equal in id and text count as one document. Templates without a word
    are ignored; without templates or documents there are no rows. Neither long
    texts nor frequent notices meet in one task.
    """
    known = notices.select(F.col("license_id"), F.col("text").alias("t_text")).filter("t_text is not null")
    known = known.withColumn("h", word_hashes(F.col("t_text"))).filter(F.size("h") > 0).drop("t_text")
    lengths = sorted(r[0] for r in known.select(F.size("h")).distinct().collect())
    # A class of templates: window length and words per shingle; classes are as few as the steps of the length.
    classes = sorted({(rounded(k), min(WORDS, k)) for k in lengths})
    parts = []
    for length, n in classes:
        mine = [k for k in lengths if (rounded(k), min(WORDS, k)) == (length, n)]
        parts.append(known.filter(F.size("h").isin(mine)).select(
            F.lit(length).alias("t_length"), F.lit(n).alias("t_n"), "license_id", F.array_distinct(shingles(F.col("h"), n)).alias("t_grams")))
    empty = "doc_id bigint, license_id string, containment double, first_word int, n_windows bigint"
    if not parts:
        return docs.sparkSession.createDataFrame([], empty)
    signed = parts[0]
    for p in parts[1:]:
        signed = signed.unionByName(p)
    signed = stored(signed, "templates")
    grams_of = {(r["t_length"], r["t_n"]): r["g"] for r in signed.groupBy("t_length", "t_n").agg(F.array_distinct(F.flatten(F.collect_list("t_grams"))).alias("g")).collect()}

    def overlaps(h: Column) -> Column:
        hit = F.lit(False)
        for n in sorted({n for _, n in classes}):
            every = sorted({g for (_, k), gs in grams_of.items() if k == n for g in gs})
            hit = hit | F.arrays_overlap(shingles(h, n), F.lit(every).cast("array<bigint>"))
        return hit

    texts = identified(docs, id_col, text_col)
    near = stored(texts.filter(let(word_hashes(F.col("text")), overlaps)).select(ID, TH, word_hashes(F.col("text")).alias("h")), "near")

    windows = None
    for length, n in classes:
        part = near.select(ID, TH, F.lit(length).alias("length"), F.lit(n).alias("n"), F.explode(windows_of(length, n, grams_of[length, n])).alias("w")).select(ID, TH, "length", "n", "w.*")
        windows = part if windows is None else windows.unionByName(part)

    bands = signed.select("t_length", "t_n", "license_id", "t_grams", F.posexplode(band_hashes(F.col("t_grams"))).alias("t_band", "t_hash"))
    if signed.count() <= SMALL:
        bands = F.broadcast(bands)
    met = windows.select("*", F.posexplode(band_hashes(F.col("grams"))).alias("band", "hash")).join(
        bands, (F.col("length") == F.col("t_length")) & (F.col("n") == F.col("t_n")) & (F.col("band") == F.col("t_band")) & (F.col("hash") == F.col("t_hash")))
    share = F.size(F.array_intersect("wide", "t_grams")) / F.size("t_grams")
    held = met.select(ID, TH, "license_id", "start", share.alias("share")).filter(F.col("share") >= contained).distinct()
    best = held.groupBy(ID, TH, "license_id").agg(F.max(F.struct("share", -F.col("start"))).alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return best.select(F.col(ID).alias("doc_id"), "license_id", F.col("best.share").alias("containment"), (-F.col("best.col2")).alias("first_word"), "n_windows")
