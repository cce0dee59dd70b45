"""License scans, in DataFrame operations only.

Templates are cut into pieces of at most 24 words. Pieces of similar length share a scale: a window width and stride
for which every piece lies whole in some window, and for which the piece's pairs of words are at least 0.29 of the
window's. A window and a piece meet if one of ``n_bands`` MinHash bands of one row agrees, so a piece that stands
whole in a window is found with probability 1 - (1 - share)**n_bands: 0.9997 at the least share, with 24 bands. One
changed word costs a piece of 24 words two of its 23 pairs, a ten-word piece with a changed end word still has 0.25
of the window's and 0.999. Pieces only retrieve: each gives those of its five-word shingles that stand in the windows
it meets, and a template is decided once, by the share of its distinct shingles found so.

Templates of one or two words are joined on these words, without bands.

Before windows are made, texts without any anchor word are left out. A text that holds four fifths of a template's
distinct shingles holds one of any shingles that are more than a fifth of them. An anchor is the longest word of each
of so many shingles of the template. So the anchors of all templates lose no match, whatever the band settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5  # of a shingle
LEAST = 0.8  # of a template's shingles
PIECE, PIECE_STEP = 24, 12
# Longest piece in words, window width, stride: width - stride + 1 is at least the piece.
SCALES = ((4, 6, 2), (9, 12, 4), (PIECE, 32, 8))
MOST_ANCHORS = 2000
MOST_BROADCAST = 20_000  # pieces; each has a row a band, of some hundred bytes

# Fixed texts: public license notices.
TEMPLATES = (
    (1, "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (2, "MIT", "Released under the MIT License."),
    (3, "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (4, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (5, "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (6, "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (7, "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (8, "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    (9, "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (10, "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (11, "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (12, "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "template_id int, license string, text string")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(0)), F.array().cast("array<string>"))


def _pairs(w: str) -> Column:
    """64-bit names of neighbouring words; a lone word is a pair with nothing."""
    many = f"transform(sequence(1, size({w}) - 1), i -> xxhash64({w}[i - 1], {w}[i]))"
    return F.expr(f"case when size({w}) > 1 then {many} when size({w}) = 1 then array(xxhash64({w}[0])) else cast(array() as array<bigint>) end")


def _minima(pairs: str, n_bands: int) -> Column:
    """One minimum a band: (band, least name under the band's hash) as one 64-bit name."""
    return F.expr("array(" + ", ".join(f"xxhash64({k}, array_min(transform({pairs}, x -> xxhash64(x, {k}))))" for k in range(n_bands)) + ")")


def _shingles(w: str, k: str) -> str:
    return f"array_distinct(transform(sequence(0, size({w}) - {k}), i -> array_join(slice({w}, i + 1, {k}), ' ')))"


def pieces_of(templates: DataFrame) -> DataFrame:
    """(template_id, license, piece, w, k, shingles, scale) of every template with a word."""
    w = templates.select("template_id", "license", words(F.col("text")).alias("all")).filter("size(all) > 0")
    cuts = F.expr(f"case when size(all) <= {PIECE} then array(0) else sequence(0, size(all) - {PIECE} + {PIECE_STEP} - 1, {PIECE_STEP}) end")
    rows = w.select("template_id", "license", "all", F.posexplode(cuts).alias("piece", "at"))
    rows = rows.select("template_id", "license", "piece", F.expr(f"slice(all, least(at, greatest(size(all) - {PIECE}, 0)) + 1, {PIECE})").alias("w"))
    rows = rows.withColumn("k", F.expr(f"least({WORDS}, size(w))")).withColumn("shingles", F.expr(_shingles("w", "k")))
    scale = F.expr("case " + " ".join(f"when size(w) <= {most} then {n}" for n, (most, _, _) in enumerate(SCALES)) + " end")
    return rows.withColumn("scale", scale)


def wholes_of(templates: DataFrame) -> DataFrame:
    """(template_id, n_shingles, anchors) of every template with a word. Of the distinct shingles, those with the
    longest words give the anchors; the words that sort first, of equals."""
    w = templates.select("template_id", words(F.col("text")).alias("all")).filter("size(all) > 0")
    rows = w.withColumn("k", F.expr(f"least({WORDS}, size(all))")).withColumn("shingles", F.expr(_shingles("all", "k")))
    longest = "array_min(transform(split(s, ' '), x -> struct(-length(x) as n, x as x)))"
    anchors = f"array_distinct(transform(slice(array_sort(transform(shingles, s -> {longest})), 1, cast(size(shingles) / 5 as int) + 1), y -> y.x))"
    return rows.select("template_id", F.size("shingles").alias("n_shingles"), F.expr(anchors).alias("anchors"))


def scan(docs: DataFrame, templates: DataFrame, n_bands: int = 24) -> DataFrame:
    """A row per doc_id and template found in it: doc_id, template_id, license, pieces_found (those with at least four
    fifths of their shingles found), pieces, containment (share of the template's distinct shingles found), first_word
    (of the first window that holds one).

    A template is found where at least four fifths of its distinct shingles are, wherever they stand in the text.
    Null, empty and wordless texts and templates hold nothing; rows that repeat a doc_id count as
    one document; a null doc_id is a document of its own. Empty tables give no rows; further columns are not read.
    Texts stay in their partition: up to MOST_BROADCAST pieces go to the windows, and only
    found shingles are exchanged; with more, windows and pieces are exchanged by band.
    """
    templates = templates.select(templates["template_id"], templates["license"], templates["text"])
    pieces, wholes = pieces_of(templates), wholes_of(templates)
    anchors = [r.anchor for r in wholes.select(F.explode("anchors").alias("anchor")).distinct().limit(MOST_ANCHORS + 1).collect()]
    long, short = pieces.filter("size(w) > 2"), pieces.filter("size(w) <= 2")
    scales = sorted(r.scale for r in long.select("scale").distinct().collect())
    shorts, few = short.count(), pieces.count() <= MOST_BROADCAST
    rows = docs.select(docs["doc_id"], F.lower(docs["text"]).alias("low")).filter("low is not null")
    if len(anchors) <= MOST_ANCHORS:
        rows = rows.filter(F.col("low").rlike("|".join(sorted(anchors)) or "(?!)"))  # anchors are letters and digits
    rows = rows.select("doc_id", words(F.col("low")).alias("w")).filter("size(w) > 0").withColumn("g", _pairs("w"))
    windows = []
    for n in scales:
        _, width, stride = SCALES[n]
        made = F.expr(f"transform(sequence(0, greatest(size(w) - {width} + {stride} - 1, 0), {stride}), s -> struct({n} as scale, s as at, slice(w, s + 1, {width}) as ww, slice(g, s + 1, {width - 1}) as gg))")
        windows.append(made)
    if not windows and not shorts:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, template_id int, license string, pieces_found bigint, pieces bigint, containment double, first_word int")
    met = []
    if windows:
        cut = rows.select("doc_id", F.explode_outer(F.flatten(F.array(*windows))).alias("win")).select("doc_id", "win.*")
        cut = cut.withColumn("band", _minima("gg", n_bands)).select("doc_id", "scale", "at", "ww", F.explode_outer("band").alias("band"))
        keyed = long.withColumn("g", _pairs("w")).withColumn("band", _minima("g", n_bands)).select("template_id", "license", "piece", "k", "shingles", "scale", F.explode_outer("band").alias("band"))
        keyed = F.broadcast(keyed) if few else keyed
        held = F.expr(f"array_intersect(shingles, {_shingles('ww', 'k')})")
        met.append(cut.join(keyed, ["scale", "band"]).filter("size(ww) >= k").select("doc_id", "template_id", "license", "piece", F.size("shingles").alias("n"), "at", F.explode(held).alias("shingle")))
    if shorts:
        ones = "transform(w, (x, i) -> struct(x as shingle, i as at))"
        twos = "transform(w, (x, i) -> struct(concat(x, ' ', get(w, i + 1)) as shingle, i as at))"  # null after the last
        each = rows.select("doc_id", F.explode(F.expr(f"concat({ones}, {twos})")).alias("x")).select("doc_id", "x.*").filter("shingle is not null")
        names = short.select("template_id", "license", "piece", F.size("shingles").alias("n"), F.element_at("shingles", 1).alias("shingle"))
        met.append(each.join(F.broadcast(names) if few else names, "shingle").select("doc_id", "template_id", "license", "piece", "n", "at", "shingle"))
    met = met[0].unionByName(met[1]) if len(met) > 1 else met[0]
    per = met.groupBy("doc_id", "template_id", "license", "piece", "n").agg(F.collect_set("shingle").alias("found"), F.min("at").alias("at"))
    total = pieces.groupBy("template_id").agg(F.count("*").alias("pieces")).join(wholes.groupBy("template_id").agg(F.max("n_shingles").alias("n_shingles")), "template_id")
    whole = per.groupBy("doc_id", "template_id", "license").agg(F.count_if(F.size("found") >= LEAST * F.col("n")).alias("pieces_found"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"), F.min("at").alias("first_word"))
    out = whole.join(total, "template_id").withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return out.filter(F.col("containment") >= LEAST).select("doc_id", "template_id", "license", "pieces_found", "pieces", "containment", "first_word")
