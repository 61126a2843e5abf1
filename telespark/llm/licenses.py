"""License notices in texts: MinHash bands over overlapping windows, then exact shingle containment. Built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by which well-known licenses are named or granted, with the license's SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

SHINGLE = 5
CONTAINED = 0.8
#: Shingles of a window, and from one window's start to the next.
WINDOW, STRIDE = 8, 4
BANDS = 64
#: Each with bands by other bits and an order of its own: a shingle is lost only where all of them lose it.
PERMUTATIONS = 6
#: Most shingles of all templates: they are a constant of the plan.
TEMPLATE_SHINGLES = 100_000


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text's words (runs of letters and digits, in lower case), in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(SHINGLE)])))

    return F.coalesce(F.element_at(F.transform(F.array(words), hashes), 1), F.expr("cast(array() as array<bigint>)"))


def _band(h: Column, permutation: int) -> Column:
    return F.pmod(F.shiftright(h, 5 + 8 * permutation), F.lit(BANDS))


def _ordered(h: Column, permutation: int) -> Column:
    """The hash by which a permutation orders shingles."""
    turn = permutation * 0x9E3779B97F4A7C15 % (1 << 64)
    return h.bitwiseXOR(F.lit(turn - (1 << 64) if turn >> 63 else turn))


def templates(spark: SparkSession, texts=TEMPLATES) -> DataFrame:
    """(template, license, shingles) of notices of five or more words."""
    rows = [(i, name, text) for i, (name, text) in enumerate(texts)]
    known = spark.createDataFrame(rows, "template int, license string, text string")
    return known.select("template", "license", shingles(F.col("text")).alias("marks")).where(F.size("marks") > 0)


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, template, start_word, end_word, containment): every place where a text holds a template.

    A text's shingles are cut into overlapping windows of WINDOW shingles. The shingle hashes of a window fall into BANDS bands by some of their
    bits, and the least of each band is its MinHash there (a row per band), in each of PERMUTATIONS ways. A template's shingles do the
    same, and a window retrieves the templates with which a band agrees. A shared shingle is lost only where a smaller one is in its band in every permutation: with 7 others
    over 64 bands in one by chance 0.054, in all six below 2e-6, and each shingle lies in two windows, but for the text's first. So exact containment decides. Agreement also tells where the template begins. There the share of its different shingles that the
    text holds, within a quarter of its length, must be CONTAINED or more. A find stays unless a better one overlaps it: more contained, then longer, earlier, first listed.

    One pass over whole texts without a shuffle: only texts with a hit leave it. The templates' hashes are a constant of the
    plan and bounded by TEMPLATE_SHINGLES. Null, empty and short texts have no finds, repeated rows have theirs each time.
    """
    known = templates(docs.sparkSession) if known is None else known
    marks = [(r["template"], r["license"], r["marks"]) for r in known.limit(TEMPLATE_SHINGLES + 1).collect()]
    keys = sorted({m for _, _, ms in marks for m in ms})
    if len(keys) > TEMPLATE_SHINGLES:
        raise ValueError(f"templates have {len(keys)} shingles; at most {TEMPLATE_SHINGLES} fit a plan")
    out = "doc_id", "license", "template", "start_word", "end_word", "containment"
    # Behind a one-element generator the hashes are made once a text, however often and deep they are used.
    read = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(shingles(F.col(text)))).alias("h"))
    if not keys:
        return read.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in zip(out[1:], ("string", "int", "int", "int", "double"), strict=True)]).where(F.lit(False))

    def window(p: Column) -> Column:
        part = F.slice(F.col("h"), p + 1, WINDOW)
        beaten = lambda x, i: F.exists(part, lambda y: (_band(y, i) == _band(x, i)) & (_ordered(y, i) < _ordered(x, i)))
        least = lambda x: ~reduce(and_, [beaten(x, i) for i in range(PERMUTATIONS)])
        tagged = F.transform(part, lambda x, i: F.struct((p + i).alias("at"), x.alias("mark")))
        return F.filter(tagged, lambda x: x["mark"].isin(keys) & least(x["mark"]))

    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(STRIDE))).otherwise(F.expr("cast(array() as array<int>)"))
    # Windows without any shingle of a template are passed over at once.
    busy = F.filter(starts, lambda p: F.exists(F.slice(F.col("h"), p + 1, WINDOW), lambda x: x.isin(keys)))
    hits = read.select("doc_id", "h", F.explode(F.array(F.array_distinct(F.flatten(F.transform(busy, window))))).alias("hits")).where(F.size("hits") > 0)
    listed = known.select("template", "license", "marks", F.posexplode("marks").alias("offset", "mark"))
    found = hits.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "h", F.explode("hits").alias("hit")).join(F.broadcast(listed), F.col("hit.mark") == F.col("mark"))
    start = F.col("hit.at") - F.col("offset")
    slack = F.floor(F.size("marks") / 4).cast("int")
    low = F.greatest(start - slack, F.lit(0))
    region = F.slice(F.col("h"), low + 1, start + F.size("marks") + slack - low)
    share = F.size(F.array_intersect("marks", region)) / F.size(F.array_distinct("marks"))
    placed = found.select("doc_id", "row", "license", "template", start.alias("start"), F.size("marks").alias("length"), share.alias("containment")).where(F.col("containment") >= CONTAINED)
    place = F.struct("start", (F.col("start") + F.col("length") + SHINGLE - 1).alias("end"), "containment", "length", "license", "template")
    places = placed.groupBy("row", "doc_id").agg(F.collect_set(place).alias("places"))

    def best(p: Column) -> Column:
        rank = lambda x: F.struct(-x["containment"], -x["length"], x["start"], x["template"])
        return ~F.exists("places", lambda q: (q["start"] < p["end"]) & (p["start"] < q["end"]) & (rank(q) < rank(p)))

    kept = places.select("doc_id", F.explode(F.filter("places", best)).alias("p"))
    start_word = F.greatest(F.col("p.start"), F.lit(0))
    return kept.select("doc_id", "p.license", "p.template", start_word.alias("start_word"), F.col("p.end").alias("end_word"), "p.containment")
