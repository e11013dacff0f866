"""License scans by diagonal voting.

Rolling hashes of ``GRAM`` words of every text are joined by Spark to the positions of the same hashes in license
templates.  A hit votes for its diagonal (place in the text less place in the template); votes are summed by (text,
template, diagonal).  Votes of neighbouring diagonals, at most ``SHIFT`` apart, are merged, so that a word put in or left out
does not break a passage; since a hit lies within its template's length of its diagonal, merged votes come from one window
of the text, of the template's length and ``SHIFT`` words more on either side.  Windows with enough votes are verified by the longest common
subsequence of their words and the template's; of neighbouring windows the best one is kept, the first of several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import LOWER, UPPER, drop_written, small_side, written

#: Words in a rolling hash; no template is shorter.
GRAM = 2
#: Diagonals that far apart are one passage; a passage must hold this share of its template's words.
SHIFT, COVER = 3, 0.9
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A phrase that means ``label``.  ``exact`` ones must stand word for word, and count as base phrases."""

    label: str
    text: str
    exact: bool = False


BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

#: Short notices as their authors publish them, with the common variants.
MORE = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "licensed under the mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "licensed under the bsd license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc0", "dedicated to the public domain under cc0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lowered, runs of ASCII letters and digits and of everything outside ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), _GAP), "")


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, place, gram): bounded by the templates given, never by the data."""
    rows = [(i, t.text.split()) for i, t in enumerate(templates)]
    short = [t.text for t in templates if len(t.text.split()) < GRAM]
    if short:
        raise ValueError(f"templates of fewer than {GRAM} words: {short}")
    t = spark.createDataFrame(rows, "template int, words array<string>")
    return t.select("template", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - GRAM), lambda i: _gram("words", i))).alias("place", "gram"))


def _gram(words: str, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, (i + j).cast("int")) for j in range(GRAM)))


def votes(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(row_id, template, diagonal, n, first, last): hits of each diagonal and where they begin and end in the text."""
    w = docs.select("row_id", words_of(F.col("text")).alias("w")).where(F.size("w") >= GRAM)
    grams = w.select("row_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - GRAM), lambda i: _gram("w", i))).alias("at", "gram"))
    hits = grams.join(F.broadcast(template_table(docs.sparkSession, templates)), "gram")
    return hits.groupBy("row_id", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def spans(found: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(row_id, template, start, past): windows whose merged votes can cover enough of their template.

    Exact templates need all their votes on one diagonal, and every such diagonal is a window.
    """
    size = F.create_map(*(x for i, t in enumerate(templates) for x in (F.lit(i), F.lit(len(t.text.split())))))
    exact = F.create_map(*(x for i, t in enumerate(templates) for x in (F.lit(i), F.lit(t.exact))))
    near = Window.partitionBy("row_id", "template").orderBy("diagonal").rangeBetween(-SHIFT, SHIFT)
    f = found.withColumns({"size": size[F.col("template")], "exact": exact[F.col("template")], "votes": F.sum("n").over(near)})
    enough = F.when(F.col("exact"), F.col("n") >= F.col("size") - GRAM + 1).otherwise(F.col("votes") + GRAM - 1 >= F.ceil(COVER * F.col("size") / 2))
    room = F.when(F.col("exact"), 0).otherwise(SHIFT)
    f = f.where(enough)
    return f.select("row_id", "template", F.greatest(F.col("diagonal") - room, F.lit(0)).cast("int").alias("start"), (F.col("diagonal") + F.col("size") + room).cast("int").alias("past"))


def common_words(have: Column, want: Column) -> Column:
    """Length of the longest common subsequence of two word arrays: one row of the table for each word of ``have``."""
    first = F.array_repeat(F.lit(0), F.size(want) + 1)

    def row(above: Column, word: Column) -> Column:
        def cell(now: Column, i: Column) -> Column:
            left = F.element_at(now, -1)
            diagonal = F.get(above, i) + F.when(F.get(want, i) == word, 1).otherwise(0)
            return F.concat(now, F.array(F.greatest(left, F.get(above, i + 1), diagonal)))

        return F.aggregate(F.sequence(F.lit(0), F.size(want) - 1), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(have, first, row), -1)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + MORE, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: row_id, n_words, hits array<struct<template, label, exact, start, past, cover>>.

    Hits are verified in the text: ``cover`` is the share of the template's words that stand in the window in order, 1 for
    exact ones; ties of votes go to the first diagonal.  Null and empty texts have no words and no hits; texts of any length
    are read whole; repeated rows are scanned each, and rows that share an id, the null id too, get the hits that their own
    text has; no rows give no rows; other columns don't matter.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
    place = written(spans(votes(rows, templates), templates), "spans")
    per_row = written(place.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("template", "start", "past"))).alias("spans")), "rows")
    drop_written(place)
    side = per_row.select(F.col("row_id").alias("spans_of"), "spans")
    out = rows.join(small_side(side, 48, arrays=("spans",)), F.col("row_id").eqNullSafe(F.col("spans_of")), "left")
    w = out.select("row_id", words_of(F.col("text")).alias("w"), F.coalesce("spans", F.array().cast("array<struct<template:int,start:int,past:int>>")).alias("spans"))
    phrases = F.array(*(F.array(*(F.lit(x) for x in t.text.split())) for t in templates))
    about = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact")) for t in templates))

    def verified(s: Column) -> Column:
        want = F.get(phrases, s["template"])
        have = F.slice("w", s["start"] + 1, s["past"] - s["start"])
        cover = F.when(F.get(about, s["template"])["exact"], F.when(have == want, 1.0).otherwise(0.0)).otherwise(common_words(have, want) / F.size(want))
        return F.struct(s["template"].alias("template"), F.get(about, s["template"])["label"].alias("label"), F.get(about, s["template"])["exact"].alias("exact"), s["start"].alias("start"), s["past"].alias("past"), cover.alias("cover"))

    none = F.array().cast("array<struct<template:int,label:string,exact:boolean,start:int,past:int,cover:double>>")
    hits = F.when(F.size("spans") > 0, F.filter(F.transform("spans", verified), lambda h: h["cover"] >= COVER)).otherwise(none)
    better = lambda a, b: (a["cover"] > b["cover"]) | ((a["cover"] == b["cover"]) & (a["start"] < b["start"]))
    beside = lambda a, b: (a["template"] == b["template"]) & ~a["exact"] & (F.abs(a["start"] - b["start"]) <= SHIFT)
    w = w.select("row_id", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))
    # hits are in order of template and start, so one beside another is near it in the array: as many starts as SHIFT lie on
    # either side, and windows that begin before the text all start at 0
    reach = 2 * SHIFT + max(len(t.text.split()) for t in templates)
    around = lambda i: F.slice("hits", F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach + 1))
    return w.withColumn("hits", F.filter("hits", lambda h, i: h["exact"] | ~F.exists(around(i), lambda o: beside(o, h) & better(o, h))))
