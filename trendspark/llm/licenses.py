"""Licence scans by TF-IDF cosine to templates and inheritance from directories.

Each text is scanned whole: every line is a header, and so is every window of as many words
as a template has, whatever lines it is wrapped over; a text that is little but licence
words, or whose file name says so, is a licence file. Lines, windows and whole short texts are
compared with licence templates as sparse TF-IDF
vectors over the words of the templates; how many documents hold each word is counted over
all documents. A line or window can reach the threshold only if it has one of a few heavy words
of a template (the other words of a template together weigh too little), so all lines and
windows without one are passed over. Windows leave out the words of lines that reach the
threshold themselves.

A document without a header of its own takes the licence of the nearest directory above it
that has a licence file: directories are few against documents, so each directory finds its
nearest ancestor first, and documents join their own directory once.

Only DataFrame functions are used. Edge cases: a null or empty text has no licence of its
own but may inherit one; a null path is the root directory; of licence files of one directory
the best score counts, then the smallest licence name; ties between templates go to the
first; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.tables import table
from trendspark.scratch import cut

# fixed values: short notices of common licences
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.8
FILE_WORDS = 0.2  # a licence file: at least this share of the words stand in its licence lines
FILE_NAME = r"(?i)^(?:un)?(?:licen[cs]e|copying|copyright|notice)s?(?:[._-][^/]*)?$"
_WORD = "[^a-z0-9]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


VOCABULARY = tuple(sorted({w for _, text in TEMPLATES for w in template_words(text)}))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != "")


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """How many documents hold each template word, and how many documents there are."""
    known = F.array(*[F.lit(w) for w in VOCABULARY])
    held = docs.select(F.explode_outer(F.array_intersect(known, F.split(F.lower("text"), _WORD))).alias("word"))
    # a row per template word at most
    often = {r.word: r.n for r in held.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).collect()}
    return often, docs.count()


class Weights:
    """Unit TF-IDF vectors of the templates."""

    def __init__(self, often: dict[str, int], documents: int):
        self.idf = {w: math.log((documents + 1) / (often.get(w, 0) + 1)) + 0.01 for w in VOCABULARY}
        self.vectors = []
        for _, text in TEMPLATES:
            words = template_words(text)
            raw = {w: words.count(w) * self.idf[w] for w in words}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            self.vectors.append({w: v / norm for w, v in raw.items()})

    def heavy_of(self, k: int, threshold: float) -> list[str]:
        """Words without which nothing reaches the threshold with template ``k``: all but a light rest."""
        out, rest = [], 0.0
        for word, weight in sorted(self.vectors[k].items(), key=lambda item: (item[1], item[0])):
            rest += weight * weight
            if math.sqrt(rest) >= threshold - 1e-9:
                out.append(word)
        return sorted(out)

    def heavy(self, threshold: float) -> list[str]:
        """Words without which no line reaches the threshold."""
        return sorted({word for k in range(len(self.vectors)) for word in self.heavy_of(k, threshold)})

    def rows(self) -> Column:
        """Map from a word to its idf and its weight in each template."""
        pairs = [x for w in VOCABULARY for x in (F.lit(w), F.array(*[F.lit(v) for v in (
            self.idf[w], *(vector.get(w, 0.0) for vector in self.vectors))]))]
        return F.create_map(*pairs)


def scored(words: Column, rows: Column) -> Column:
    """(score, template) of the nearest template of a list of template words; ties go to the first."""
    zero = F.lit(0.0)

    def dot(k: Column) -> Column:
        # a word that stands twice adds twice, which is its term frequency
        def add(total: Column, row: Column) -> Column:
            return total + F.get(row, F.lit(0)) * F.get(row, k + 1)

        return F.struct(F.aggregate(F.transform(words, lambda w: rows[w]), zero, add).alias("dot"), (-k).alias("t"))

    squares = F.aggregate(F.array_distinct(words), zero, lambda s, w: s + F.pow(
        F.size(F.filter(words, lambda x: x == w)) * F.get(rows[w], F.lit(0)), F.lit(2)))
    best = F.array_max(F.transform(F.array(*[F.lit(k) for k in range(len(TEMPLATES))]), dot))
    # an array of one, so that each part is evaluated once
    found = F.transform(F.array(F.struct(best.alias("best"), F.sqrt(squares).alias("norm"))), lambda x: F.struct(
        F.when(x["norm"] > 0, x["best"]["dot"] / x["norm"]).otherwise(zero).alias("score"), (-x["best"]["t"]).alias("template")))
    return F.get(found, F.lit(0))


def windows(weights: Weights, threshold: float) -> Column:
    """(at, words) of the windows of ``_hits`` that may reach the threshold: index of the first hit, length in words.

    Around each heavy word of a template, the distinct words within the template's length bound
    the cosine of all windows that hold it.
    """
    hits = F.col("_hits")

    def around(k: int, length: int):
        heavy = F.array(*[F.lit(w) for w in weights.heavy_of(k, threshold)])
        squares = F.create_map(*[F.lit(x) for w, v in weights.vectors[k].items() for x in (w, v * v)])

        def of(hit: Column, j: Column) -> Column:
            first = F.greatest(j - (length - 1), F.lit(0))
            near = F.filter(F.slice(hits, first + 1, F.lit(2 * length - 1)), lambda o: F.abs(o["pos"] - hit["pos"]) < length)
            bound = F.aggregate(F.array_distinct(F.transform(near, lambda o: o["w"])), F.lit(0.0),
                                lambda total, w: total + F.coalesce(squares[w], F.lit(0.0)))
            starts = F.filter(F.sequence(first, j), lambda i: F.get(hits, i)["pos"] > hit["pos"] - length)
            return F.when(F.array_contains(heavy, hit["w"]), F.when(bound >= threshold ** 2 - 1e-9, F.transform(
                starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("words")))))

        return of

    found = [F.flatten(F.array_compact(F.transform(hits, around(k, len(template_words(text)))))) for k, (_, text) in enumerate(TEMPLATES)]
    # a short text as a whole
    whole = F.array(F.struct(F.lit(0).alias("at"), F.size("_rest").alias("words")))
    short = (F.size(hits) > 0) & (F.size("_rest") <= 2 * max(len(template_words(text)) for _, text in TEMPLATES))
    return F.array_distinct(F.concat(*found, F.when(short, whole).otherwise(F.array().cast("array<struct<at:int,words:int>>"))))


def headers(files: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, own_score, is_file): the best licence line or window of each document."""
    heavy, known = F.array(*[F.lit(w) for w in weights.heavy(threshold)]), F.array(*[F.lit(w) for w in VOCABULARY])
    rows = weights.rows()
    # any heavy word at all, before lines are cut
    some = F.lower("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(weights.heavy(threshold))})(?![a-z0-9])")
    lines = F.when(some, F.transform(F.split("text", "\n"), words_of))
    files = files.withColumn("_lines", F.coalesce(lines, F.array().cast("array<array<string>>")))
    near = F.transform("_lines", lambda line: F.when(F.arrays_overlap(line, heavy), scored(
        F.filter(line, lambda w: F.array_contains(known, w)), rows)))
    files = files.withColumn("_line_best", near)
    # of a long line, as many words as the template has
    lengths = F.array(*[F.lit(len(template_words(text))) for _, text in TEMPLATES])
    near = F.zip_with("_lines", "_line_best", lambda line, x: F.struct(
        x.alias("best"), F.least(F.size(line), F.get(lengths, x["template"])).alias("words")))
    files = files.withColumn("_near", F.filter(near, lambda x: x["best"]["score"] >= threshold))
    # all words, those of licence lines blank
    rest = F.flatten(F.zip_with("_lines", "_line_best", lambda line, x: F.when(
        x["score"] >= threshold, F.array_repeat(F.lit(""), F.size(line))).otherwise(line)))
    files = files.withColumn("_rest", rest)
    placed = F.filter(F.transform("_rest", lambda w, i: F.struct(w.alias("w"), i.alias("pos"))), lambda x: F.array_contains(known, x["w"]))
    files = files.withColumn("_hits", F.when(F.arrays_overlap("_rest", heavy), placed).otherwise(
        F.array().cast("array<struct<w:string,pos:int>>")))
    files = files.withColumn("_windows", windows(weights, threshold))

    def inside_of(x: Column) -> Column:
        first = F.get("_hits", x["at"])["pos"]
        inside = F.filter(F.slice("_hits", x["at"] + 1, x["words"]), lambda o: o["pos"] < first + x["words"])
        return F.struct(scored(F.transform(inside, lambda o: o["w"]), rows).alias("best"), first.alias("first"),
                        F.least(first + x["words"], F.size("_rest")).alias("last"))

    files = files.withColumn("_window_best", F.filter(F.transform("_windows", inside_of), lambda x: x["best"]["score"] >= threshold))
    ranked = lambda x: F.struct(x["best"]["score"], (-x["best"]["template"]).alias("t"))
    best = F.array_max(F.concat(F.transform("_near", ranked), F.transform("_window_best", ranked)))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    inside = F.aggregate("_near", F.lit(0), lambda total, x: total + x["words"])
    spans = F.array_sort(F.transform("_window_best", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, x: F.struct(
        F.greatest(s["end"], x["last"]).alias("end"),
        (s["n"] + F.greatest(x["last"] - F.greatest(x["first"], s["end"]), F.lit(0))).alias("n")))["n"]
    share = (inside + covered) / F.greatest(F.size("_rest"), F.lit(1))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME)
    return (files.withColumn("_best", best)
            .select("doc_id", "path", F.get(names, -F.col("_best.t")).alias("own_license"), F.col("_best.score").alias("own_score"),
                    (F.col("_best").isNotNull() & ((share >= FILE_WORDS) | named)).alias("is_file")))


def directory(path: Column) -> Column:
    """The path without its last part; the root is the empty text."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """The directory itself and all above it, nearest first, the root last."""
    parts = F.split(path, "/")
    own = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(own, F.array(F.lit(""))))


def license_scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, origin, source_dir): one row per row of ``files`` (doc_id, path, text).

    ``origin`` is header, file, inherited or none.
    """
    files = files.select("doc_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = cut(headers(files, Weights(*document_frequencies(files)), threshold).withColumn("dir", directory(F.col("path"))), "headers")
    # the best licence file of each directory
    held = cut(own.where("is_file").groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("worse"), "own_license")).alias("best"))
        .select(F.col("dir").alias("above"), F.col("best.own_license").alias("dir_license"), (-F.col("best.worse")).alias("dir_score")), "license-dirs")
    steps = own.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("far", "above"))
    nearest = (steps.join(held, "above").groupBy("dir")
               .agg(F.min_by(F.struct("above", "dir_license", "dir_score"), "far").alias("near")))
    nearest = cut(nearest.select("dir", "near.*"), "nearest")
    joined = own.join(nearest, "dir", "left")
    mine = F.col("own_license").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own_license", "dir_license").alias("license"),
        F.coalesce("own_score", "dir_score").alias("score"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("above").isNotNull(), "inherited")
        .otherwise("none").alias("origin"),
        F.when(mine, F.col("dir")).otherwise(F.col("above")).alias("source_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, hundreds of ids, id."""
    missing = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("unknown"))
    return docs.select("doc_id", F.concat_ws("/", missing("source"), missing("lang"), F.floor(F.col("doc_id") / 100).cast("string"),
                                             F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(document_files(table(spark, sf_dir, "documents")))
