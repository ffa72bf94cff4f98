"""License passages by diagonal voting.

Every rolling pair of words of every text is hashed in its row; those whose
hash is a template's are joined with the places that they have in the templates
(a fixed list, so that side is small by construction).
A match votes for its diagonal, the offset between text and template; votes
are summed by diagonal, neighbouring diagonals (words inserted or left out)
are merged, and a span counts if enough of the template's pairs, compared
word by word, stand in it. A phrase of the base list must stand there whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, staged

#: What lies between words: ASCII but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # words in lower case, one space between them
    whole: bool = False  # whether only consecutive occurrences of all words count


BASE = [Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True)]
#: The method's own: wording that public licenses ask to be put into a work.
NOTICES = [
    Template("apache", "licensed under the apache license version 2 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc0", "this work has been dedicated to the public domain under creative commons zero"),
    # whole notices of the licenses
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def template_pairs(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = []
    for k, t in enumerate(templates):
        w = t.text.split(" ")
        rows += [(k, t.label, t.whole, len(w), i, a, b) for i, (a, b) in enumerate(zip(w, w[1:]))]
    df = spark.createDataFrame(rows, "template int, label string, whole boolean, t_words int, t_pos int, a string, b string")
    return df.withColumn("h", F.xxhash64("a", "b"))


HIT = "array<struct<pos: int, h: bigint, a: string, b: string>>"
#: What tells a row's text from another's: its id, if it has one, and two hashes of its text; rows alike in these have the same spans.
ROW = ("doc_id", "no_id", "h1", "h2")


def pair_hits(docs: DataFrame, pairs: list, id_col: str, text_col: str) -> DataFrame:
    """By row: ROW, n_words and hits, the rolling pairs of words whose hash is one of the templates'. What is no hit never leaves its row."""
    wanted = [r.h for r in pairs]
    df = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(F.col(text_col)).alias("h1"), F.xxhash64(F.lit("licenses"), F.col(text_col)).alias("h2"), words_of(F.col(text_col)).alias("w"))

    def hits(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.get(w, i), F.get(w, i + 1)).alias("h")))
        return F.transform(F.filter(hashes, lambda k: k.h.isin(wanted)), lambda k: F.struct(k.pos.alias("pos"), k.h.alias("h"), F.get(w, k.pos).alias("a"), F.get(w, k.pos + 1).alias("b")))

    return df.select(*ROW, F.size("w").cast("long").alias("n_words"), F.when(F.size("w") > 1, let(F.col("w"), hits)).otherwise(F.array().cast(HIT)).alias("hits"))


def find_spans(docs: DataFrame, templates: list[Template] | None = None, min_cover: float = 0.7, max_shift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per verified span of each different row: doc_id, template, label, whole, first_word, last_word (from 0), cover.

    cover is the share of the template's word pairs found in the span; whole
    templates need all of them on one diagonal. Null and empty texts and ones
    of a single word have no spans. Rows that share a doc_id but not their text
    have spans of their own, as have rows without an id (null).
    """
    pairs = template_pairs(docs.sparkSession, templates if templates is not None else BASE + NOTICES)
    spans = spans_of(pair_hits(docs, pairs.collect(), id_col, text_col), pairs, min_cover, max_shift)  # a fixed list of pairs
    return spans.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "template", "label", "whole", "first_word", "last_word", "cover")


def spans_of(hits: DataFrame, pairs: DataFrame, min_cover: float, max_shift: int) -> DataFrame:
    df = hits.select(*ROW, F.explode("hits").alias("k")).select(*ROW, "k.*")
    votes = df.join(F.broadcast(pairs.withColumnsRenamed({"a": "t_a", "b": "t_b"})), "h").where((F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")))  # the fixed list
    key = [*ROW, "template", "label", "whole", "t_words"]
    diagonals = votes.groupBy(*key, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("found"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))  # at most the template's length
    enough = F.when(F.col("whole"), F.size("found") == F.col("t_words") - 1).otherwise(F.lit(True))
    diagonals = diagonals.where(enough)
    # neighbouring diagonals, where words are put in or left out, make one span; whole templates stand for themselves.
    # Two occurrences of a template lie on diagonals as far apart as they do.
    order = Window.partitionBy(*ROW, "template").orderBy("diagonal")
    apart = F.col("whole") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > max_shift)
    spans = diagonals.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(order))
    n = F.size(F.array_distinct(F.flatten(F.collect_list("found"))))
    spans = spans.groupBy(*key, "span").agg(n.alias("n"), F.min("lo").alias("first_word"), (F.max("hi") + 1).alias("last_word"))
    cover = F.least(F.lit(1.0), F.col("n") / (F.col("t_words") - 1))
    return spans.withColumn("cover", cover).where(F.col("whole") | (F.col("cover") >= min_cover))


def scan_documents(docs: DataFrame, min_cover: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover; 0 without a span).

    Every row has its own result, whether or not others share its doc_id, and
    with a null id too; repeated rows stay as they are; null texts count as
    empty; whole texts are scanned, however long. Of spans that tie in cover
    none is chosen: labels names them all. Other columns are left out; an empty
    table gives no rows.
    """
    pairs = template_pairs(docs.sparkSession, BASE + NOTICES)
    rows = staged(pair_hits(docs, pairs.collect(), id_col, text_col), "license-hits")  # a fixed list of pairs; texts are read once
    spans = spans_of(rows.where(F.size("hits") > 0), pairs, min_cover, 3)
    start = F.when(F.col("whole"), F.col("first_word"))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a set of at most as many as there are labels
    found = spans.groupBy(*ROW).agg(F.count_if("whole").alias("n_base"), F.min(start).cast("long").alias("first_word"), F.max(start).cast("long").alias("last_word"), named(F.when(F.col("whole"), F.col("label"))).alias("base_labels"), named(F.col("label")).alias("labels"), F.max("cover").alias("score"))
    with_hits = rows.where(F.size("hits") > 0).select(*ROW, "n_words").join(found, list(ROW), "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"))]
    every = with_hits.unionByName(rows.where(F.size("hits") == 0).select(*ROW, "n_words", *none))
    return every.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"))
