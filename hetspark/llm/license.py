"""License scans by diagonal voting, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Word of a lower-cased text: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count wherever they stand whole.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices that are found with words missing, added or changed as well.
NOTICES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "apache-2.0"),
    ("Released under the MIT license", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "bsd"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2.0"),
    ("Distributed under the Boost Software License, Version 1.0", "bsl-1.0"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "zlib"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "gfdl"),
)

#: Diagonals this near to each other are one place; a notice needs this share of its words there.
NEAR, COVERED = 3, 0.7


def template_pairs(phrases: tuple = PHRASES, notices: tuple = NOTICES) -> list[tuple]:
    """(first word, second word, place, template, label, exact, pairs, votes needed) of all word pairs of all templates."""
    out = []
    for number, (text, label) in enumerate([*phrases, *notices]):
        words = re.findall(WORD, text.lower())
        exact, pairs = number < len(phrases), len(words) - 1
        if pairs < 1:
            raise ValueError(f"a phrase or notice has two words at least: {text!r}")
        need = pairs if exact else max(2, -(-pairs // 5))
        out += [(words[i], words[i + 1], i, number, label, exact, pairs, need) for i in range(pairs)]
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. Only two other characters turn into ASCII letters by lower(); texts with them go a slower way.
    (Other letters may change too: no template has any.)"""
    return F.when(text.rlike("[İK]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def votes(docs: DataFrame, pairs: list[tuple], id_col: str, text_col: str) -> DataFrame:
    """Word pairs of texts at template positions: row (number of the input row), id, n_words, pos, and the template's
    columns; besides, one row without a template for each input row, so that none is lost.

    All rolling pairs are hashed where the text is read. Those whose hash is a template's are joined to the template
    positions by hash and by both words, so what votes is equal, not only of equal hash.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(pairs, "a string, b string, place int, template int, label string, exact boolean, pairs int, need int").select("*", F.xxhash64("a", "b").alias("hash"))
    hashes = [r.hash for r in table.select("hash").distinct().collect()]  # of the templates: a fixed, small number

    def hits(w: Column) -> Column:
        at = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        found = F.filter(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)).isin(hashes))
        return F.transform(found, lambda i: F.struct(i.alias("pos"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b")))

    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    # A list of one list names the words, so that they are extracted once for each text.
    once = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), hits(w).alias("hits"))), F.lit(0))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), once.alias("read"))
    none = F.array(F.lit(None).cast("struct<pos:int,a:string,b:string>"))
    rows = read.select("row", "id", "read.n_words", F.explode(F.concat(none, "read.hits")).alias("hit")).select("row", "id", "n_words", "hit.*")
    rows = rows.withColumn("hash", F.xxhash64("a", "b"))
    return rows.join(F.broadcast(table), ["hash", "a", "b"], "left").select("row", "id", "n_words", "pos", "place", "template", "label", "exact", "pairs", "need")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Places of templates: row, id, n_words, template, label, exact, start, end (words), score; one row without a
    template for each input row.

    Votes are counted by diagonal (position in the text less position in the template). A missing or added word shifts
    a diagonal, so those of a notice that are NEAR each other are merged, single votes too; they count if a fifth of
    the notice's pairs, and two, vote within NEAR. A place stands if the pairs found there hold COVERED of the
    template's words (the score), and it is not over twice as long. A phrase needs all of its pairs on one diagonal. All
    of this is inside one text: rows are dealt once, by row.
    """
    keys = ["row", "id", "n_words", "template", "label", "exact", "pairs"]
    one = votes(docs, template_pairs(phrases, notices), id_col, text_col).repartition("row")
    order = W.Window.partitionBy("row", "template").orderBy("diagonal")
    places = F.collect_set("place")
    diagonals = (
        one.groupBy(*keys, "need", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.count("place").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.concat(places, F.transform(places, lambda x: x + 1)).alias("words"))
        .withColumn("near", F.when(F.col("exact"), F.col("n")).otherwise(F.sum("n").over(order.rangeBetween(-NEAR, NEAR))))
        .where("template is null or near >= need")
    )
    apart = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), F.lit(True))
    return (
        diagonals.withColumn("apart", apart.cast("int"))
        .withColumn("place", F.sum("apart").over(order))
        .groupBy(*keys, "place")
        .agg(F.min("low").alias("start"), (F.max("high") + 2).alias("end"), (F.size(F.array_distinct(F.flatten(F.collect_list("words")))) / (F.col("pairs") + 1)).alias("score"))
        .where(F.col("template").isNull() | (F.col("score") >= COVERED) & (F.col("end") - F.col("start") <= 2 * (F.col("pairs") + 1)))
        .select("row", "id", "n_words", "template", "label", "exact", "start", "end", "score")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels are those of phrases; labels those of phrases and notices: distinct, sorted, joined by commas (empty
    if none). score is the largest covered share of the places found, 0 without one.

    Defined cases: null and empty texts have no words. Very long texts are read whole. Null ids, repeated rows and repeated ids each give a row. Other
    columns are ignored. An empty table gives an empty result.
    """
    base = F.col("exact") & F.col("template").isNotNull()
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        spans(docs, id_col, text_col, phrases, notices)
        .groupBy("row", "id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        )
        .drop("row").withColumnRenamed("id", id_col)
    )


def scan_sql() -> str:
    """scan() of documents in SQL."""
    quoted = ", ".join(f"('{a}', '{b}', {i}, {t}, '{label}', {exact}, {pairs}, {need})" for a, b, i, t, label, exact, pairs, need in template_pairs())
    return rf"""
        WITH pairs AS (SELECT * FROM (VALUES {quoted}) v(a, b, place, template, label, exact, pairs, need)
        ), texts AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents
        ), grams AS (SELECT row, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT row, w, unnest(range(1, len(w))) AS i FROM texts)
        ), diagonals AS (
            SELECT row, template, label, exact, pairs, need, pos - place AS diagonal, count(*) AS n, min(pos) AS low, max(pos) AS high, list(DISTINCT place) AS places
            FROM grams JOIN pairs USING (a, b) GROUP BY row, template, label, exact, pairs, need, diagonal
        ), strong AS (
            SELECT * FROM diagonals QUALIFY CASE WHEN exact THEN n ELSE sum(n) OVER (PARTITION BY row, template ORDER BY diagonal RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) END >= need
        ), marked AS (
            SELECT *, CASE WHEN coalesce(exact OR diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > {NEAR}, true) THEN 1 ELSE 0 END AS apart FROM strong
        ), numbered AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS spot FROM marked
        ), places AS (
            SELECT row, label, exact, min(low) AS "start", len(list_distinct(flatten(list(places || list_transform(places, lambda x: x + 1))))) / (pairs + 1) AS score
            FROM numbered GROUP BY row, template, label, exact, pairs, spot
            HAVING len(list_distinct(flatten(list(places || list_transform(places, lambda x: x + 1))))) / (pairs + 1) >= {COVERED} AND max(high) + 2 - min(low) <= 2 * (pairs + 1)
        ), found AS (
            SELECT row, count(*) FILTER (exact) AS n_base, min("start") FILTER (exact) AS first_word, max("start") FILTER (exact) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
            FROM places GROUP BY row
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM texts LEFT JOIN found USING (row)"""
