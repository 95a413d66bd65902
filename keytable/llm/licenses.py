"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined to the positions of the
same hashes in a small table of license templates. Matches on one diagonal (text
position minus template position) vote together, neighbouring diagonals of a text and
a template are merged (a word inserted or left out moves the diagonal), and a merged
span is verified against the words themselves: which share of the template's words do
k-grams cover that are equal word by word?

Beside the votes, fixed phrases are found wherever their words stand consecutively.

Only DataFrame functions. The k-grams are not shuffled: the template table is a fixed
value of this module (a few hundred rows), so it is broadcast; only matches move.

Null and empty texts have no words and no labels. Repeated rows each get a row. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, text_column

K = 3
NEAR = 3  # diagonals at most so far apart are merged
COVER = 0.7  # share of a template's words that a span must cover
#: What parts words: all of ASCII but digits and small letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_ROWS = 1_000_000

# Phrases with their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Notices of well-known licenses, as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-license": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3.0": "licensed under the GNU Affero General Public License, version 3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "This work is dedicated to the public domain under CC0 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased (``lower`` leaves the class of every other
    character as it is). Splitting leaves an empty piece before a leading and after a
    trailing separator; these are cut off."""
    pieces = F.split(F.regexp_replace(F.lower(text), f"^{BETWEEN}", ""), BETWEEN, -1)
    return F.transform(F.array(pieces), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))[0]


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(label, words) of each template."""
    rows = list((TEMPLATES if texts is None else texts).items())
    return spark.createDataFrame(rows, "label string, text string").select("label", words_of(F.col("text")).alias("template"))


def _grams(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """(keep, pos, gram): the hashes of all k-grams of the words."""
    shifted = [F.slice(words, F.lit(1 + j), F.greatest(F.size(words) - (K - 1), F.lit(0))).alias(f"w{j}") for j in range(K)]
    each = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "g"))
    return each.select(*keep, "pos", F.xxhash64(*[F.col(f"g.w{j}") for j in range(K)]).alias("gram"))


def votes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, hash, label, pos, tpos): equal k-gram hashes of texts and templates."""
    at = _grams(known, "template", "label").withColumnRenamed("pos", "tpos")
    return _grams(rows, "words", "doc_id", "hash").join(F.broadcast(at), "gram").select("doc_id", "hash", "label", "pos", "tpos")


def spans(found: DataFrame) -> DataFrame:
    """Votes summed by diagonal, neighbouring diagonals merged: (doc_id, hash, label,
    cells), cells being the (pos, tpos) of a merged span."""
    key = ["doc_id", "hash", "label"]
    cells = found.distinct().withColumn("diagonal", F.col("pos") - F.col("tpos"))
    diagonals = cells.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.collect_list(F.struct("pos", "tpos")).alias("cells"))
    order = W.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)).cast("long")
    grouped = diagonals.withColumn("fresh", fresh).withColumn("merged", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*key, "merged").agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("cells")).alias("cells"))


def scan(docs: DataFrame, *, texts: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """Per row: doc_id, n_words, places (start word and label of every phrase), and found
    (label, share covered, first word and end of every verified span)."""
    spark = docs.sparkSession
    known = templates(spark, texts)
    text = text_column(docs)
    base = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"), words_of(text).alias("words"))

    # a phrase stands where its last word does and the others before it
    phrases = {label: phrase.split() for label, phrase in PHRASES.items()}
    lasts = ", ".join(sorted({f"'{p[-1]}'" for p in phrases.values()}))
    ends = F.expr(f"filter(sequence(0, size(words) - 1), i -> words[i] in ({lasts}))")
    stands = lambda p: " and ".join([f"i >= {len(p) - 1}", *(f"words[i - {len(p) - 1 - j}] = '{w}'" for j, w in enumerate(p))])
    cases = ", ".join(f"if({stands(p)}, struct(i - {len(p) - 1} as start, '{label}' as label), null)" for label, p in phrases.items())
    place = F.expr(f"flatten(transform(ends, i -> filter(array({cases}), x -> x is not null)))")
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    gate = " or ".join(f"contains(lower(text), '{p[-1]}')" for p in phrases.values())
    gated = base.withColumn("ends", F.when(F.expr(gate), ends))
    rows = gated.select("doc_id", "hash", F.size("words").cast("long").alias("n_words"), F.coalesce(F.when(F.col("ends").isNotNull(), place), none).alias("places"))

    merged = materialize(spans(votes(base.select("doc_id", "hash", "words"), known)), "spans")
    # the words of texts with votes, to verify the spans word by word
    few = merged.select("doc_id", "hash").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    same = [F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("d.hash") == F.col("m.hash")]
    voted = base.alias("d").join(few.alias("m"), same, "left_semi").select("doc_id", "hash", "words").dropDuplicates(["doc_id", "hash"])
    equal = f"filter(cells, c -> slice(words, c.pos + 1, {K}) = slice(template, c.tpos + 1, {K}))"
    covered = F.expr(f"size(array_distinct(flatten(transform(equal, c -> sequence(c.tpos, c.tpos + {K - 1}))))) / size(template)")
    checked = voted.alias("d").join(merged.alias("m"), same).select("m.*", "d.words").join(F.broadcast(known), "label").withColumn("equal", F.expr(equal)).withColumn("cover", covered)
    checked = checked.where(F.col("cover") >= cover).withColumn("start", F.array_min("equal.pos")).withColumn("end", F.array_max("equal.pos") + K)
    labels = checked.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("label", "cover", "start", "end")).alias("every"))
    # of overlapping spans the one that covers its template best counts
    best = F.expr("filter(every, x -> not exists(every, y -> y.cover > x.cover and y.start < x.end and x.start < y.end))")
    labels = labels.select("doc_id", "hash", F.array_sort(F.transform(best, lambda x: F.struct(x["label"].alias("label"), x["cover"].alias("cover"), x["start"].alias("start"), x["end"].alias("end")))).alias("found"))
    joined = rows.alias("d").join(labels.alias("m"), same, "left")
    return joined.select("d.doc_id", "n_words", "places", F.coalesce("m.found", F.expr("cast(array() as array<struct<label:string,cover:double,start:int,end:int>>)")).alias("found"))


def report(scanned: DataFrame) -> DataFrame:
    """The columns of one row per document."""
    starts = F.col("places.start")
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    own = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("found.label"))))
    best = F.coalesce(F.array_max(F.col("found.cover")), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(own, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
