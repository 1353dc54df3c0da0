"""License scans by diagonal voting, by DataFrame functions alone.

Every rolling k-gram of words of every document is hashed and joined to the positions of the templates' k-grams. Each
match votes for a diagonal (document position minus template position), that is, for one place of the template in the
document; votes are summed by document, template and diagonal. Each diagonal is verified by itself and together with
its neighbours of at most `apart` words away, by the share of the template's words, or of the span's if it is longer,
that matched k-grams cover; its score is the better of the two. So a span is never longer than its template and twice
`apart` words, however many further diagonals stand in a row beside it. Of diagonals that are neighbours the best one
is reported. Beside it, base phrases are counted in the word sequence itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Labels and words of notices that licences ask for or that are in common use.
TEMPLATES = {
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
}

K, APART, CLOSE = 3, 3, 0.7
#: Everything in ASCII but 0-9 and a-z; the text is lower-cased before.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The most template k-grams that go into a broadcast table.
MOST_GRAMS = 200_000


#: Parts of a hot k-gram where templates are too many to broadcast.
SALT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z, and nothing else, in lower case. For ASCII, lower() does that, in less time."""
    return F.array_remove(F.split(F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), NOT_WORD), "")


def template_grams(spark: SparkSession, templates: dict[str, list[str]], k: int = K) -> DataFrame:
    """(gram, template, label, length, position): one row for each k-gram position of each template of k words or more."""
    rows = [(n, label, text) for n, (label, text) in enumerate((label, t) for label, texts in templates.items() for t in texts)]
    df = spark.createDataFrame(rows, "template int, label string, body string").withColumn("w", F.split("body", " "))
    return _grams(df.withColumn("length", F.size("w")), k, "template", "label", "length")


def _grams(rows: DataFrame, k: int, *keep: str) -> DataFrame:
    """The columns `keep`, with position and hash of each k-gram of the array column w."""
    shifted = ", ".join(f"slice(w, {i + 1}, greatest(size(w) - {k - 1}, 0))" for i in range(k))
    rolled = rows.select(*keep, F.expr(f"posexplode(arrays_zip({shifted})) as (position, g)"))
    return rolled.select(*keep, "position", F.xxhash64(*(F.col(f"g.`{i}`") for i in range(k))).alias("gram"))


def spans(docs: DataFrame, templates: dict[str, list[str]] | None = None, k: int = K, apart: int = APART, close: float = CLOSE, most_grams: int = MOST_GRAMS) -> DataFrame:
    """Verified spans of docs (row_key, text): row_key, template, label, first_word, end_word, votes, score.

    score is the number of template words that matched k-grams of the span cover, by the longer length of template
    and span; spans below `close` are dropped. Rows that repeat a key count once. Templates of more than `most_grams`
    words in all are joined by a shuffle on salted k-grams, fewer are broadcast.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    grams = template_grams(spark, templates, k)
    lengths = grams.select("template", "label", "length").distinct()
    rolled = _grams(docs.select("row_key", words(F.col("text")).alias("w")), k, "row_key")
    at = grams.select("gram", "template", F.col("position").alias("at"))
    if sum(len(t.split()) for texts in templates.values() for t in texts) <= most_grams:
        votes, lengths = rolled.join(F.broadcast(at), "gram"), F.broadcast(lengths)
    else:
        salted = at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        votes = rolled.withColumn("salt", F.pmod("position", F.lit(SALT))).join(salted, ["gram", "salt"])
    # One row for each place of a template: at most as many places of k-grams as the template has.
    lines = votes.groupBy("row_key", "template", (F.col("position") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"))
    near = Window.partitionBy("row_key", "template").orderBy("diagonal").rangeBetween(-apart, apart)
    low, high = F.array_min("places") + F.col("diagonal"), F.array_max("places") + F.col("diagonal") + k
    lines = lines.withColumns({"low": low, "high": high}).join(lengths, "template")
    around = lines.withColumns({"all_places": F.array_distinct(F.flatten(F.collect_list("places").over(near))), "all_low": F.min("low").over(near), "all_high": F.max("high").over(near)})

    def score(places: str, low: str, high: str) -> Column:
        covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + k - 1)))))
        return covered / F.greatest(F.col("length"), F.col(high) - F.col(low))

    scored = around.withColumns({"alone": score("places", "low", "high"), "merged": score("all_places", "all_low", "all_high")}).withColumn("score", F.greatest("alone", "merged"))
    scored = scored.filter(F.col("score") >= close)
    # Among neighbours the best score stands, then a diagonal by itself, then the first.
    rank = F.struct("score", (F.col("alone") >= F.col("merged")).alias("own"), (-F.col("diagonal")).alias("place"))
    best = scored.withColumn("rank", rank).withColumn("top", F.max("rank").over(near)).filter(F.col("rank") == F.col("top"))
    own = F.col("rank.own")
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return best.select("row_key", "template", "label", pick("low", "all_low").cast("long").alias("first_word"), pick("high", "all_high").cast("long").alias("end_word"), F.size(pick("places", "all_places")).cast("long").alias("votes"), "score")


def _base(row: DataFrame) -> DataFrame:
    """n_words, and count, first place, last place and label of each phrase, from the array column w."""
    # Blanks around each word; a phrase's place is the number of blanks before its own leading blank.
    # Only texts with the first and the last word of some phrase can hold one; the rest are spared the line.
    maybe = reduce(lambda a, b: a | b, (F.array_contains("w", p.split()[0]) & F.array_contains("w", p.split()[-1]) for p in PHRASES))
    line = row.withColumn("line", F.when(maybe, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).otherwise(F.lit(" ")))
    hits, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        key, size = f" {phrase} ", len(phrase.split())
        blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        there = F.contains(F.col("line"), F.lit(key))
        n = F.size(F.regexp_extract_all("line", F.lit(f" {phrase}(?= )"), F.lit(0)))
        before = F.substring("line", F.lit(1), F.locate(key, F.col("line")) - 1)
        back = F.reverse("line")
        after = F.substring(back, F.lit(1), F.locate(key[::-1], back) - 1)
        hits.append(F.when(there, n).otherwise(0))
        firsts.append(F.when(there, blanks(before)))
        lasts.append(F.when(there, F.size("w") - size - blanks(after)))
        labels.append(F.when(there, F.lit(label)))
    return line.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_base": reduce(lambda a, b: a + b, hits).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    })


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best verified span's score, at least 0.5 where a base phrase stands, else 0. A null or empty text has
    no words, no labels and score 0; a null doc_id keeps its row; rows that repeat a doc_id are scanned each by its
    own text: rows of one key (doc_id and a 64-bit hash of the text) have the same spans. No rows give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = own.withColumn("row_key", F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("text")))
    found = spans(keyed.select("row_key", "text"), templates).groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    line = _base(keyed.select("doc_id", "row_key", words(F.col("text")).alias("w"))).drop("w", "line")
    both = line.join(found, "row_key", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
