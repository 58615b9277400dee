"""License scans by diagonal voting over word pairs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.llm.common import DIGEST, identified, null_safe

# Phrases whose every place counts, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Wordings of notices that are found even when a few words differ.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: All characters that are not part of a word.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"  # the one letter that lower() turns into an ASCII letter


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered; other letters never decide a comparison with ASCII words."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(plain), BREAKS), "")


def template_pairs(spark: SparkSession, notices=NOTICES, base=BASE) -> DataFrame:
    """A row for each word pair of each template; as many as the fixed wordings have."""
    listed = [(label, words.split(), True) for words, label in base.items()] + [(label, words.split(), False) for label, words in notices]
    rows = [
        (number, label, exact, len(words) - 1, at, words[at], words[at + 1])
        for number, (label, words, exact) in enumerate(listed)
        for at in range(len(words) - 1)
    ]
    shape = "template int, label string, exact boolean, pairs int, at int, t1 string, t2 string"
    return spark.createDataFrame(rows, shape).withColumn("pair_hash", F.xxhash64("t1", "t2"))


def license_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.75,
    drift: int = 2,
    notices=NOTICES,
    base=BASE,
) -> DataFrame:
    """Places of templates: doc_id, digest, label, exact, first_word, last_word, score.

    Hashes of all word pairs of a text meet the template pairs with that hash; words are compared
    too. Hits are counted by template and diagonal (word position less template position). Each
    diagonal and those up to ``drift`` above it are one candidate place, so at most ``drift`` words
    are added or left out in all. A place with enough votes is verified by its longest chain of hits
    whose text and template positions both rise: the chain's share of the template's pairs must be
    all for ``base`` phrases, each diagonal on its own, and ``least`` for the others. Its span is so
    at most ``drift`` words longer than the template. Of places that share diagonals the best stays
    (ties: the first). ``last_word`` is where the last pair ends.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col).select("doc_id", DIGEST, words_of(F.col("text")).alias("w"))
    pairs = rows.select("doc_id", DIGEST, F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))))
    pairs = pairs.select("doc_id", DIGEST, "pos", F.col("col")["a"].alias("w1"), F.col("col")["b"].alias("w2")).withColumn(
        "pair_hash", F.xxhash64("w1", "w2")
    )
    # the wordings above are a fixed, short list
    hits = pairs.join(F.broadcast(template_pairs(spark, notices, base)), "pair_hash").where("w1 = t1 AND w2 = t2")
    kind = ["doc_id", DIGEST, "template", "label", "exact", "pairs"]
    votes = hits.select(*kind, (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    # a diagonal holds a template position once, so its set has at most as many as the template
    diagonals = votes.groupBy(*kind, "diagonal").agg(F.collect_set("at").alias("ats"))
    by_place = Window.partitionBy("doc_id", DIGEST, "template").orderBy("diagonal")
    on = F.transform("ats", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), (-at).alias("back")))
    near = by_place.rangeBetween(0, drift)
    enough = F.when(F.col("exact"), F.size("ats") == F.col("pairs")).otherwise(F.sum(F.size("ats")).over(near) >= least * F.col("pairs"))
    places = diagonals.withColumn("on", on).withColumn("enough", enough).withColumn("around", F.collect_list("on").over(near))
    hits_of = F.when(F.col("exact"), F.col("on")).otherwise(F.flatten("around"))
    chained = places.where("enough").withColumn("chain", longest_chain(F.array_sort(hits_of), F.col("pairs")))
    score = F.col("chain.hits") / F.col("pairs")
    verified = chained.withColumn("score", score).where(F.when(F.col("exact"), score == 1).otherwise(score >= least))
    rank = F.struct("score", -F.col("diagonal"))
    best = F.max(rank).over(by_place.rangeBetween(-drift, drift))
    kept = verified.withColumn("best", best).where(F.col("exact") | (F.col("best") == rank))
    return kept.select(
        "doc_id",
        DIGEST,
        "label",
        "exact",
        F.col("chain.first").cast("long").alias("first_word"),
        (F.col("chain.last") + 1).cast("long").alias("last_word"),
        "score",
    )


def longest_chain(hits: Column, pairs: Column) -> Column:
    """(hits, first, last) of the longest chain of ``hits`` with rising ``pos`` and template position.

    ``hits`` are (pos, template position negated) in order; of one ``pos`` the later template
    position so comes first and can't follow an earlier one. Slot i keeps the best chain that ends
    at template position i; of equally long ones the latest start, which is the shortest span.
    """
    none = F.struct(F.lit(0).alias("hits"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def extend(slots: Column, hit: Column) -> Column:
        at = -hit["back"]
        # position 0 has no earlier slot, where the maximum is null
        before = F.coalesce(F.array_max(F.slice(slots, 1, at)), none)
        first = F.when(before["hits"] == 0, hit["pos"]).otherwise(before["first"])
        longer = F.struct((before["hits"] + 1).alias("hits"), first.alias("first"), hit["pos"].alias("last"))
        return F.transform(slots, lambda slot, i: F.when(i == at, F.greatest(slot, longer)).otherwise(slot))

    return F.array_max(F.aggregate(hits, F.array_repeat(none, pairs), extend))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: word count, places of base phrases, labels and the best score.

    Null and empty texts have no words, no labels (empty strings) and score 0. Equal rows get equal
    results; null ids are kept. Base labels are part of ``labels``.
    """
    spans = license_spans(docs, id_col, text_col, **options)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    by_doc = spans.groupBy("doc_id", DIGEST).agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
        joined(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    rows = identified(docs, id_col, text_col).select("doc_id", DIGEST, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return null_safe(rows, by_doc, ["doc_id", DIGEST]).select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
