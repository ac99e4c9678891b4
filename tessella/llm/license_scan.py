"""License scan by diagonal voting, with DataFrame functions only.

Every run of three words of every text is hashed and joined to the positions of the templates' three-word runs. A match
votes for the diagonal (text position minus template position) that it lies on. A diagonal on which a phrase has all its
votes is a place of that phrase. For longer templates, diagonals that lie close together (words were added or left out) are
merged into a span. A span is verified by the share of the template's runs that it holds, and by the runs that tell the
license from its kin; where spans share words, the one that holds the largest share stands for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower

K = 3
#: Runs of a template that a mask of 64 bits holds.
MOST_RUNS = 64
#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening passages of well-known license notices, lower-cased, and the labels of the method.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu general public license version 3": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "licensed under the gnu lesser general public license version 3": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "licensed under the gnu affero general public license version 3": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}
#: Words that tell a license from its kin, in the order that a template has to have them.
DECISIVE = ["gnu general public", "gnu lesser general", "gnu affero general", "attribution noncommercial", "attribution 4 0", "by nc", "apache license version", "mozilla public license", "with or without fee"]


def decisive_runs(words: list[str]) -> int:
    """The runs, as bits, that a span has to hold: those within a decisive phrase, or around one shorter than a run."""
    out = 0
    for phrase in (d.split(" ") for d in DECISIVE):
        n = len(phrase)
        for at in range(len(words) - n + 1):
            if words[at : at + n] == phrase:
                for p in range(len(words) - K + 1):
                    if at <= p and p + K <= at + n or p <= at and at + n <= p + K:
                        out |= 1 << p
    return out


def template_runs(spark: SparkSession) -> DataFrame:
    """``h, tid, pos``: the hash of each run of K words of phrases (ids below the number of phrases) and templates."""
    rows = [(i, text.split(" ")) for i, text in enumerate([*PHRASES, *TEMPLATES])]
    if any(len(words) - K + 1 > MOST_RUNS for _, words in rows):
        raise ValueError(f"a template has more than {MOST_RUNS} runs of {K} words, which one mask can't hold: cut it in two")
    runs = [(i, p, *words[p : p + K]) for i, words in rows for p in range(len(words) - K + 1)]
    table = spark.createDataFrame(runs, "tid int, pos int, w0 string, w1 string, w2 string")
    return table.select(F.xxhash64("w0", "w1", "w2").alias("h"), F.concat_ws(" ", "w0", "w1", "w2").alias("run"), "tid", "pos")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 4, least: float = 0.7) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: one row per row of ``docs``.

    Words are runs of ASCII letters and digits and of characters outside ASCII, A-Z lower-cased. ``n_base`` counts the
    places of phrases, ``first_word`` and ``last_word`` are their smallest and largest start (null without one).
    ``labels`` adds templates of which a span holds ``least`` or more and all decisive runs, but for those that share words
    with a better span (a larger share, then more runs) of another label; ``score`` is the largest share held, 1 for a phrase.
    Null and empty texts have no words, empty labels and score 0. Rows that repeat id and text are scanned together and
    given as often as they occur; a null id is an id of its own. Other columns aren't read. Matches of one text and template are ordered in one task, which the
    text's length bounds.
    """
    spark = docs.sparkSession
    runs = template_runs(spark)
    sizes = {i: len(t.split(" ")) - K + 1 for i, t in enumerate([*PHRASES, *TEMPLATES])}
    labels = [*PHRASES.values(), *TEMPLATES.values()]
    required = [decisive_runs(t.split(" ")) if t in TEMPLATES else 0 for t in [*PHRASES, *TEMPLATES]]
    needed = F.element_at(F.array(*[F.lit(x).cast("long") for x in required]), F.col("tid") + 1)
    size = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("tid"))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("tid") + 1)

    clean = ascii_lower(F.col(text_col))
    parts = F.split(F.regexp_replace(clean, r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ""), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), parts.alias("__w"))
    rows = rows.withColumn("__w", F.when(F.element_at("__w", -1) == "", F.slice("__w", 1, F.size("__w") - 1)).otherwise(F.col("__w")))
    n = F.size("__w")
    most = F.greatest(n, F.lit(1))
    at = F.posexplode_outer(F.arrays_zip(F.col("__w").alias("w0"), F.slice("__w", 2, most).alias("w1"), F.slice("__w", 3, most).alias("w2"))).alias("p", "r")
    three = rows.select("__id", "__h", n.alias("n"), at)
    hashed = three.select("__id", "__h", "n", "p", F.when(F.col("r.w2").isNotNull(), F.xxhash64("r.w0", "r.w1", "r.w2")).alias("h"), F.concat_ws(" ", "r.w0", "r.w1", "r.w2").alias("words"))
    # Hashes meet in the join; the words themselves decide.
    met = hashed.join(F.broadcast(runs.withColumnRenamed("h", "__rh")), (F.col("h") == F.col("__rh")) & (F.col("words") == F.col("run")), "left")
    # One row a text where nothing matched, one a match elsewhere: summed up before the shuffle.
    votes = met.groupBy("__id", "__h", "tid", (F.col("p") - F.col("pos")).alias("d")).agg(
        F.max("n").alias("n"), F.min(F.when(F.col("tid").isNotNull(), F.col("p"))).alias("lo"), F.max(F.when(F.col("tid").isNotNull(), F.col("p"))).alias("hi"), F.bit_or(F.expr("shiftleft(1L, pos)")).alias("held"),
        F.count(F.lit(1)).alias("votes"), F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("firsts"),
    )
    # How often the row occurs: a run of words lies on a diagonal once, and a text without a match has one first place.
    copies = F.when(F.col("tid").isNull(), F.col("firsts")).otherwise(F.expr("votes div bit_count(held)"))
    order = W.partitionBy("__id", "__h", "tid").orderBy("d")
    new = F.when(F.col("d") - F.lag("d").over(order) <= gap, 0).otherwise(1)
    phrase = F.col("tid") < len(PHRASES)
    spans = votes.withColumn("copies", copies).withColumn("new", F.when(phrase, 1).otherwise(new)).withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("__id", "__h", "tid", "span").agg(F.max("n").alias("n"), F.min("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("held").alias("held"), F.max("copies").alias("copies"))
    share = F.bit_count("held") / size
    base = phrase & (share == 1)
    spans = spans.withColumn("whole", F.coalesce(~phrase & (share >= least) & (F.col("held").bitwiseAND(needed) == needed), F.lit(False)))
    # Spans that share words, one after another, are a group; its best one displaces those of other labels that it shares words with.
    text = W.partitionBy("__id", "__h", "whole").orderBy("lo", "hi", "tid", "d")
    far = F.max("hi").over(text.rowsBetween(W.unboundedPreceding, -1)) + K - 1
    spans = spans.withColumn("__new", F.coalesce((F.col("lo") > far).cast("int"), F.lit(1))).withColumn("group", F.sum("__new").over(text))
    group = W.partitionBy("__id", "__h", "whole", "group")
    best = F.max(F.struct(share.alias("share"), size.alias("size"), label.alias("label"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))).over(group)
    spans = spans.withColumn("best", best)
    apart = (F.col("lo") > F.col("best.hi") + K - 1) | (F.col("best.lo") > F.col("hi") + K - 1)
    found = base | (F.col("whole") & (apart | (F.col("best.label") == label)))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    out = spans.groupBy("__id", "__h").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        joined(F.when(base, label)).alias("base_labels"),
        joined(F.when(found, label)).alias("labels"),
        F.coalesce(F.max(F.when(~phrase | base, share)), F.lit(0.0)).alias("score"),
        F.max("copies").alias("copies"),
    )
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("__id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
