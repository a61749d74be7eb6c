"""Licence notices by diagonal voting.

Every rolling pair of words of every text is hashed and joined with the positions at which licence templates hold the
same pair.  A hit votes for the diagonal ``document position - template position``; hits of one notice share a
diagonal, or neighbouring ones where words were added or left out.  Diagonals are merged, and a span counts when
enough of its template is covered.  A merged run that is too wide for one notice holds several: each diagonal that
covers enough by itself is a span of its own, and the hits of the others are searched for stretches that do.  Everything is column functions: explode, a broadcast join with the templates (a
fixed, small table), partial aggregation, and one exchange of the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words: runs of ASCII digits and lower-cased letters and of anything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2  #: words in a rolling gram; the shortest template has two words
SLIDE = 3  #: diagonals this far apart belong to one notice
COVER = 0.7  #: share of a notice's grams that a span must hold

#: Phrases whose every consecutive place counts, with the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening words of well-known notices, with the label of each.  They are matched as a whole.
NOTICES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under the apache license version 2 0": "apache-2.0",
    "spdx license identifier mit": "mit-spdx",
    "all rights reserved": "proprietary",
}


def template_grams(spark: SparkSession) -> DataFrame:
    """The rolling grams of all templates: ``template, label, exact, n_grams, t_pos, gram, h``."""
    listed = [(p, label, True) for p, label in PHRASES.items()] + [(p, label, False) for p, label in NOTICES.items()]
    rows = []
    for i, (phrase, label, exact) in enumerate(listed):
        w = phrase.split(" ")
        rows += [(i, label, exact, len(w) - K + 1, j, " ".join(w[j : j + K])) for j in range(len(w) - K + 1)]
    values = ", ".join(f"({i}, '{label}', {str(exact).lower()}, {n}, {j}, '{gram}')" for i, label, exact, n, j, gram in rows)
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, exact, n_grams, t_pos, gram)")
    return t.withColumn("h", F.xxhash64(*[F.element_at(F.split("gram", " "), j + 1) for j in range(K)]))


def _stretches() -> Column:
    """The stretches of twice the template's grams, each from one of ``hits`` (by position), that hold enough places."""
    grams = [p.split(" ") for p in (*PHRASES, *NOTICES)]
    grams = [[tuple(w[j : j + K]) for j in range(len(w) - K + 1)] for w in grams]
    most = max(2 * len(g) * max(map(g.count, g)) for g in grams)  # no more hits lie in a stretch, so a slice bounds the work
    near = f"filter(slice(hits, i + 1, {most}), x -> x.pos < h.pos + 2 * n_grams)"
    held = f"transform(hits, (h, i) -> struct(h.pos AS first, {near} AS near))"
    held = f"transform({held}, s -> struct(s.first, array_max(s.near.pos) + {K - 1} AS last, size(array_distinct(s.near.t)) / n_grams AS cover))"
    return F.expr(f"filter({held}, s -> s.cover >= {COVER}D)")


def _loose_spans() -> Column:
    """Spans of ``stretches``: the first that begins in each template's length, and any that covers more than the one before."""
    block = "(({}.first - get(stretches, 0).first) div n_grams)"
    kept = f"filter(stretches, (s, i) -> NOT ({block.format('s')} <=> {block.format('get(stretches, i - 1)')}) OR s.cover > get(stretches, i - 1).cover)"
    return F.expr(f"transform({kept}, s -> struct(label, exact, s.first AS first, s.last AS last, s.cover AS cover))")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence spans of every whole text: ``doc_id, n_words, found`` with ``found`` an array of (label, exact, first, last, cover).

    ``first`` and ``last`` are word positions from 0, both inside the span; ``exact`` spans hold every word of their
    phrase in a row.  One row per row of ``docs``; a null or wordless text has ``n_words`` 0 and no spans.  Repeated
    rows are answered each.  Rows whose key is shared by different texts are told apart by a hash of the text.  Empty
    input gives an empty result; other columns are ignored.
    """
    body = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.filter(F.split(body, GAP), lambda w: w != "").alias("w"))
    # Only the two words of a position travel with it: carrying the whole text's words would square its size.
    parts = ", ".join(f"get(w, i + {j})" for j in range(K))
    grams = F.expr(f"transform(sequence(0, greatest(size(w) - {K}, 0)), i -> struct(xxhash64({parts}) AS h, concat_ws(' ', {parts}) AS said))")
    d = d.select("doc_id", "th", F.size("w").alias("n"), F.posexplode(grams).alias("pos", "g")).select("doc_id", "th", "n", "pos", "g.h", "g.said")
    # One row of every text goes on without a hit, to carry its length (and to count repeated rows).
    t = F.broadcast(template_grams(docs.sparkSession))
    hits = d.join(t, "h", "left").where(F.col("template").isNotNull() | (F.col("pos") == 0))
    real = F.col("template").isNotNull() & (F.col("said") == F.col("gram"))
    hits = hits.select("doc_id", "th", "n", "pos", *[F.when(real, F.col(c)).alias(c) for c in ("template", "label", "exact", "n_grams", "t_pos")])
    # A text's first position may hit several templates; each row of docs is counted once, at its smallest template.
    lead = (F.col("pos") == 0).cast("int")
    votes = hits.groupBy("doc_id", "th", "n", "template", "label", "exact", "n_grams", (F.col("pos") - F.col("t_pos")).alias("diag")).agg(F.collect_set("t_pos").alias("places"), F.sum(lead).alias("leads"))
    near = Window.partitionBy("doc_id", "th", "template").orderBy("diag")
    far = F.col("diag") - F.lag("diag").over(near) > F.when(F.col("exact"), 0).otherwise(SLIDE)
    votes = votes.withColumn("run", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(near))
    stretch = Window.partitionBy("doc_id", "th", "template", "run")
    reach = F.max(F.col("diag") + F.array_max("places")).over(stretch) - F.min(F.col("diag") + F.array_min("places")).over(stretch) + 1
    votes = votes.withColumn("wide", ~F.col("exact") & (reach > 2 * F.col("n_grams")))
    # Parts of a wide run: each diagonal that is a notice by itself, and the other diagonals between two of those.
    votes = votes.withColumn("whole", F.col("wide") & (F.size("places") >= COVER * F.col("n_grams")))
    before = F.sum(F.col("whole").cast("int")).over(stretch.orderBy("diag"))
    votes = votes.withColumn("loose", F.col("wide") & ~F.col("whole")).withColumn("part", F.when(F.col("wide"), before))
    hit = F.transform("places", lambda t: F.struct((F.col("diag") + t).alias("pos"), t.alias("t")))
    spans = votes.groupBy("doc_id", "th", "n", "template", "label", "exact", "n_grams", "run", "loose", "part").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diag") + F.array_min("places")).alias("first"),
        F.max(F.col("diag") + F.array_max("places") + K - 1).alias("last"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("loose"), hit)))).alias("hits"),
        F.max("leads").alias("leads"),
    ).withColumn("stretches", _stretches())
    cover = F.size("places") / F.col("n_grams")
    width = F.col("last") - F.col("first") - K + 2  # grams the span stretches over
    fits = F.when(F.col("exact"), F.size("places") == F.col("n_grams")).otherwise((cover >= COVER) & (width <= 2 * F.col("n_grams")))
    one = F.when(F.col("template").isNotNull() & fits, F.array(F.struct("label", "exact", "first", "last", cover.alias("cover"))))
    span = F.when(F.col("loose"), _loose_spans()).otherwise(one)
    return spans.groupBy("doc_id", "th", "n").agg(F.array_sort(F.flatten(F.collect_list(span))).alias("found"), F.max("leads").cast("int").alias("rows")).select("doc_id", F.when(F.col("n") > 0, F.col("n")).otherwise(0).cast("long").alias("n_words"), "found", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_")).drop("_")


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, base places, their first and last word, base labels, all labels, and a score."""
    base = F.filter("found", lambda s: s["exact"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    first = F.transform(base, lambda s: s["first"])
    top = F.coalesce(F.array_max(F.transform("found", lambda s: F.when(s["exact"], F.lit(0.8)).otherwise(s["cover"]))), F.lit(0.0))
    return scan_licenses(docs).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"), names(base).alias("base_labels"), names("found").alias("labels"), top.alias("score"))
