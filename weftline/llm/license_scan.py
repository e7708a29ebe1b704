"""License notices by an exact set-similarity join. DataFrame functions only.

Text blocks and license templates are sets of words. Blocks are lines, and windows of words that run
across line ends, as many as the template's words divided by ``threshold``, so that wrapped notices
are compared as a whole. A block matches a template when it has at least ``threshold`` of the
template's words. The template words' frequencies over the whole
corpus order all sets from rare to frequent; a template's prefix is its first
|T| - need + 1 words, and a block without any of them cannot hold ``need`` of its words. Blocks that
have one are joined on it with the templates, pass the length filter (enough template words in the
block) and the positional filter (enough words left in both after the shared one), and the rest is
verified. Each prefix word is the anchor of the windows around it. Templates are a parameter of fixed size, so they and what follows from them are broadcast.

Defined results: null texts count as empty, with null first and last words; repeated rows are
scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import stage

#: Words of lower-cased texts.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice texts as their authors publish them, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_sets(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    out = []
    for i, (label, text) in enumerate(templates):
        found = re.findall(WORD, text.lower())
        words = sorted(set(found))
        out.append({"template": i, "label": label, "words": words, "need": max(1, math.ceil(threshold * len(words) - 1e-9)), "width": math.ceil(len(found) / threshold - 1e-9)})
    return out


def word_ranks(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word by its frequency over the whole corpus, rarest first."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    each = docs.select(F.explode(words_of(lowered(F.col(text_col)))).alias("word"))
    counts = {r["word"]: r["n"] for r in each.join(known, "word").groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _places(words: Column, phrase: list[str]) -> Column:
    match = lambda i: F.coalesce(
        F.when(F.get(words, i) == phrase[0], F.get(words, i + 1) == phrase[1] if len(phrase) == 2 else (F.get(words, i + 1) == phrase[1]) & (F.get(words, i + 2) == phrase[2])),
        F.lit(False),
    )
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), match)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks, windows.

    ``blocks`` lists the matching lines (line number, template, share of its words), ``windows`` the
    best matching window of each template (first word, template, share); ``score`` is the best share.
    """
    spark = docs.sparkSession
    sets = template_sets(templates or TEMPLATES, threshold)
    ranks = word_ranks(docs, text_col, sorted({w for t in sets for w in t["words"]}))
    prefix: dict[int, list[tuple[int, int, int, int]]] = {}
    rows = []
    for t in sets:
        order = sorted(ranks[w] for w in t["words"])
        size, need = len(order), t["need"]
        rows.append((t["template"], t["label"], order, need, t["width"]))
        for i, r in enumerate(order[: size - need + 1]):
            prefix.setdefault(r, []).append((t["template"], i, size, need))
    index = spark.createDataFrame([(r, *x) for r, xs in prefix.items() for x in xs], "rank int, template int, at_t int, size_t int, need int")
    whole = spark.createDataFrame(rows, "template int, label string, order_t array<int>, need_t int, width int")
    widest = max(t["width"] for t in sets)
    by_rank = {i: w for w, i in ranks.items()}
    rare = F.array(*(F.lit(by_rank[r]) for r in sorted(prefix)))
    ranked = F.create_map(*(x for w, i in ranks.items() for x in (F.lit(w), F.lit(i))))

    text = lowered(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_seq"), text.alias("t")).withColumn("words", words_of(F.col("t")))
    gate = F.col("t").rlike("|".join(GAP.join(p.split()) for p in PHRASES))
    none = F.array().cast("array<int>")
    places = {p: F.when(gate & (F.size("words") > 0), _places(F.col("words"), p.split())).otherwise(none) for p in PHRASES}
    lines = F.filter(
        F.transform(F.split("t", "\n", -1), lambda line, i: F.struct(i.alias("line"), F.array_sort(F.array_compact(F.transform(F.array_distinct(words_of(line)), lambda w: ranked[w]))).alias("order_b"))),
        lambda b: F.size(b["order_b"]) > 0,
    )
    # Ranks of the words around each anchor, from ``from`` on; -1 for other words.
    spot = lambda i: F.greatest(i - (widest - 1), F.lit(0))
    around = lambda i: F.transform(F.slice("words", spot(i) + 1, i - spot(i) + widest), lambda w: F.coalesce(ranked[w], F.lit(-1)))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin([by_rank[r] for r in sorted(prefix)]))
    anchors = F.transform(at, lambda i: F.struct(ranked[F.get("words", i)].alias("rank"), i.alias("at"), spot(i).alias("from"), around(i).alias("near")))
    base = base.select(
        "doc_id",
        "row_seq",
        F.size("words").cast("long").alias("n_words"),
        *(e.alias(f"p{i}") for i, e in enumerate(places.values())),
        F.when(F.arrays_overlap("words", rare), lines).alias("lines"),
        F.when(F.arrays_overlap("words", rare), anchors).alias("anchors"),
    )
    base = stage(base, "licenses")
    blocks = base.where(F.size("lines") > 0).select("row_seq", F.inline("lines"))
    shared = blocks.select("row_seq", "line", "order_b", F.posexplode("order_b").alias("at_b", "rank")).join(F.broadcast(index), "rank")
    left = F.least(F.col("size_t") - F.col("at_t"), F.size("order_b") - F.col("at_b"))
    pairs = shared.where((F.size("order_b") >= F.col("need")) & (left >= F.col("need"))).dropDuplicates(["row_seq", "line", "template"])
    lines_found = pairs.join(F.broadcast(whole), "template").withColumn("both", F.size(F.array_intersect("order_b", "order_t"))).where("both >= need_t")
    near = base.where(F.size("anchors") > 0).select("row_seq", F.inline("anchors")).join(F.broadcast(index.select("rank", "template").distinct()), "rank").join(F.broadcast(whole), "template")
    near = near.where(F.size(F.array_intersect("near", "order_t")) >= F.col("need_t"))
    window = lambda j: F.struct(F.size(F.array_intersect(F.slice("near", j + 1, F.col("width")), "order_t")).alias("both"), (-(F.col("from") + j)).alias("start"))
    first, last = F.greatest(F.col("at") - F.col("from") - F.col("width") + 1, F.lit(0)), F.col("at") - F.col("from")
    windows = near.select("row_seq", "template", "label", "order_t", "need_t", F.array_max(F.transform(F.sequence(first, last), window)).alias("best"))
    windows = windows.where("best.both >= need_t").groupBy("row_seq", "template", "label", F.size("order_t").alias("size")).agg(F.max("best").alias("best"))
    share = F.col("both") / F.size("order_t")
    each = lines_found.select("row_seq", "label", share.alias("share"), F.struct("line", "template", share.alias("share")).alias("block"), F.lit(None).cast("struct<start:int,template:int,share:double>").alias("window"))
    share = F.col("best.both") / F.col("size")
    each = each.unionByName(windows.select("row_seq", "label", share.alias("share"), F.lit(None).cast("struct<line:int,template:int,share:double>").alias("block"), F.struct((-F.col("best.start")).alias("start"), "template", share.alias("share")).alias("window")))
    verified = each.groupBy("row_seq").agg(
        F.collect_set("label").alias("found"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list("block")).alias("blocks"),
        F.array_sort(F.collect_list("window")).alias("windows"),
    )
    all_places = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    return base.join(verified, "row_seq", "left").select(
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce("found", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "blocks",
        "windows",
    )
