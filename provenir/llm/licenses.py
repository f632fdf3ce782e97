r"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line, or for each template any run of as many words as it has, wherever lines break, as notices are often wrapped. A
block's tokens are the distinct words that any template has, in ascending corpus frequency (documents that have the word, over the
whole corpus; ties by word). A block matches a template if it holds at least ``containment`` percent of the template's distinct words.
Blocks and templates meet on a rare token of both prefixes; the length filter and the positional filter drop pairs that cannot reach
the needed overlap, and the overlap of full sets decides. All filters are exact. A run that reaches the overlap has a prefix token
of its template, so only the runs around such tokens are looked at, in texts of several lines that hold enough of the template.

Templates are a fixed, small set (a few hundred words): their tables have a size that no corpus changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of public licenses, by label.
TEMPLATES = [
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

CONTAINMENT = 80
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP), lambda w: w != "")


def _phrase_pattern(phrases: dict[str, str]) -> str:
    """A test that every text with a place of a phrase passes, before its words are looked at one by one."""
    letter = lambda c: f"[{c}{c.upper()}]"
    return "|".join(_GAP.join("".join(map(letter, w)) for w in p.split()) for p in phrases)


def _needed(words: int, containment: int) -> int:
    return -(-words * containment // 100)


def license_scan(docs: DataFrame, containment: int = CONTAINMENT, phrases: dict[str, str] | None = None, templates: list | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs`` (doc_id, text).

    score: 1 with a base phrase, else the greatest containment of a template that a block matches, else 0. Null and empty
    texts have no words and no labels; rows equal in doc_id and text are scanned alike; an empty table gives none; other
    columns are ignored.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in templates for w in t.split()})

    # Corpus frequency of template words: at most as many rows as the templates have words.
    seen = base.select(F.explode(F.array_intersect(word_array(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    counted = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes, sets = [], []
    for t, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=rank.get)
        need = _needed(len(tokens), containment)
        sets.append((t, label, tokens, need, len(text.split())))
        prefixes += [(tokens[i], t, i, len(tokens), need) for i in range(len(tokens) - need + 1)]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "token string, template int, i int, size int, need int"))
    whole = F.broadcast(spark.createDataFrame(sets, "template int, label string, tokens array<string>, need int, n_all int"))

    # One pass for the words of each text.
    w = F.col("w")
    hits = lambda p, label: F.filter(
        F.transform(w, lambda x, k: F.when(_here(w, x, k, p), F.struct(k.cast("long").alias("at"), F.lit(label).alias("label")))), lambda x: x.isNotNull()
    )
    none = F.lit(None).cast("array<struct<at:bigint,label:string>>")
    scanned = base.withColumn("w", word_array(F.col("text"))).select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.size("w").cast("long").alias("n_words"),
        F.when(F.col("text").rlike(_phrase_pattern(phrases)), F.concat(*[hits(p.split(), label) for p, label in phrases.items()])).otherwise(none).alias("hits"),
    )

    # Blocks: lines of documents that have a prefix token at all.
    rare = F.array(*[F.lit(x) for x in sorted({p[0] for p in prefixes})])
    lines = base.where(F.arrays_overlap(word_array(F.col("text")), rare)).select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line", "block"))
    ordered = F.array_intersect(F.array(*map(F.lit, order)), word_array(F.col("block")))  # keeps the frequency order
    blocks = lines.select("doc_id", "h", "line", ordered.alias("b")).where(F.size("b") > 0)
    least = min(s[3] for s in sets)
    tokens = blocks.where(F.size("b") >= least).select("doc_id", "h", "line", "b", F.posexplode(F.slice(F.col("b"), F.lit(1), F.size("b") - least + 1)).alias("j", "token"))
    size = F.size("b")
    met = tokens.join(prefix, "token").where(
        (size >= F.col("need")) & (F.col("j") <= size - F.col("need")) & (1 + F.least(F.col("size") - F.col("i"), size - F.col("j")) - 1 >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("b", "tokens"))
    in_lines = met.join(whole.drop("need"), "template").select("doc_id", "h", "label", "size", "need", overlap.alias("overlap"))

    # Blocks across line breaks: runs of a template's number of words that hold one of its prefix tokens.
    longest = max(len(text.split()) for _, text in templates)
    enough = F.lit(False)
    for _, _, words, need, _ in sets:
        enough = enough | (F.size(F.array_intersect("b", F.array(*map(F.lit, words)))) >= need)
    held = base.where(F.col("text").contains("\n")).select("doc_id", F.xxhash64("text").alias("h"), word_array(F.col("text")).alias("w"))
    held = held.withColumn("b", F.array_intersect(F.array(*map(F.lit, order)), "w")).where(enough)
    first = lambda k: F.greatest(k - (longest - 1), F.lit(0))
    near = lambda x, k: F.struct(x.alias("token"), (k - first(k)).alias("at"), F.slice("w", first(k) + 1, F.lit(2 * longest - 1)).alias("around"))
    places = F.filter(F.transform("w", lambda x, k: F.when(x.isin(sorted({p[0] for p in prefixes})), near(x, k))), lambda p: p.isNotNull())
    spots = held.select("doc_id", "h", F.explode(places).alias("p")).select("doc_id", "h", "p.*").join(prefix, "token")
    spots = spots.join(whole.drop("need"), "template").where(F.size(F.array_intersect("around", "tokens")) >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("at") - F.col("n_all") + 1, F.lit(0)), F.col("at"))
    run = lambda k: F.size(F.array_intersect(F.slice("around", k + 1, F.col("n_all")), F.col("tokens")))
    in_runs = spots.select("doc_id", "h", "label", "size", "need", F.array_max(F.transform(starts, run)).alias("overlap"))
    found = (
        in_lines.union(in_runs)
        .where("overlap >= need")
        .groupBy("doc_id", "h")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("share"))
    )

    key = [F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.col("doc_id").isNull().alias("k2")]
    out = scanned.select("*", *key).join(found.select("h", "more", "share", *key), ["k1", "k2", "h"], "left")
    own = F.coalesce(F.transform("hits", lambda x: x["label"]), F.array().cast("array<string>"))
    at = F.transform("hits", lambda x: x["at"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n = F.coalesce(F.size("hits"), F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("hits").isNull(), 0).otherwise(n).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(own) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _here(w: Column, x: Column, k: Column, phrase: list[str]) -> Column:
    """The phrase stands at word k."""
    out = x == phrase[0]
    for d, p in enumerate(phrase[1:], 1):
        out = out & (F.get(w, k + d) == p)
    return out
