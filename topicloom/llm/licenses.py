"""License scans with DataFrame functions only: phrases in place, and a positional index of rare words.

Fixed phrases give the base labels. Templates give labels of their own: for every template the words with
the highest inverse document frequency over all texts are indexed with their positions; in a text that
holds a template's mandatory phrase, the places of those words vote for where the template would begin,
and the label is given where the words that agree on one beginning carry ``share`` of the weight.

Defined results: null and empty texts have no words and no labels; a row depends on itself and on the
document frequencies only, so repeated ids and further columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import RunFolder

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, words of the template in order, mandatory key phrase.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "public license version 2"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-release", "released under the mit license", "the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    # standard headers and body passages
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl-3.0", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", "gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license as published by the free software foundation either version 3"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to", "waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)
VOCABULARY = sorted({w for _, words, _ in TEMPLATES for w in words.split()})
RARE_WORDS = 5
SHARE = 0.7


def _spread(phrase: str) -> str:
    """Each word between spaces of its own, so that neighbouring places share no character."""
    return "".join(f" {w} " for w in phrase.split())


def _may_hold(low: Column) -> Column:
    """Whether a phrase can stand in a lower-cased text: a cheap test that lets every such text through."""
    out = F.lit(False)
    for phrase in sorted({p for p, _ in PHRASES} | {key for _, _, key in TEMPLATES}):
        longest = max(phrase.split(), key=len)
        test = F.contains(low, F.lit(longest))
        if len(longest) < 5:
            test = test & low.rlike(NOT_WORD.join(phrase.split()))
        out = out | test
    return out


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_words, held, _n``: one pass over the texts.

    ``held`` are the template words in the text; ``_n`` is the normalised text where a phrase may stand in
    it, and empty elsewhere. Lower-casing by locale changes bytes beyond ASCII only, and never to a letter
    of a phrase, so words and places stay as they are.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), low.alias("_low"))
    rows = rows.select("doc_id", F.split("_low", NOT_WORD).alias("_w"), _may_hold(F.col("_low")).alias("_may"))
    # only the first and the last piece can be empty
    empty = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1
    ).otherwise(0)
    joined = F.concat(F.lit(" "), F.array_join(F.filter("_w", lambda w: w != ""), "  "), F.lit(" "))
    return rows.select(
        "doc_id",
        (F.size("_w") - empty).cast("bigint").alias("n_words"),
        F.array_intersect("_w", F.array(*map(F.lit, VOCABULARY))).alias("held"),
        F.when(F.col("_may"), joined).otherwise(F.lit("")).alias("_n"),
    )


def _words_in(text: Column) -> Column:
    """Words of a normalised text, or of its beginning up to a word's leading space."""
    return F.expr("0L") + ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def document_frequencies(read: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and the rows that hold each template word, over all rows. As many numbers as template words."""
    rows = read.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in rows.collect()}
    return found.get("", 0), {w: found.get(w, 0) for w in VOCABULARY}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    read = RunFolder(docs.sparkSession, "licenses").write(_read(docs, doc_id, text), "read")
    total, frequency = document_frequencies(read)
    idf = {w: math.log((total + 1) / (n + 1)) + 1e-3 for w, n in frequency.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    weight = []
    for t, (_, words, _) in enumerate(TEMPLATES):
        order = words.split()
        rare = sorted(set(order), key=lambda w: (-idf[w], w))[:RARE_WORDS]
        for place, w in enumerate(order):
            if w in rare:
                postings.setdefault(w, []).append((t, place))
        weight.append(sum(idf[w] for w in order if w in rare))

    rows = read.select("doc_id", "_n", "n_words", *_places())
    counts = [F.col(f"_c{i}") for i in range(len(PHRASES))]
    keyed = [F.contains(F.col("_n"), F.lit(_spread(key))) for _, _, key in TEMPLATES]
    any_key = keyed[0]
    for k in keyed[1:]:
        any_key = any_key | k
    rare_sql = ", ".join(f"'{w}'" for w in sorted(postings))
    posting_sql = "map(" + ", ".join(
        f"'{w}', array({', '.join(f'struct({t} AS t, {p} AS p, {idf[w]!r}D AS g)' for t, p in ps)})"
        for w, ps in sorted(postings.items())
    ) + ")"
    votes = F.when(
        any_key,
        F.expr(
            f"flatten(transform(filter(transform(split(trim(_n), '  '), (w, i) -> struct(w, i)), x -> x.w IN ({rare_sql})),"
            f" x -> transform({posting_sql}[x.w], q -> struct(q.t AS t, x.i - q.p AS o, q.g AS g))))"
        ),
    )
    rows = rows.withColumn("_v", votes)
    for t in range(len(TEMPLATES)):
        # in order of the beginning they vote for, votes are summed by one fold
        own_votes = f"array_sort(transform(filter(_v, x -> x.t = {t}), x -> struct(x.o, x.g)))"
        total_here = "IF(a.o = x.o, a.s, 0D) + x.g"
        best = (
            f"aggregate({own_votes}, named_struct('o', {-(1 << 31)}, 's', 0D, 'b', 0D), (a, x) -> "
            f"named_struct('o', x.o, 's', {total_here}, 'b', greatest(a.b, {total_here})), a -> a.b)"
        )
        rows = rows.withColumn(
            f"_s{t}", F.when(keyed[t], F.coalesce(F.expr(best) / F.lit(weight[t]), F.lit(0.0))).otherwise(F.lit(0.0))
        )
    base = F.filter(
        F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, PHRASES)]), lambda x: x.isNotNull()
    )
    own = F.filter(
        F.array(*[F.when(F.col(f"_s{t}") >= share, F.lit(TEMPLATES[t][0])) for t in range(len(TEMPLATES))]),
        lambda x: x.isNotNull(),
    )
    first = F.least(*[F.col(f"_f{i}") for i in range(len(PHRASES))])
    last = F.greatest(*[F.col(f"_l{i}") for i in range(len(PHRASES))])
    return rows.select(
        "doc_id",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(*[F.col(f"_s{t}") for t in range(len(TEMPLATES))])).alias("score"),
    )


def _places() -> list[Column]:
    """For each phrase: how often it stands in the text, and its first and last place in words."""
    out, text = [], F.col("_n")
    for i, (phrase, _) in enumerate(PHRASES):
        p = _spread(phrase)
        there = F.contains(text, F.lit(p))
        count = (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
        before = F.substring_index(text, p, 1)
        after = F.substring_index(text, p, -1)
        upto = F.substring(text, F.lit(1), F.length(text) - F.length(after) - len(p))
        out += [
            F.when(there, F.round(count).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias(f"_c{i}"),
            F.when(there, _words_in(before)).alias(f"_f{i}"),
            F.when(there, _words_in(upto)).alias(f"_l{i}"),
        ]
    return out
