"""License scan by a positional index of rare words.

Templates are key passages of licences, cut into words. Their distinctive words
are indexed: word -> (template, place in it). A file looks up its words that are in
the index, keeps the rarest ones (by document frequency over all files), and each
match votes for a template at the relative position file place - template place.
Matches that agree on one position are an aligned occurrence. A template holds if
the rare words aligned at some position carry enough of its weight and a mandatory
phrase of it stands word for word in the file. Base phrases are templates whose
every word is indexed and must agree.

Everything about a file happens in its own row: one scan for document frequencies
(of index words only, a table bounded by the templates), one for the lookup, no
shuffle of files. So neither copies nor null or repeated ids matter.

Cases: null and empty texts have no words, no labels and score 0; repeated rows give
repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.llm.common import alnum_words, wrap

# Base phrases and their labels
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Key passages of public licences: label, passage, mandatory phrases
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2 0", "may not use this file except in compliance")),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc", "this work is licensed under a creative commons attribution international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ("all rights reserved",)),
)

# Words too common to be indexed, whatever the files hold
COMMON = frozenset("a an and any are as at by can for from in into is it may not of on or that the this to under with without you your use used".split())
RAREST = 6  # index words looked up per file and template, rarest first
NEEDED = 0.6  # share of a template's looked-up weight that must be aligned


def _words(phrase: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", phrase.lower())


def _indexed(k: int) -> list[tuple[str, int]]:
    """Words of template k that are indexed, with their first place."""
    words = _words(TEMPLATES[k][1])
    return [(w, words.index(w)) for w in dict.fromkeys(words) if w not in COMMON and len(w) > 1]


def vocabulary() -> list[str]:
    return sorted({w for k in range(len(TEMPLATES)) for w, _ in _indexed(k)} | {w for p in BASE_PHRASES for w in _words(p)})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and how many hold each index word: at most one row per index word comes back."""
    words = wrap(docs.select("text")).select(F.array_intersect(alnum_words(F.col("text")), _literal(vocabulary())).alias("held"))
    held = words.select(F.explode_outer(F.array_append("held", F.lit(""))).alias("word"))  # the empty word counts the files
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.pop("", 0), found


def rare_index(n_files: int, frequency: dict[str, int]) -> list[dict]:
    """Per template its rarest words: place, and idf weight as a share of the template."""
    out = []
    for k, (label, _, keys) in enumerate(TEMPLATES):
        idf = {w: math.log((1 + n_files) / (1 + frequency.get(w, 0))) + 1e-6 for w, _ in _indexed(k)}
        rare = sorted(_indexed(k), key=lambda x: (-idf[x[0]], x[1]))[:RAREST]
        whole = sum(idf[w] for w, _ in rare)
        out.append({"label": label, "keys": keys, "words": [(w, at, idf[w] / whole) for w, at in rare]})
    return out


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(hits: Column, word: str, k: int) -> Column:
    """Places of a word among index hits (word, place), moved back by k."""
    return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - k)


def _phrase_places(hits: Column, phrase: list[str]) -> Column:
    """Starts of the phrase: where all its words agree on one position."""
    return reduce(F.array_intersect, [_starts(hits, word, k) for k, word in enumerate(phrase)])


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.alias("place")))


def scan(docs: DataFrame) -> DataFrame:
    """(row, n_words, base, templates) per input row.

    ``base`` lists (label, place) of base phrases, ``templates`` lists (label, place,
    share) of verified templates, at their best position.
    """
    index = rare_index(*document_frequencies(docs))
    vocab = vocabulary()
    words = wrap(docs).select("row", alnum_words(F.col("text")).alias("words"))
    hits = words.select(
        "row",
        "words",
        F.filter(
            F.transform("words", lambda w, i: F.when(w.isin(vocab), F.struct(w.alias("w"), i.cast("int").alias("i")))),
            lambda x: x.isNotNull(),
        ).alias("hits"),
    )
    base = F.flatten(F.array(*[_labelled(_phrase_places(F.col("hits"), _words(p)), label) for p, label in BASE_PHRASES.items()]))
    votes = hits.select("row", "words", F.size("words").cast("long").alias("n_words"), base.alias("base"), "hits")
    found = F.array(*[_template(F.col("hits"), F.col("words"), entry) for entry in index])
    none = F.array().cast("array<struct<label:string,place:int,share:double>>")
    return votes.select(
        "row",
        "n_words",
        "base",
        F.when(F.size("hits") > 0, F.filter(found, lambda x: x.isNotNull())).otherwise(none).alias("templates"),
    )


def _template(hits: Column, words: Column, entry: dict) -> Column:
    """(label, place, share) of a template at its best aligned position, if verified; else null."""
    weight = F.create_map(*[x for w, _, share in entry["words"] for x in (F.lit(w), F.lit(share))])
    offset = F.create_map(*[x for w, at, _ in entry["words"] for x in (F.lit(w), F.lit(at))])
    rare = [w for w, _, _ in entry["words"]]
    posted = F.sort_array(
        F.transform(
            F.filter(hits, lambda h: h["w"].isin(rare)),
            lambda h: F.struct((h["i"] - offset[h["w"]]).alias("at"), h["w"].alias("w"), weight[h["w"]].alias("share")),
        )
    )
    # one pass over the postings in position order: the running share of the current position, and the best so far
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("place"), F.lit(0.0).alias("share"))

    def step(acc, x):
        total = F.when(acc["at"] == x["at"], acc["sum"]).otherwise(0.0) + x["share"]
        better = total > acc["share"]
        return F.struct(
            x["at"].alias("at"),
            total.alias("sum"),
            F.when(better, x["at"]).otherwise(acc["place"]).alias("place"),
            F.when(better, total).otherwise(acc["share"]).alias("share"),
        )

    best = F.aggregate(posted, start, step)
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    verified = F.lit(True)
    for key in entry["keys"]:
        verified = verified & text.contains(f" {key} ")
    one = F.transform(F.array(best), lambda b: F.when(
        (b["share"] >= NEEDED) & verified,
        F.struct(F.lit(entry["label"]).alias("label"), F.greatest(b["place"], F.lit(0)).alias("place"), F.least(b["share"], F.lit(1.0)).alias("share")),
    ))
    return F.get(one, F.lit(0))
