"""License scans by a positional rare-token index, in DataFrame operations only.

Each phrase is indexed under its word of highest IDF.  A file looks up these words; one at place p with offset o proposes
its phrase to start at p - o, and the phrase stands where all of its words are there.  A template's label needs its
mandatory key phrase, so each place of the key proposes the template; it is then held against all the template's words at
their places, and stands where those that agree make up enough of its weight.  Nothing is limited by number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words: every ASCII character but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Phrase:
    text: str
    label: str


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    key: str  # a phrase of the template


BASE_PHRASES = (
    Phrase("gnu general public license", "gpl"),
    Phrase("apache license", "apache"),
    Phrase("cc by", "cc-by"),
    Phrase("mit license", "mit"),
)
#: Opening words of public licence notices.
TEMPLATES = (
    Template("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", "general public license"),
    Template("This work is licensed under the GNU General Public License, version 3", "gpl-3.0", "general public license version 3"),
    Template("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl", "lesser general public license"),
    Template("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache", "apache license"),
    Template("Licensed under the Apache License, Version 2.0", "apache-2.0", "apache license version 2 0"),
    Template("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "permission is hereby granted"),
    Template("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "source and binary forms"),
    Template("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", "permission to use copy modify"),
    Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0", "mozilla public license"),
    Template("This is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
    Template("Licensed under CC BY-NC 4.0", "cc-by-nc", "cc by nc"),
    Template("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by", "creative commons attribution"),
)
#: The least share of a template's weight.
LEAST_SHARE = 0.6
#: Of a word that all rows hold.
LEAST_WEIGHT = 1e-2


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]


def file_words(text: Column) -> Column:
    """The words of a whole text, not yet lower-cased; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def document_frequencies(df: DataFrame, vocabulary: list[str], *, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows, and for each word of the (fixed, small) vocabulary the rows that hold it.  Pre-aggregated in each task."""
    distinct = F.array_distinct(file_words(F.col(f"`{text_col}`")))
    held = F.filter(F.transform(distinct, F.lower), lambda w: w.isin(*vocabulary))
    got = df.select(F.explode_outer(F.array_append(F.array_distinct(held), F.lit(""))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in got}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


@dataclass(frozen=True)
class Index:
    phrases: tuple[Phrase, ...]  # base phrases first, then keys
    templates: tuple[Template, ...]
    idf: dict[str, float]

    def anchors(self) -> dict[str, list[tuple[int, int, list[str]]]]:
        """word -> (phrase's number, the word's offset in it, the phrase's words): each phrase under its rarest word."""
        out: dict[str, list[tuple[int, int, list[str]]]] = {}
        for t, p in enumerate(self.phrases):
            own = words_of(p.text)
            o = max(range(len(own)), key=lambda i: self.idf[own[i]])
            out.setdefault(own[o], []).append((t, o, own))
        return out

    def by_key(self) -> dict[int, list[tuple[int, int, list[tuple[str, float]]]]]:
        """Number of a key phrase -> (template's number, the key's offset in it, the template's words and weights)."""
        out: dict[int, list[tuple[int, int, list[tuple[str, float]]]]] = {}
        for t, (x, (k, o)) in enumerate(zip(self.templates, self.keys(), strict=True), len(self.phrases)):
            out.setdefault(k, []).append((t, o, [(w, self.idf[w]) for w in words_of(x.text)]))
        return out

    def keys(self) -> list[tuple[int, int]]:
        """For each template: the number of its key phrase and the phrase's offset in it."""
        number, out = {p.text: i for i, p in enumerate(self.phrases)}, []
        for x in self.templates:
            own, key = words_of(x.text), words_of(x.key)
            out.append((number[x.key], next(i for i in range(len(own)) if own[i : i + len(key)] == key)))
        return out


def build_index(df: DataFrame, *, base: tuple[Phrase, ...] = BASE_PHRASES, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> Index:
    """Weighs the templates' words by their IDF over all rows of `df`.  Every word weighs something at every size, also
    one in all rows, so a notice that is common is found as a rare one is."""
    import math

    known = {p.text for p in base}
    keys = tuple(dict.fromkeys(t.key for t in templates if t.key not in known))
    vocabulary = sorted({w for x in (*templates, *base) for w in words_of(x.text)})
    n, counts = document_frequencies(df, vocabulary, text_col=text_col)
    idf = {w: math.log((n + 1) / (c + 1)) + LEAST_WEIGHT for w, c in counts.items()}
    return Index(base + tuple(Phrase(k, "") for k in keys), templates, idf)


def scan(df: DataFrame, index: Index, *, n_base: int = len(BASE_PHRASES), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and places: array of (template,
    start, share) of everything aligned and verified.

    A null or empty text has no words: counts of 0, null places, empty labels, score 0.  Repeated rows are scanned each
    by itself; no shuffle, so nothing depends on keys.  An empty table gives an empty result.  Other columns are ignored.
    """
    anchors = index.anchors()
    phrase = "array<struct<t:int,o:int,own:array<string>>>"
    lookup = F.create_map(*(x for w, es in anchors.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(o).alias("o"), F.array(*map(F.lit, own)).alias("own")) for t, o, own in es)).cast(phrase))))
    template = "array<struct<t:int,o:int,full:double,own:array<struct<w:string,v:double>>>>"
    keyed = F.create_map(*(x for k, ts in index.by_key().items() for x in (F.lit(k), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(o).alias("o"), F.lit(sum(v for _, v in own)).alias("full"), F.array(*(F.struct(F.lit(w).alias("w"), F.lit(v).alias("v")) for w, v in own)).alias("own")) for t, o, own in ts)).cast(template))))

    words = df.select(F.col(f"`{id_col}`").alias("doc_id"), file_words(F.lower(F.col(f"`{text_col}`"))).alias("words"))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: x["w"].isin(*anchors))
    occurring = words.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), placed.alias("occ"))

    def stands(start: Column, own: Column) -> Column:
        return F.when(start >= 0, F.slice("words", start + 1, F.size(own)) == own).otherwise(False)

    def phrases_at(x: Column) -> Column:
        right = F.filter(F.try_element_at(lookup, x["w"]), lambda q: stands(x["p"] - q["o"], q["own"]))
        return F.transform(right, lambda q: F.struct(q["t"].alias("t"), (x["p"] - q["o"]).alias("start"), F.lit(1.0).alias("share")))

    found = F.flatten(F.transform("occ", phrases_at))
    places = "array<struct<t:int,start:int,share:double>>"
    none = F.array().cast(places)
    phrased = occurring.select("doc_id", "words", "n_words", F.when(F.size("occ") > 0, found).otherwise(none).alias("found"))

    def share(start: Column, q: Column) -> Column:
        held = F.transform(q["own"], lambda y, i: F.when(F.get("words", start + i) == y["w"], y["v"]).otherwise(0.0))
        return F.aggregate(held, F.lit(0.0), lambda s, v: s + v) / q["full"]

    def templates_at(x: Column) -> Column:
        return F.transform(F.coalesce(F.try_element_at(keyed, x["t"]), F.array().cast(template)), lambda q: F.struct(q["t"].alias("t"), (x["start"] - q["o"]).alias("start"), share(x["start"] - q["o"], q).alias("share")))

    whole = F.filter(F.flatten(F.transform("found", templates_at)), lambda x: x["share"] >= LEAST_SHARE)
    both = F.array_sort(F.concat(F.filter("found", lambda x: x["t"] < n_base), whole))
    sure = phrased.select("doc_id", "n_words", F.when(F.size("found") > 0, both).otherwise(none).alias("places"))
    names = [p.label for p in index.phrases] + [t.label for t in index.templates]
    label = F.create_map(*(x for t, name in enumerate(names) for x in (F.lit(t), F.lit(name))))
    base = F.filter("places", lambda x: x["t"] < n_base)
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    listed = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: label[x["t"]]))), ",")
    return sure.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: F.least(x["share"], F.lit(1.0)))), F.lit(0.0)).alias("score"), "places",
    )
