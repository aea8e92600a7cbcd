"""Licence scans by a positional index of rare words.

Licence notices are templates: words at fixed places, some of them in key phrases that must stand. The index holds, for each
template, the two words of its key phrases that the fewest documents hold. A file's licence words are looked up in it, the
rarest first: each occurrence names the places where a template may begin, and only places that both words name are kept.
There the key phrases are verified word by word. A template can't stand in a file without its rarest words at their places,
so nothing is lost; less rare words need no look-up.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotated, byte_slices, raw_texts, words

#: Phrases of the base labels, and notices (fixed values): key phrases stand in brackets, a notice begins with one.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
NOTICES = [
    ("agpl", "[gnu affero general public license]"),
    ("apache", "[licensed under the apache license version 2 0] the license you may not use this file [except in compliance with the license]"),
    ("artistic", "[artistic license 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that the following conditions are met]"),
    ("boost", "[boost software license]"),
    ("cc-by", "[creative commons attribution]"),
    ("cc-by-nc", "[cc by nc]"),
    ("cc-by-nd", "[cc by nd]"),
    ("cc-by-sa", "[cc by sa]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("epl", "[eclipse public license]"),
    ("gpl", "[this program is free software] you can redistribute it and or modify it [under the terms of the gnu general public license] as published by the free software foundation"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose [with or without fee is hereby granted]"),
    ("lgpl", "[gnu lesser general public license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction]"),
    ("mpl", "[mozilla public license]"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
    ("zlib", "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable"),
]


class Template(NamedTuple):
    label: str
    base: bool
    words: list[bytes]
    #: place and words of each key phrase
    phrases: list[tuple[int, list[bytes]]]


def template(label: str, text: str, base: bool = False) -> Template:
    found, phrases = [], []
    for piece in text.replace("[", "\n[").replace("]", "]\n").split("\n"):
        own = words(piece.encode())
        if piece.startswith("["):
            phrases.append((len(found), own))
        found += own
    return Template(label, base, found, phrases)


TEMPLATES = [template(label, f"[{text}]", True) for label, text in BASE] + [template(label, text) for label, text in NOTICES]
FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
    *(T.StructField(c, T.StringType()) for c in ("base_labels", "labels")), T.StructField("score", T.DoubleType()),
]


def key_words(templates: list[Template]) -> set[bytes]:
    return {w for t in templates for _, phrase in t.phrases for w in phrase}


def document_counts(docs: DataFrame, templates: list[Template], text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the key phrases stands; a row for each such word at most is gathered."""
    wanted = key_words(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for (part,) in byte_slices((batch.column(0),)):
                for raw in raw_texts(part):
                    for word in wanted.intersection(words(raw)):
                        counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def rare_index(templates: list[Template], counts: dict[bytes, int]) -> tuple[dict[bytes, list[tuple[int, int]]], list[list[bytes]]]:
    """Postings (template, place) of the two rarest key words of each template, and each template's own words, the rarest first."""
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    rarest = []
    for k, t in enumerate(templates):
        places: dict[bytes, list[int]] = defaultdict(list)
        for start, phrase in t.phrases:
            for i, w in enumerate(phrase):
                places[w].append(start + i)
        own = sorted(places, key=lambda w: (counts.get(w, 0), w))[:2]
        rarest.append(own)
        for w in own:
            postings[w].append((k, places[w][0]))
    return dict(postings), rarest


def placements(tokens: list[bytes], templates: list[Template], postings: dict[bytes, list[tuple[int, int]]], rarest: list[list[bytes]]) -> list[tuple[int, int]]:
    """(template, first word) of each place of one text where a template's key phrases stand at their places."""
    where: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(tokens):
        if w in postings:
            where[w].append(i)
    starts: dict[int, set[int]] = {}
    for k, own in enumerate(rarest):
        for w in own:
            place = next(p for t, p in postings[w] if t == k)
            begins = {i - place for i in where.get(w, ()) if i >= place}
            starts[k] = begins & starts[k] if k in starts else begins
            if not starts[k]:
                break
    found = []
    for k, begins in starts.items():
        phrases = templates[k].phrases
        found += [(k, s) for s in begins if all(tokens[s + at : s + at + len(phrase)] == phrase for at, phrase in phrases)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def scanned(docs: DataFrame, templates: list[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, without a shuffle of rows.

    Places, their number and base_labels are those of the base templates, labels those of all. score is the greatest share of
    a placed template's words that stand at their places, so 1 for a base phrase and 0 where none is placed. A null text is an
    empty one: no words, no labels, null places. Columns of docs that bear these names are replaced.
    """
    postings, rarest = rare_index(templates, document_counts(docs, templates, text))

    def make():
        def of(column: pa.Array) -> list[pa.Array]:
            rows = []
            for raw in raw_texts(column):
                tokens = words(raw)
                found = placements(tokens, templates, postings, rarest)
                base = [s for k, s in found if templates[k].base]
                share = lambda k, s: sum(a == b for a, b in zip(templates[k].words, tokens[s : s + len(templates[k].words)])) / len(templates[k].words)
                names = [",".join(sorted({templates[k].label for k, _ in found if not only or templates[k].base})) for only in (True, False)]
                rows.append((len(tokens), len(base), base[0] if base else None, base[-1] if base else None, *names, max((share(k, s) for k, s in found), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

        return of

    return annotated(docs, FIELDS, make, (text,))
