"""License scans: an exact set-similarity join of text blocks with licence templates.

Blocks are the lines of a text and its paragraphs (runs of lines that aren't blank). A block matches a template
when it holds at least `threshold` of the template's distinct words. The words of the templates are ordered by
their frequency in the whole corpus, rarest first. A block that reaches the threshold shares a word with the
template's prefix in that order; it holds at least as many template words as the threshold asks for (length
filter); and from the place of the first shared word enough words must be left on both sides (positional
filter). What passes is counted exactly. The templates are a fixed list, so their index fits every task.

Beside that, a document is searched for base phrases, whose words stand consecutively.

Defined results: a null text is an empty one: no words, no labels, score 0. Rows that repeat an id are each
scanned. The score is the largest share of a template that a block holds, among matching pairs; 1 with a base
phrase. Very long texts are scanned whole, block by block. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Base phrases and labels, and notices of well-known licences.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8

_IN_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes with A-Z in lower case."""
    return data.lower().translate(_IN_WORD).split()


@dataclass
class TemplateIndex:
    """Templates as rank-ordered word lists, and the words of their prefixes."""

    labels: list[str]
    words: list[list[int]]
    needed: list[int]
    ranks: dict[bytes, int]
    prefixes: dict[int, list[tuple[int, int]]]  # rank -> (template, place of the word in it)


def template_words(templates=TEMPLATES) -> set[bytes]:
    return {w for _, text in templates for w in words_of(text.encode())}


def index_of(frequency: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> TemplateIndex:
    order = sorted(template_words(templates), key=lambda w: (frequency.get(w, 0), w))
    ranks = {w: at for at, w in enumerate(order)}
    index = TemplateIndex([], [], [], ranks, {})
    for at, (label, text) in enumerate(templates):
        own = sorted({ranks[w] for w in words_of(text.encode())})
        needed = ceil(threshold * len(own) - 1e-9)
        index.labels.append(label)
        index.words.append(own)
        index.needed.append(needed)
        for place, rank in enumerate(own[: len(own) - needed + 1]):
            index.prefixes.setdefault(rank, []).append((at, place))
    return index


def matches(block: set[int], index: TemplateIndex) -> list[tuple[int, float]]:
    """(template, share of its words in the block) of the templates that a set of word ranks reaches."""
    own, first, out = sorted(block), {}, []
    for j, rank in enumerate(own):
        for at, place in index.prefixes.get(rank, ()):
            first.setdefault(at, (place, j))
    for at, (place, j) in first.items():
        words, needed = index.words[at], index.needed[at]
        if len(own) < needed or 1 + min(len(words) - place - 1, len(own) - j - 1) < needed:
            continue
        common = len(block.intersection(words))
        if common >= needed:
            out.append((at, common / len(words)))
    return out


def corpus_frequency(documents: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How often each template word stands in the corpus: one row per template word comes to the driver."""
    known = template_words(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for part in batches:
            for text in part["text"]:
                if text:
                    total.update(filter(known.__contains__, words_of(text.encode("utf-8", "surrogatepass"))))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counts = documents.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


def blocks_of(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """Lines and paragraphs of several lines, with their numbers."""
    paragraph: list[bytes] = []
    count = 0
    lines = data.split(b"\n")
    for number, line in enumerate([*lines, b""]):
        if line.strip():
            yield "line", number, line
            paragraph.append(line)
        elif paragraph:
            if len(paragraph) > 1:
                yield "paragraph", count, b"\n".join(paragraph)
            count += 1
            paragraph = []


_PHRASE_WORDS = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]


def scan(text: str | None, index: TemplateIndex) -> dict:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(data)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in _PHRASE_WORDS:
        at = joined.find(phrase)
        while at >= 0:
            starts.append(joined.count(b" ", 0, at))
            base.add(label)
            at = joined.find(phrase, at + 1)
    present = {index.ranks[w] for w in set(words) & index.ranks.keys()}
    found = []
    if any(rank in index.prefixes for rank in present):
        for kind, number, block in blocks_of(data):
            ranks = {index.ranks[w] for w in words_of(block) if w in index.ranks}
            found += [(kind, number, index.labels[at], share) for at, share in matches(ranks, index)]
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": sorted(base), "matches": found,
    }


def scan_documents(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches) of every document, the matches as an
    array of (block, number, label, share)."""
    index = documents.sparkSession.sparkContext.broadcast(index_of(corpus_frequency(documents, templates), templates, threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = pd.DataFrame([scan(t, index.value) for t in part["text"]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "matches"])
            out["matches"] = [[dict(zip(("block", "number", "label", "share"), m)) for m in row] for row in out["matches"]]
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield out

    kinds = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
             "matches array<struct<block: string, number: long, label: string, share: double>>")
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {kinds}")
