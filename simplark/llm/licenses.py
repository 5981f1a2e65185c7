"""License scans: an exact set-similarity join of blocks of text with license templates.

A template is a sequence of words. Texts are cut into blocks of twice a template's length that
begin at each of its lengths, so that a passage as long as the template lies whole in one block. A
block meets a template when it has at least the share ``threshold`` of its distinct words. Two kinds
of template take part: phrases, whose words must all be there (share 1) and then stand one
after the other, and notices, whose share counts as it is.

The join is exact. Tokens are ordered by their frequency in all texts, the rarest first, ties by
themselves. To meet a template of m tokens a block needs ``k = ceil(threshold m)`` of them, so it has one of
the first m - k + 1 (prefix filter): most texts have none and end there. Blocks with fewer than k
tokens of any template are left out (length filter), and so are those in which the first shared token
leaves too few behind it, among the template's tokens or the block's (positional filter). What
remains is counted.

On Spark: one pass counts the templates' tokens with partial sums, one pass joins. Templates and
their prefixes are small by a checked bound and travel with the tasks; no text is shuffled, so one
hot source or very long document costs what it has of bytes. Phrases are looked for at each
place of their blocks and counted in the first block that holds them.

Defined cases: a null text is empty; a text without words has n_words 0, no labels (the empty
string) and score 0. Repeated rows give a row each. Places of different phrases count each. The score is
the largest share of a notice's tokens that a block meeting it has, 1 where a phrase stands, else 0. Other
columns may have any names; none is read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplark.llm.common import named, small

#: The phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: License notices as their authors ask to state them, in words.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)

THRESHOLD = 0.8
#: Words of all templates together; they travel with each task.
MOST_TEMPLATE_WORDS = 1_000_000
#: Word bytes: letters, digits and all that isn't ASCII. A-Z become a-z, the rest separates.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrase: bool
    needed: int  # tokens that a block must have
    tokens: np.ndarray  # distinct tokens by rank, the rarest first


def templates(phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> list[tuple[str, list[bytes], bool, int]]:
    """(label, words, is a phrase, tokens needed) of each template."""
    found = [(label, words_of(text.encode()), phrase) for rows, phrase in ((phrases, True), (notices, False)) for label, text in rows]
    if any(not words for _, words, _ in found) or sum(len(words) for _, words, _ in found) > MOST_TEMPLATE_WORDS:
        raise ValueError("templates have at least one word each, and bounded words in all")
    # In whole numbers where the product is one but for rounding.
    return [(label, words, phrase, len(set(words)) if phrase else max(1, ceil(threshold * len(set(words)) - 1e-9))) for label, words, phrase in found]


def token_counts(docs: DataFrame, tokens: set[bytes], text: str = "text") -> Counter:
    """How often each of the templates' tokens occurs in all texts."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in texts_of(batch.column(0)):
                seen.update(filter(tokens.__contains__, words_of(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(named(text).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return Counter({bytes(r.token): r.n for r in rows.collect()})  # at most the templates' tokens


class Scanner:
    """The templates in the global order of their tokens, with the index of their prefixes."""

    def __init__(self, found: list[tuple[str, list[bytes], bool, int]], counts: Counter):
        order = sorted({w for _, words, _, _ in found for w in words}, key=lambda w: (counts[w], w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = [Template(label, words, phrase, needed, np.sort([self.rank[w] for w in set(words)])) for label, words, phrase, needed in found]
        self.prefixes: dict[int, list[int]] = {}
        for k, t in enumerate(self.templates):
            for token in t.tokens[: len(t.tokens) - t.needed + 1]:
                self.prefixes.setdefault(int(token), []).append(k)
        self.starters = frozenset(order[i] for i in self.prefixes)

    def blocks(self, t: Template, places: np.ndarray, ranks: np.ndarray) -> list[tuple[int, int]]:
        """(block, shared tokens) of the blocks that meet a template; places and ranks: of all template tokens in the text."""
        step, most = len(t.words), len(t.tokens)
        inside = np.searchsorted(t.tokens, ranks)
        inside = np.where((inside < most) & (t.tokens[np.minimum(inside, most - 1)] == ranks), inside, -1)
        prefix = most - t.needed
        hits = places[(inside >= 0) & (inside <= prefix)] // step
        met = []
        for block in np.unique(np.concatenate((hits, hits[hits > 0] - 1))).tolist():
            here = slice(*np.searchsorted(places, (block * step, (block + 2) * step)))
            if here.stop - here.start < t.needed:  # length
                continue
            mine = np.unique(ranks[here])
            at = inside[here]
            first = int(at[at >= 0].min())
            if min(most - first, len(mine) - int(np.searchsorted(mine, t.tokens[first]))) < t.needed:  # position
                continue
            shared = len(np.unique(at[at >= 0]))
            if shared >= t.needed:
                met.append((int(block), shared))
        return met

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """(n_base, first_word, last_word, base labels, all labels, score) of a text."""
        if self.starters.isdisjoint(words):
            return 0, None, None, set(), set(), 0.0
        rank = self.rank.get
        places, ranks = np.array([(i, r) for i, r in enumerate(map(rank, words)) if r is not None], np.int64).T
        near = {k for r in np.unique(ranks).tolist() for k in self.prefixes.get(r, ())}
        starts, base, labels, score = [], set(), set(), 0.0
        for k in sorted(near):
            t = self.templates[k]
            met = self.blocks(t, places, ranks)
            if t.phrase:
                n = len(t.words)
                found = [i for block, _ in met for i in range(block * n, (block + 1) * n) if words[i : i + n] == t.words]
                if found:
                    starts += found
                    base.add(t.label)
                    score = 1.0
            elif met:
                labels.add(t.label)
                score = max(score, max(shared for _, shared in met) / len(t.tokens))
        return len(starts), min(starts, default=None), max(starts, default=None), base, base | labels, score


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    found = templates(phrases, notices, threshold)
    scanner = Scanner(found, token_counts(docs, {w for _, words, _, _ in found for w in words}, text))
    rows = docs.select(named(key).alias("doc_id"), named(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in small(batches, 1):
            columns: list[list] = [[] for _ in range(7)]
            for raw in texts_of(batch.column(1)):
                words = words_of(raw)
                n, first, last, base, labels, score = scanner.scan(words)
                for column, value in zip(columns, (len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score), strict=True):
                    column.append(value)
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
