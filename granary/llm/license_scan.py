"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of at most ``block_words`` words of a text, line ends counting as white space, as notices are
wrapped over lines; blocks of a longer text overlap by the widest such run of a template. Template tokens
are ordered by their document frequency over the whole corpus, rarest first. A block can only reach containment
``t`` of a template of n tokens if it has one of the template's first n - ceil(t n) + 1 tokens (prefix filter), has
ceil(t n) tokens at all (length filter) and, from its first common token on, enough of the template is left
(positional filter). What passes is verified, so exactly the matching pairs are found. A match counts if the words
stand together, within a run of ``SLACK`` times the template's words, and if none of its deciding words is missing.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ship

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening sentences of well-known license notices, and the labels they add.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
    "apache-2.0-line": "licensed under the apache license version 2.0",
    "gpl-3.0-line": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit-line": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "cc-by-nc-4.0-line": "licensed under cc by nc 4.0",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4.0 international license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}
MAX_TEMPLATE_TOKENS = 100_000
#: A notice may take so many times the words of its template.
SLACK = 2
#: Templates of at most so many distinct words match whole; of longer ones, words with digits must be there.
SHORT = 8
#: Bytes of words: digits, lower-case letters (upper-case ones are lowered) and all above 0x7F; others part words.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class TemplateIndex:
    """Inverted index over the prefixes of templates in one global token order."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.sizes, self.need, self.rank, self.index = {}, {}, {}, {}
        tokens = {name: set(words_of(text)) for name, text in templates.items()}
        self.order = {t: i for i, t in enumerate(sorted(set().union(*tokens.values()), key=lambda t: (frequency.get(t, 0), t)))}
        for name, some in tokens.items():
            if not some:
                continue
            ordered = sorted(some, key=self.order.__getitem__)
            need = max(1, math.ceil(threshold * len(some) - 1e-9))
            self.sizes[name], self.need[name] = len(some), need
            self.rank[name] = {t: i for i, t in enumerate(ordered)}
            for place, t in enumerate(ordered[: len(some) - need + 1]):
                self.index.setdefault(t, []).append((name, place))

    def match(self, block: set[bytes]) -> dict[str, float]:
        """Templates that the block contains to the threshold, and how far."""
        found: dict[str, float] = {}
        tried = set()
        for token in sorted(block & self.index.keys(), key=self.order.__getitem__):
            for name, place in self.index[token]:
                # The first common token in the global order decides, as all earlier ones of the template are absent.
                if name in tried:
                    continue
                tried.add(name)
                if len(block) < self.need[name] or self.sizes[name] - place < self.need[name]:
                    continue
                common = sum(t in block for t in self.rank[name])
                if common >= self.need[name]:
                    found[name] = common / self.sizes[name]
        return found


def blocks_of(words: list[bytes], block_words: int, widest: int):
    """Runs of words, such that every run of ``widest`` is within one."""
    step = max(1, block_words - widest + 1)
    for at in range(0, max(1, len(words) - block_words + step), step):
        yield words[at : at + block_words]


def deciding(template: str) -> set[bytes]:
    """Words of a template that may not be missing, as they tell licenses apart."""
    tokens = set(words_of(template))
    return tokens if len(tokens) <= SHORT else {t for t in tokens if any(0x30 <= b <= 0x39 for b in t)}


def closest(words: list[bytes], tokens: set[bytes], needed: set[bytes], width: int) -> int:
    """The most of ``tokens`` that a run of ``width`` words has, among runs with all of ``needed``."""
    held, lacking, best = {}, len(needed), 0
    for at, word in enumerate(words):
        if word in tokens:
            held[word] = held.get(word, 0) + 1
            lacking -= held[word] == 1 and word in needed
        if at >= width and (old := words[at - width]) in tokens:
            if held[old] == 1:
                del held[old]
                lacking += old in needed
            else:
                held[old] -= 1
        if not lacking:
            best = max(best, len(held))
    return best


def token_frequencies(docs: DataFrame, text_col: str, tokens: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the templates' tokens stands, over all documents."""

    def count(batches):
        found: dict[bytes, int] = {}
        for batch in batches:
            for text in batch["_text"]:
                for t in tokens & set(words_of(text)):
                    found[t] = found.get(t, 0) + 1
        if found:  # Spark takes no frame without rows
            yield pd.DataFrame({"token": [t.decode() for t in found], "n": list(found.values())})

    counted = docs.select(F.col(text_col).alias("_text")).mapInPandas(count, "token string, n long")
    return {r.token.encode(): r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = 0.85,
    block_words: int = 256,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are the smallest and largest
    of their starts. ``labels`` adds the templates of whose distinct tokens a run of SLACK times their words has
    ``threshold``, deciding ones all; those of at most SHORT tokens match whole. ``score`` is 1 with a phrase, else the largest containment that reached the threshold, else 0.

    Defined cases: a null or empty text has no words and no labels; repeated rows and null ids give a row each;
    an empty table gives an empty result; other columns are ignored. The templates, up to MAX_TEMPLATE_TOKENS
    tokens, go to every worker.
    """
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    tokens = set().union(*(words_of(t) for t in templates.values())) if templates else set()
    if len(tokens) > MAX_TEMPLATE_TOKENS:
        raise ValueError(f"the templates have more than {MAX_TEMPLATE_TOKENS} tokens")
    index = TemplateIndex(templates, token_frequencies(docs, text_col, tokens), threshold)
    width = {name: SLACK * len(words_of(t)) for name, t in templates.items()}
    if any(n > block_words for n in width.values()):
        raise ValueError(f"a block must hold {SLACK} times the longest template")
    widest, must = max(width.values(), default=0), {name: deciding(t) for name, t in templates.items()}
    phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in PHRASES.items()]
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches):
        keys = index.index.keys()
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["_text"], strict=True):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                starts, base = [], set()
                for phrase, label in phrases:
                    at, past, before = joined.find(phrase), 0, 0
                    while at >= 0:
                        before += joined.count(b" ", past, at)
                        starts.append(before)
                        base.add(label)
                        past, at = at, joined.find(phrase, at + 1)
                best: dict[str, float] = {}
                if not keys.isdisjoint(words):
                    for block in blocks_of(words, block_words, widest):
                        for name in index.match(set(block)):
                            common = closest(block, index.rank[name].keys(), must[name], width[name])
                            if common >= index.need[name]:
                                best[name] = max(common / index.sizes[name], best.get(name, 0.0))
                rows.append(
                    (
                        key,
                        len(words),
                        len(starts),
                        min(starts) if starts else None,
                        max(starts) if starts else None,
                        ",".join(sorted(base)),
                        ",".join(sorted(base | best.keys())),
                        1.0 if base else max(best.values(), default=0.0),
                    )
                )
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInPandas(
        read,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
