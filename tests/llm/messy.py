"""A small table with every awkward row, and an empty one."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _n int, size string, id string, k long, text_sha256 string, _salt string, held_out string, score string, offset string, _sha string, _keep_id string, _keep_sha string, _own_text string, _kept_id string, _kept_text string, _copies string, _times string, _time string, _words string, _first string, _part string, _cut string, row string, node string, n string"
_CLASH = ("x", 1, "y", "z", 7, "sha", "salt", "no", "high", "far", *"abcdefghijklmnop")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def texts() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = prose(rng, 30_000, 5_000)
    rows = [
        (1, base, "en", "b"),
        (2, base, "en", "b"),
        (3, base.replace(" ", "\n", 3), "en", None),
        (4, " ".join(near), "de", "a"),
        (5, "", "en", "a"),
        (6, None, None, None),
        (7, " \t\n", "fr", "a"),
        (8, "!!!", "fr", "c"),
        (9, long, "en", "b"),
        (10, long + " tail", "en", "b"),
        (11, "Émile Ünter ß 日本語 🙂", None, "é"),
        (12, base, "en", "b"),
        (12, base, "en", "b"),  # a repeated row
        (None, "no id here", "en", "a"),
        (None, base, "en", "a"),
        (13, "a b c", "en", ""),
        (14, prose(rng, 80), "de", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *_CLASH) for i, t, lang, s in rows]


def messy(spark):
    return spark.createDataFrame(texts(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
