import itertools
import math
import os
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import langid, license_scan, lm_score, queries, toxicity
from granary.llm.common import fold_of
from tests.llm.messy import empty, messy, texts


def test_fold(spark):
    rows = messy(spark).select("doc_id", fold_of("doc_id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in rows)


# -- language -------------------------------------------------------------------------------------------------------
SYLLABLES = {"en": ["the", "ing", "tion", "er"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "è", "que", "oi"], "es": ["ción", "os", "ñ", "ar"]}


def speech(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_codewords():
    assert langid.codewords(4).shape == (4, 7)
    for n in (2, 4, 5, 9, 30):
        code = langid.codewords(n).astype(int)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= (1 if n == 2 else 2)


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, speech(rng, lang), lang, "x", 1) for k, lang in enumerate(list(SYLLABLES) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score int")
    held = F.col("doc_id") % 5 == 0
    model = langid.train(docs.where(~held))
    got = langid.predict(docs, model, held).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in got) and len(got) == 120
    assert model.predict("12 34 !")[0] == "und" and model.predict(None)[0] == "und" and model.predict("🙂")[0] == "und" and model.predict("½ ² Ⅷ ")[0] == "und" and model.predict("ª")[0] != "und"
    mixed = model.predict(speech(rng, "en", 40) + " " + speech(rng, "de", 40))
    assert mixed[0] in ("en", "de") and mixed[1] < 0.9999
    out = langid.predict(messy(spark), model).collect()
    assert len(out) == len(texts()) and {r.lang_pred for r in out if r.doc_id in (5, 6, 7, 8)} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0
    nothing = langid.train(empty(spark))
    assert {r.lang_pred for r in langid.predict(messy(spark), nothing).collect()} == {"und"}


# -- language model ---------------------------------------------------------------------------------------------------
@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 2**40 - 1), st.integers(1, 10**6), max_size=60))
def test_packed_counts(entries):
    keys = np.array(sorted(entries), np.uint64)
    counts = np.array([entries[int(k)] for k in keys], np.int64)
    k, c = lm_score.unpack_counts(lm_score.pack_counts(keys, counts))
    assert (k == keys).all() and (c == counts).all()


def test_filter_never_too_low_and_rarely_too_high():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 2**63, 30_000).astype(np.uint64))
    counts = np.minimum(5000, rng.zipf(1.6, len(hashes)))
    buckets = lm_score.bucket_of(hashes, 8)
    segments = {}
    for b in range(8):
        k, c = lm_score.merged(hashes[buckets == b] & lm_score._LOW40, counts[buckets == b])
        segments[b] = lm_score.build_segment(k, c, 1 << 30, 8, 5)
    table = lm_score.Filter(8, segments, 5)
    told, true = table.levels(hashes), lm_score.level_of(counts)
    assert (told >= true).all() and (told > true).mean() < 0.05
    others = np.setdiff1d(rng.integers(0, 2**63, 30_000).astype(np.uint64), hashes)
    assert (table.levels(others) > 0).mean() < 0.05
    # Within a tight bound a segment begins at a higher level; what is below counts as unseen.
    small = {b: lm_score.build_segment(*lm_score.merged(hashes[buckets == b] & lm_score._LOW40, counts[buckets == b]), 9000, 8, 5) for b in range(8)}
    assert all(bits <= 9000 + 64 and least > 1 for _, bits, least in small.values())
    tight = lm_score.Filter(8, small, 5)
    assert (tight.levels(hashes)[counts >= 256] >= true[counts >= 256]).all() and (tight.levels(hashes)[counts == 1] > 0).mean() < 0.1


@pytest.mark.parametrize("most_heavy", [100_000, 3])
def test_base_scores_are_exact(spark, most_heavy):
    held = fold_of("doc_id", 7) == 2
    got = lm_score.learn_and_score(messy(spark), held, most_heavy=most_heavy).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t, *_ in texts()]
    counts = Counter()
    for i, w in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(w), sum(counts[t] > 0 for t in w), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w), 4)) for i, w in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[2].score > by[2].base_score  # a copy of what was learned


def test_filter_grows_with_its_input(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(f"v{rng.randrange(20_000)}" for _ in range(100))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # So many bits that all n-grams take more than 800 million: none may go, and none of it goes with the model.
    model, vocab = lm_score.train(docs, bits_per_item=24_000)
    assert int(model.table.bits.sum()) > 800_000_000 and (model.table.least == 1).all()
    words, counts = lm_score.Words(), Counter()
    for _, some, starts in lm_score.chunks(t for _, t in rows):
        at = words.rows(some)
        h = words.hashes[at]
        counts.update(np.concatenate([lm_score.mix64(h + lm_score._M1), lm_score.bigrams(h, starts)]).tolist())
    told = model.table.levels(np.array(list(counts), np.uint64))
    assert (told >= lm_score.level_of(np.array(list(counts.values())))).all()
    assert len(pickle.dumps(model.table)) < 100_000
    exact = Counter(w for _, t in rows for w in [*t.split(), ""])
    assert {r.token: r.n for r in vocab.collect()} == exact


def test_scores_equal_a_model_with_exact_counts(spark):
    """With so many bits that probes don't err, a score is what counts of the same levels give, in plain Python."""
    held = fold_of("doc_id", 7) == 2
    model, vocab = lm_score.train(messy(spark).where(~held), bits_per_item=400, most_heavy=3)
    got = lm_score.score(messy(spark), model, vocab, held).collect()
    one, two = Counter(), Counter()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t, *_ in texts()]
    for i, w in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            one.update(w)
            two.update(zip([b"", *w], w, strict=False))

    def count(n):
        level = int(math.log2(n)) + 1 if n else 0
        return 0 if not n else 1 if level == 1 else 2 ** (level - 1) / math.log(2)

    def log10(a, b):
        alone = (count(one[b]) + 1) / (sum(one.values()) + len(one) + 1)
        if not one[a]:
            return math.log10(alone)
        w = model.weights[min(lm_score.BANDS - 1, int(math.log2(count(one[a]) + 1)))]
        return math.log10(w * min(1.0, count(two[a, b]) / max(1.0, count(one[a]))) + (1 - w) * alone)

    want = Counter((i, round(sum(log10(a, b) for a, b in zip([b"", *w], w, strict=False)), 3)) for i, w in tokens)
    assert Counter((r.doc_id, round(r.score, 3)) for r in got) == want
    assert (0 < model.weights).all() and (model.weights < 1).all()


def test_weights_are_fitted_on_all_training_documents(spark):
    """The weights equal those of plain Python over every training document, alone and when all are scored at once."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"v{int(30 * rng.random() ** 3)}" for _ in range(1 + k % 12))) for k in range(1500)]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), fold_of("doc_id", 7) == 2
    model, vocab = lm_score.train(docs.where(~held), bits_per_item=400)
    learned = [w.encode().split() + [b""] for k, w in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    pairs = [p for w in learned for p in zip([b"", *w], w, strict=False)]
    one, two = Counter(t for w in learned for t in w), Counter(pairs)

    def count(n):
        return 1 if n == 1 else 2 ** int(math.log2(n)) / math.log(2)

    seen = np.zeros((lm_score.BANDS, lm_score.QUOTIENTS))
    for (a, b), n in two.items():
        before = count(one[a])
        share = min(1.0, max(0, count(n) - 1) / max(1.0, before - 1))
        quotient = share / (count(one[b]) / (sum(one.values()) + len(one)))
        seen[int(math.log2(before + 1)), math.floor(4 * math.log2(quotient)) + lm_score.QUOTIENTS // 2 if quotient else 0] += n
    assert np.allclose(model.weights, lm_score.fit_weights(seen), rtol=0, atol=1e-9)
    apart = {r.doc_id: r.score for r in lm_score.score(docs, model, vocab, held).collect()}
    at_once = {r.doc_id: r.score for r in lm_score.learn_and_score(docs, held, bits_per_item=400).collect()}
    assert len(apart) == 1500 and at_once == pytest.approx(apart)


def test_empty_training(spark):
    assert lm_score.learn_and_score(empty(spark), fold_of("doc_id", 7) == 2).count() == 0
    got = lm_score.learn_and_score(messy(spark), F.lit(True)).collect()
    assert len(got) == len(texts()) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


# -- toxicity ----------------------------------------------------------------------------------------------------------
def test_grammar():
    g = toxicity.Composed()

    def best(marks):
        weight, _, taken = g.best([((m, 2.0 if m == "I" else 0.0),) for m in marks])
        return toxicity.pattern_of(taken), weight

    told = [best(x) for x in ("xx", "xIx", "AxI", "IxxA", "IxxxxxxxA", "NxI", "SxxI", "WTxA", "TA", "NIxA", "NIxxxIxA")]
    assert told == [("none", 0), ("plain", 2), ("aimed", 3), ("aimed", 3), ("plain", 2), ("negated", 0), ("reported", 0), ("threat", 2), ("none", 0), ("negated", 0), ("aimed", 3)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("ITANSWo"), st.integers(-2, 4)), min_size=1, max_size=3, unique_by=lambda x: x[0]), max_size=6), st.fixed_dictionaries({n: st.integers(-3, 3) for n in toxicity.ARCS}))
def test_composition_equals_all_paths(words, weights):
    """The heaviest path equals the best of all choices of marks, each sent through one transducer after another."""
    all_paths = []
    for choice in itertools.product(*words):
        marks, total = [m for m, _ in choice], sum(w for _, w in choice)
        for part in toxicity.PARTS:
            state, out = 0, []
            for m in marks:
                state, written, name = part.step(state, m)
                out.append(written)
                total += weights[name] if name else 0
            marks = out
        all_paths.append(total)
    assert toxicity.Composed(weights=weights).best([tuple(w) for w in words])[0] == max(all_paths)


def test_clauses_weigh_by_pattern():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "kill": 3.0}, {})
    weigh = lambda text: [(toxicity.pattern_of(t), w) for w, _, t in toxicity.matches(lexicon, toxicity.Composed(), text)[0]]
    assert weigh("Idiot. Not an idiot! He said idiot; you are an idiot") == [("plain", 2.0), ("negated", 0.0), ("reported", 0.0), ("aimed", 3.0)]
    assert weigh("I will kill you") == [("aimed", 4.0)] and toxicity.Lexicon({}, {}).marks("kill") == (("T", 0.0),)
    assert toxicity.pattern_of(toxicity.Composed().best([lexicon.marks(w) for w in "you will kill you".split()])[2]) in ("threat", "aimed")
    assert weigh("") == [] and weigh("nothing here.") == []
    arcs = toxicity.learn_arcs([({"plain"}, 1)] * 50 + [({"plain"}, 0)] * 50 + [({"negated"}, 0)] * 50 + [({"aimed"}, 1)] * 50)
    assert arcs["negated"] < -2 and arcs["aimed"] > 1 and arcs["threat"] == 2.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_figures(spark):
    """Languages and toxic documents of the test tables that weren't learned from."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op1_language_codes(spark, folder).join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred != 'und'").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    got = queries.op4_toxicity_grammar(spark, folder).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(toxic) > 5 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.03 * len(got)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(3)) for _ in range(60)]
        bad = k % 8 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["clod", "knave"]) if k % 16 else f"zorgle{chr(97 + rng.randrange(26))}"
        rows.append((k, " ".join(words) + ".", "x"))
        labels.append((k, int(bad), "y"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, "y"), (3, None, "y")], "doc_id long, toxic int, text string")
    held = F.col("doc_id") % 5 == 1
    model = toxicity.train(docs.where(~held), marks.where(~held))
    assert {"clod", "knave"} <= model.lexicon.words.keys() and any("zorgle".startswith(s) for s in model.lexicon.stems)
    got = toxicity.score(docs, model, held).collect()
    assert all(r.predicted == labels[r.doc_id][1] and 0 <= r.score <= 1 for r in got)
    out = toxicity.score(messy(spark), model).collect()
    assert len(out) == len(texts()) and not any(r.predicted for r in out)
    assert toxicity.score(empty(spark), model).count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 350
    blank = toxicity.train(empty(spark), marks)
    assert not any(r.predicted for r in toxicity.score(docs, blank).collect())


def test_copies_teach_nothing(spark):
    text = " ".join(f"q{k}" for k in range(50)) + "."
    docs = spark.createDataFrame([(k, text if k < 60 else f"clean words number n{k % 9}.") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert not model.lexicon.words and not model.lexicon.stems


# -- licenses ----------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lowered(text))
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENSED = [
    "Licensed under the Apache License, Version 2.0. MIT License; mit-license", "GNU General Public License", "released under the MIT License.", "cc by cc by", "ÉMIT License", "MIT", "0mit license", "mit license é",
    "This work is licensed under the GNU General Public License, version 3.", "a\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation", "word " * 3000 + "cc by",
]


def test_license_base(spark):
    rows = [(100 + k, t) for k, t in enumerate(LICENSED)] + [(i, t) for i, t, *_ in texts()]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, score int, labels string")
    got = license_scan.scan(df).collect()
    want = Counter((i, *brute_base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[100].labels == "apache,apache-2.0-line,mit" and by[102].labels == "mit,mit-line" and by[108].labels == "gpl,gpl-3.0-line"
    assert by[109].labels == "mit-permission" and 0.85 <= by[109].score < 1 and by[105].labels == "" and by[105].score == 0
    assert license_scan.scan(empty(spark)).count() == 0 and license_scan.scan(messy(spark), templates={}).count() == len(texts())


WRAPPED = {
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "apache-2.0-notice": " * Licensed under the Apache License,\n * Version 2.0 (the \"License\"); you may not\n * use this file except in compliance\n * with the License.",
    "gpl-notice": "# This program is free software: you can redistribute it and/or\r\n# modify it under the terms of the\r\n# GNU General Public License",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:",
    "mit-line": "Released under\nthe MIT License.",
}


def test_notices_over_several_lines(spark):
    rows = [(name, pad + text) for name, text in WRAPPED.items() for pad in ("", "int k;\n" * 63, "word\n" * 250, "word " * 380)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.doc_id in r.labels.split(",") for r in got)
    assert all(r.score >= 0.85 for r in got)


def test_labels_need_deciding_words_that_stand_together(spark):
    far = " word" * 20
    rows = [
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0-line"),
        ("This work is licensed under the GNU General Public License, version 2", "gpl"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0-line"),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License", ""),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0-notice"),
        (f"released{far} under{far} the{far} mit{far} license", ""),
        ("word " * 250 + "released under the MIT license" + far * 20, "mit,mit-line"),
    ]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(t for t, _ in rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {k: labels for k, (_, labels) in enumerate(rows)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=40), st.sets(st.sampled_from("abcdef"), min_size=1), st.integers(1, 12), st.randoms())
def test_closest_run(words, tokens, width, rng):
    needed = {t for t in tokens if rng.random() < 0.3}
    runs = [set(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    assert license_scan.closest(words, tokens, needed, width) == max((len(r & tokens) for r in runs if needed <= r), default=0)
    blocks = list(license_scan.blocks_of(words, max(width, 15), width))
    assert all(any(words[k : k + width] == b[i : i + width] for b in blocks for i in range(len(b))) for k in range(len(words) - width + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefghij"), min_size=1, max_size=8), min_size=1, max_size=5), st.sets(st.sampled_from("abcdefghijkl"), max_size=12), st.sampled_from([0.3, 0.5, 0.8, 1.0]), st.randoms())
def test_set_join_is_exact(templates, block, threshold, rng):
    named = {f"t{k}": " ".join(sorted(t)) for k, t in enumerate(templates)}
    index = license_scan.TemplateIndex(named, {c.encode(): rng.randrange(5) for c in "abcdefghij"}, threshold)
    got = index.match({c.encode() for c in block})
    want = {f"t{k}": len(t & block) / len(t) for k, t in enumerate(templates) if len(t & block) / len(t) >= threshold - 1e-9}
    assert got == pytest.approx(want)


def test_labels_equal_brute_force(spark):
    """Every run of words of every text, against every template."""
    rng, rows = random.Random(8), []
    pool = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()})
    for k in range(120):
        words = [rng.choice(["word", "x", *pool[:4]]) for _ in range(rng.randrange(700))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(list(license_scan.TEMPLATES.values())).split()
            for _ in range(rng.randrange(4)):
                if rng.random() < 0.5:
                    notice.insert(rng.randrange(len(notice)), "x")
                else:
                    del notice[rng.randrange(len(notice))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((k, rng.choice([" ", "\n", ", "]).join(words)))
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labelled = 0
    for k, text in rows:
        words = license_scan.words_of(text)
        want = set(filter(None, brute_base(text)[4].split(",")))
        for name, template in license_scan.TEMPLATES.items():
            tokens, must, width = set(license_scan.words_of(template)), license_scan.deciding(template), license_scan.SLACK * len(template.split())
            runs = (set(words[a : a + width]) for a in range(max(1, len(words) - width + 1)))
            if max((len(r & tokens) for r in runs if must <= r), default=0) >= math.ceil(0.85 * len(tokens) - 1e-9):
                want.add(name)
                labelled += 1
        assert got[k] == ",".join(sorted(want)), k
    assert labelled > 30
