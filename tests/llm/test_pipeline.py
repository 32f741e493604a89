"""The pipeline's stages, one by one and on the whole."""

from collections import Counter

import pytest

import corpus_pipeline
from granary.llm import mixing
from granary.llm.near_dup import shingles, similarity
from tests.llm.messy import empty, messy


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    d = tmp_path_factory.mktemp("sf")
    rows = []
    for k in range(300):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 120))]
        if k % 10 == 0:
            for _ in range(5):
                words[rng.randrange(len(words))] = "knave"
        rows.append((k, " ".join(words) + ".", "en", f"s{k % 4}" if k % 9 else None, 0))
    rows += [(300 + k, rows[k][1], "en", "s1", 0) for k in range(1, 40)]
    rows += [(400 + k, rows[k][1].replace(" ", " and ", 1), "en", "s2", 0) for k in range(1, 40)]
    rows += [(500, None, None, "s0", 0), (501, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    held = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in held.collect()}
        held = spark.createDataFrame(stage(spark, held, folder).collect(), docs.schema)
        after = {r.doc_id: r.text for r in held.collect()}
        assert held.columns == columns and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "toxicity":
            assert gone == {i for i, t in before.items() if t and "knave" in t}
        if name == "exact_dedup":
            assert len({t or "" for t in after.values()}) == len(after) == len({t or "" for t in before.values()})
        if name == "near_dedup":
            bags = {i: shingles(t) for i, t in after.items()}
            assert all(similarity(bags[a], bags[b]) < 0.8 for a in after for b in after if a < b)
            assert all(any(similarity(shingles(before[g]), bags[a]) >= 0.8 for a in after) for g in gone)
    mixed = corpus_pipeline.STAGES[3][1](spark, held, folder)
    assert mixed.columns == columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3


def test_words_of_sources_come_to_their_targets(spark):
    import random

    rng = random.Random(3)
    long = lambda n: "  ".join(f"w{rng.randrange(9000)}" for _ in range(n)) + "\n"
    rows = [(k, long(40_000), "b") for k in range(3)] + [(10 + k, long(90_000), "c") for k in range(2)]
    rows += [(100 + k, long(rng.randint(20, 600)), "a") for k in range(400)] + [(1000 + k, long(rng.randint(20, 600)), "b") for k in range(30)]
    rows += [(2000, long(50), "b"), (2000, long(50), "b"), (None, long(70), None), (2001, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = {(i, s): t for i, t, s in rows}
    mixed, got = mixing.mix(docs).collect(), corpus_pipeline.mix_sources(spark, docs, "").collect()
    words, copies = Counter(), Counter()
    for r in got:
        assert r.n_chars == len(r.text)
        if r.doc_id != 2000:
            whole = texts[r.doc_id, r.source]
            assert whole == r.text or whole.startswith(r.text) and len(whole.split()) > mixing.LONG
        words[r.source] += len(r.text.split())
        copies[r.doc_id] += 1
    assert max(n for i, n in copies.items() if i != 2000) <= 3
    for source in ("a", "b", "c", None):
        mine = [r for r in mixed if r.source == source]
        shards = len({r.shard for r in mine})
        assert abs(words[source] - sum(r.taken for r in mine)) <= mixing.LONG / 2 * shards
        assert abs(words[source] - mine[0].target) <= (mixing.LONG / 2 + 64) * shards


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "mixing"])
def test_awkward_rows_keep_their_columns(spark, folder, name):
    """Columns that are named like ones inside come back as they were, and an empty table stays empty."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], messy(spark)
    got = stage(spark, docs, folder)
    given = {tuple(r) for r in docs.collect()}
    if name == "mixing":  # the texts of cut copies are their own
        cut = ("text", "n_chars")
        assert {tuple(v for c, v in r.asDict().items() if c not in cut) for r in got.collect()} <= {tuple(v for c, v in r.asDict().items() if c not in cut) for r in docs.collect()}
    else:
        assert got.count() > 5 and {tuple(r) for r in got.collect()} <= given
    assert got.columns == docs.columns and stage(spark, empty(spark), folder).count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.offset + r.length <= 1024 for r in out)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
