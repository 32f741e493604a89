import hashlib
import re
from collections import Counter
from urllib.parse import urlsplit

import pytest

from granary.llm import near_dup
from granary.llm.common import Scratch
from granary.llm.exact_dedup import drop_duplicates, duplicate_groups
from granary.llm.near_dup import components, drop_near_duplicates, near_duplicates, shingles, signatures, similarity
from granary.llm.url_filter import RULES, rules_frame, url_verdicts
from tests.llm.messy import empty, messy, texts


def _null_last(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_groups_equal_brute_force(spark, digest_chars):
    got = sorted((tuple(r) for r in duplicate_groups(messy(spark), salts=3, digest_chars=digest_chars).collect()), key=str)
    groups = {}
    for i, t, *_ in texts():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(norm, []).append((i, len(t or "")))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], *_null_last(m[0])))[0]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    assert got == sorted(want, key=str)


def test_exact_empty_and_drop(spark):
    assert duplicate_groups(empty(spark)).count() == 0 and drop_duplicates(empty(spark)).count() == 0
    df = messy(spark)
    kept = drop_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=_null_last)
    assert ids == [1, 4, 7, 8, 9, 10, 11, 13, 14, None]


def test_one_row_of_each_group_stays(spark):
    far = " ".join(f"u{k}" for k in range(60))
    near = " ".join(f"u{k}" if k != 59 else "v" for k in range(60))
    rows = [(1, "same text"), (1, "same text"), (1, "same  text"), (2, "same text"), (3, "alone here")]
    rows += [(None, "no id"), (None, "no id"), (None, "no  id"), (4, far), (4, far), (5, near), (6, None), (6, None)]
    rows += [(7, far.replace("u", "x")), (7, near.replace("u", "x"))]
    df = spark.createDataFrame([(i, t, k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    exact = drop_duplicates(df)
    assert exact.columns == df.columns
    want = [(1, "same  text"), (3, "alone here"), (None, "no  id"), (4, far), (5, near), (6, None), rows[-1], rows[-2]]
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter(want)
    got = Counter(r.doc_id for r in drop_near_duplicates(df.where("text NOT LIKE '%  %' OR text IS NULL")).collect())
    assert got == Counter({1: 1, 3: 1, None: 1, 4: 1, 6: 1, 7: 1})


def test_near_duplicates_equal_brute_force(spark):
    got = {(r.doc_id, r.text_id): r for r in near_duplicates(messy(spark)).collect()}
    rows = [(i, t or "") for i, t, *_ in texts()]
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similarity(bags[a], bags[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    for a, (i, t) in enumerate(rows):
        own = [rows[b][0] for b in range(len(rows)) if find(b) == find(a)]
        known = [x for x in own if x is not None]
        r = got[i, hashlib.sha256(t.encode()).hexdigest()[:32]]
        assert r.class_id == (min(known) if known else None) and r.class_size == len(own) and r.kept == (i == r.class_id), i


def test_near_duplicates_rounds_and_components(spark):
    """A chain of texts, each similar to its neighbours only, is one class; many texts that share a passage aren't."""
    import random

    rng = random.Random(3)
    words = [f"a{k}" for k in range(300)]
    chain = []
    for k in range(12):
        chain.append((k, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
    passage = " ".join(f"p{k}" for k in range(60))
    shared = [(100 + k, f"{passage} {' '.join(f's{rng.randrange(10**6)}' for _ in range(60))}") for k in range(120)]
    df = spark.createDataFrame(chain + shared, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    bags = {i: shingles(t) for i, t in chain}
    linked = [similarity(bags[k], bags[k + 1]) >= 0.8 for k in range(11)]
    want, now = [], 0
    for k in range(12):
        now = now if k and linked[k - 1] else k
        want.append(now)
    assert any(linked) and [got[k] for k in range(12)] == want
    assert all(got[i] == i for i, _ in shared)


def test_near_empty_and_drop(spark):
    assert near_duplicates(empty(spark)).count() == 0
    df = messy(spark)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {8, 11, 13, 14} <= ids and not {2, 3, 4, 12} & ids


def test_signatures_are_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    told, true = [], []
    for _ in range(25):
        k = np.unique(rng.integers(0, 2**62, 200).astype(np.uint64))
        w = rng.integers(1, 9, len(k))
        v = np.maximum(0, w + rng.integers(-2, 3, len(k)))
        s = signatures([(k, w), (k[v > 0], v[v > 0])])
        told.append((s[0] == s[1]).mean())
        true.append(similarity((k, w), (k[v > 0], v[v > 0])))
    assert abs(np.mean(told) - np.mean(true)) < 0.03 and np.abs(np.array(told) - true).max() < 0.2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (24, 25), (3, 4), (4, 1)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.node: r.comp for r in components(edges, scratch).collect()}
        assert components(edges.limit(0), scratch).count() == 0
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 24: 24, 25: 24} and not scratch.paths


def _classes_by_force(rows):
    bags = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, links = sorted(bags), 0
    for a in ids:
        for b in ids:
            if a < b and similarity(bags[a], bags[b]) >= 0.8:
                links += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}, links


@pytest.fixture(scope="module")
def families():
    """Families of texts around 0.8 alike, whose members are linked by some others only, repeated words included."""
    import random

    rng, rows = random.Random(11), []
    for f, (size, edits) in enumerate([(150, 9), (60, 6), (40, 4), (25, 12)]):
        base = [f"f{f}w{rng.randrange(90)}" for _ in range(150)]
        if f == 1:  # a part of the first family's words, in many of this one's buckets
            base[:70] = rows[0][1].split()[:70]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            del words[150 - rng.randrange(8) :]
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join(["again and again"] * (k + 20))) for k in range(12)]
    return rows


@pytest.mark.parametrize("crowded, counters, chunk", [(8, 1 << 22, 1 << 14), (-1, 1 << 22, 1 << 14), (-1, 64, 16), (10**9, 64, 16)])
def test_families_equal_brute_force(spark, families, monkeypatch, crowded, counters, chunk):
    """Whichever way a bucket's pairs are made: from it, or by the set-similarity join, with few counters too."""
    monkeypatch.setattr(near_dup, "CROWDED", crowded)
    monkeypatch.setattr(near_dup, "COUNTERS", counters)
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    want, links = _classes_by_force(families)
    assert links > 500 and len(set(want.values())) > 40
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(families, "doc_id long, text string")).collect()}
    assert got == want


def test_planted_links_are_found(spark):
    """Recall: each of thousands of texts that have one partner, 0.8 to 0.9 alike, is in a class with it."""
    import random

    rng, rows, wanted = random.Random(17), [], 0
    for k in range(2500):
        words = [f"w{rng.randrange(10**7)}" for _ in range(60)]
        rows.append((2 * k, " ".join(words)))
        at = rng.randrange(5, 55)
        words[at] = "x"
        rows.append((2 * k + 1, " ".join(words)))
        wanted += similarity(shingles(rows[-2][1]), shingles(rows[-1][1])) >= 0.8
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("class_size = 2 AND class_id % 2 = 0 AND NOT kept").count()
    assert wanted == 2500 and got >= 0.999 * wanted


# -- URLs ------------------------------------------------------------------------------------------------------------
URLS = [
    "http://WWW.Example.COM/en/1?x#y", "https://a.example.com/en/", "https://example.com/en", "http://example.com", "http://foo.net/es/x", "http://foo.net/de/", "net/es/",
    "http://notexample.com/en/", "http:///en/", "", None, "https://x.y.z.net?fr/", "http://net/fr/a/b", "ftp://a.b.org/en/#", "http://example.com:80/en/", "x://a://b.com/c", "http://ÉX.net/es/", "http://..net/es/",
]


def brute(url, rules=RULES, default="allow"):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [(h + p, len(h), v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (len(f[0]), f[1], f[2] == "block"), default=None)
    return host, path, best and best[0], best[2] if best else default


@pytest.mark.parametrize("prefix", [8, 1])
def test_urls_equal_brute_force(spark, prefix):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_verdicts(pages, rules_frame(spark), prefix_chars=prefix).collect()}
    assert got == {k: brute(u) for k, u in enumerate(URLS * 2)}


def test_url_rules_of_other_shapes(spark):
    rules = [("com", "/a", "block"), ("com", "/a", "allow"), ("x.com", "", "block"), (None, "/", "block"), ("b.x.com", "/ab", "allow")]
    urls = ["http://q.com/abc", "http://x.com/abc", "http://b.x.com/abc", "http://x.com", "http://c.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(r)[3:] for r in url_verdicts(pages, rules_frame(spark, rules)).orderBy("page_id").collect()]
    assert got == [brute(u, [r for r in rules if r[0]])[2:] for u in urls]
    assert [r.verdict for r in url_verdicts(pages, rules_frame(spark, rules).limit(0), default="block").collect()] == ["block"] * 5
    assert url_verdicts(pages.limit(0), rules_frame(spark)).count() == 0
    assert urlsplit(urls[0]).hostname == "q.com"


def test_large_groups_get_their_verdict_in_parts(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(900)] + [(None, "the same text"), (None, None)]
    out = duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out.collect() if r.doc_id is not None}
    assert out.count() == 902 and got == {i: (1, 601, i == 1) if i % 3 else (i, 1, True) for i in range(900)}
    urls = [(i, "https://www.example.com/en/a" if i % 3 else (None if i % 2 else f"https://h{i}.net/es/")) for i in range(900)]
    judged = url_verdicts(spark.createDataFrame(urls, "page_id long, url string"), rules_frame(spark)).collect()
    wanted = {i: ("www.example.com/en/", "allow") if i % 3 else ((None, "allow") if i % 2 else ("net/es/", "block")) for i in range(900)}
    assert len(judged) == 900 and {r.page_id: (r.rule, r.verdict) for r in judged} == wanted
