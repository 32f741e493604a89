import hashlib
import sys
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import media, packing
from granary.llm.media import UNIT, from_png, media_columns, payload_of, png_header, read_headers, store, to_png
from granary.llm.mixing import block_choice, mix, sainte_lague, targets
from granary.llm.packing import SegmentTree, best_fit_decreasing, encode, pack, pieces
from granary.llm.queries import tokenizer_path
from tests.llm.messy import empty, messy, texts

ODD = ["", " ", "  a  b ", "a\n b", "a \nb", "\n\nx", "x\t y  z", "日本語 テスト 12½ ²³ á", "it's we'll <|endoftext|> x", "\x1c a \x1fb", "trail ", " lead", "é É ñ 1,234.5", "  wide 　 space", "🙂 emoji🙂🙂 x", "a\u00a0 b"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids(tokenizer, text):
    return array("I", tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_encode_equals_the_tokenizer(tokenizer):
    some = ODD + [t or "" for _, t, *_ in texts()]
    assert encode(some, tokenizer_path()) == [ids(tokenizer, t).tobytes() for t in some]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t.,'sabcé½²ß日🙂\u00a0\x1c!1"), max_size=40))
def test_encode_any_text(text):
    from tokenizers import Tokenizer

    global _T
    try:
        _T
    except NameError:
        _T = Tokenizer.from_file(tokenizer_path())
        _T.encode_special_tokens = True
    assert encode([text], tokenizer_path())[0] == ids(_T, text).tobytes()


def test_what_encoding_remembers_is_bounded_in_bytes():
    cache = packing.Recent(lambda key: bytes(4 * len(key)), 1 << 20)
    for k in range(100_000):
        assert len(cache[f"{k:060d}"]) == 240
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in [*cache.items(), *cache.old.items()])
    assert 1 << 19 < held < 2 << 20


def test_new_words_of_a_text_are_cut_together(tokenizer, monkeypatch):
    import regex

    compiled, calls = regex.compile(packing._WORDS), []

    class Counting:
        @staticmethod
        def findall(text):
            calls.append(text)
            return compiled.findall(text)

    monkeypatch.setattr(packing, "_CACHES", {})
    monkeypatch.setattr(regex, "compile", lambda *_: Counting)
    text = "it's, " + " ".join(f"x{k}y, é{k}.\nwe'll ,é{k}!" for k in range(200)) + " a\u00a0b \n c, " + "w," * 50
    for _ in range(2):
        assert encode([text], tokenizer_path()) == [ids(tokenizer, text).tobytes()]
    assert len(calls) < 10


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time over a list of bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80))
def test_histogram_packing_equals_one_by_one(lengths):
    places, bins = best_fit_decreasing(dict(Counter(lengths)), 16)
    fill, seen = defaultdict(list), Counter()
    for n, ranges in places.items():
        ranges = [*ranges, (Counter(lengths)[n], None, None)]
        for (rank, start, offset), (after, _, _) in zip(ranges, ranges[1:], strict=False):
            for k in range(rank, after):
                fill[start + k - rank].append((offset, n))
                seen[n] += 1
    assert seen == Counter(lengths) and set(fill) == set(range(bins))
    for members in fill.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 16
    assert Counter(16 - sum(n for _, n in m) for m in fill.values()) == Counter(one_by_one(lengths, 16))


def test_segment_tree():
    t = SegmentTree(10)
    for k in (3, 7, 10):
        t.add(k, 1)
    assert [t.tightest(k) for k in (0, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    t.add(10, -1)
    assert t.tightest(8) == -1


def test_pieces_equal_the_tokenizer_as_loaded(spark):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer_path())
    some = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "a " * 700 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces(docs, tokenizer_path()).collect()}
    for k, text in enumerate(some):
        want = array("I", loaded.encode(text, add_special_tokens=False).ids) + array("I", [2])
        assert (got[k].length, got[k].ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
    assert loaded.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_pack(spark, tokenizer):
    rows = pack(messy(spark), tokenizer_path(), capacity=256, ranks_a_group=5).collect()
    by_text = defaultdict(list)
    want = Counter()
    for i, t, *_ in texts():
        full = ids(tokenizer, t) + array("I", [2])
        first = len(full) % 256 or 256
        bounds = [0, *range(first, len(full) + 1, 256)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(full[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:
        by_text[r.sequence_id].append((r.offset, r.length))
    for members in by_text.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by_text) == len(one_by_one([r.length for r in rows], 256))
    assert pack(empty(spark), tokenizer_path()).count() == 0


# -- mixing -----------------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), min_size=1, max_size=6), st.integers(0, 40))
def test_sainte_lague_equals_one_by_one(entries, seats):
    weights, caps = [float(w) for w, _ in entries], [c for _, c in entries]
    got = sainte_lague(weights, seats, caps)
    want = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and want[i] < caps[i]]
        if not open_:
            break
        want[max(open_, key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
    assert sum(got) == sum(want)
    assert sorted(w / (2 * k + 1) for w, k in zip(weights, got, strict=True) if k) == pytest.approx(sorted(w / (2 * k + 1) for w, k in zip(weights, want, strict=True) if k)) or got == want


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert targets([10, 10, 500], [5, 2, 1]) == pytest.approx([30, 30, 460])
    assert targets([0, 0], [5, 2]) == [0, 0] and targets([], []) == []


def test_mix(spark):
    rows = mix(messy(spark), block_words=4, shard_words=200).collect()
    assert len(rows) == len(texts())
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode().split())) for i, t, *_ in texts())
    sizes = Counter()
    for _, t, _, s, *_ in texts():
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(40, 0.02 * goal[s]), (s, taken[s], goal[s])
    again = mix(messy(spark).repartition(3), block_words=4, shard_words=200).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in rows)
    assert mix(empty(spark)).count() == 0


def test_blocks_equal_brute_force(spark):
    """Which words are taken, block by block, with several shards in several groups."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "a", "a", "b", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix(docs, block_words=4, shard_words=400, together=3).collect()}
    hashes = docs.select("doc_id", F.xxhash64(F.lit(7), F.col("doc_id").cast("string")).alias("o"), F.xxhash64(F.lit(8), F.col("doc_id").cast("string")).alias("s")).collect()
    order, dealt = {r.doc_id: r.o for r in hashes}, {r.doc_id: r.s for r in hashes}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in names}
    goal = targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
    of = {i: dealt[i] % -(-sizes[s] // 400) for i, _, s in rows}
    shards = {}
    for i, t, s in rows:
        shards.setdefault((names.index(s), of[i]), []).append((order[i], i, len(t.split())))
    words = {k: sum(n for *_, n in v) for k, v in shards.items()}
    blocks = {k: -(-n // 4) for k, n in words.items()}
    groups = {k: k[1] % -(--(-sizes[names[k[0]]] // 400) // 3) for k in shards}
    caps = [3 * sum(b for (i, _), b in blocks.items() if i == x) for x in range(len(names))]
    for x, seats in enumerate(sainte_lague(goal, min(round(sum(sizes.values()) / 4), sum(caps)), caps)):
        seats = caps[x] if abs(goal[x] - 3 * sizes[names[x]]) < 1e-6 else seats
        some = sorted({g for (i, _), g in groups.items() if i == x})
        inside = [sorted(k for k, g in groups.items() if k[0] == x and g == one) for one in some]
        split = sainte_lague([float(sum(words[k] for k in m)) for m in inside], seats, [3 * sum(blocks[k] for k in m) for m in inside])
        for members, q in zip(inside, split, strict=True):
            for k, n in zip(members, sainte_lague([float(words[m]) for m in members], q, [3 * blocks[m] for m in members]), strict=True):
                passes, rest, step, shift = block_choice(blocks[k], n, 7, *k)
                chosen, at = {b for b in range(blocks[k]) if (step * b + shift) % blocks[k] < rest}, 0
                assert len(chosen) == rest
                for _, i, size in sorted(shards[k]):
                    assert got[i].taken == passes * size + sum((at + w) // 4 in chosen for w in range(size)), i
                    at += size
    assert len(set(groups.values())) > 1 and sum(r.taken for r in got.values()) > 0


# -- media ------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_png_round_trip(raw):
    payload = payload_of(raw.decode("latin-1"))
    data = to_png(payload)
    width, height, depth = png_header(data[:33])
    assert from_png(data) == payload and width * height == len(payload) and depth == 8 and len(payload) % UNIT == 0 and len(payload) >= UNIT


def test_media(spark, tmp_path):
    rows = media_columns(messy(spark), str(tmp_path / "store")).collect()
    assert len(rows) == len(texts())
    want = Counter()
    for i, t, *_ in texts():
        p = payload_of(t)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    for r in rows:
        p = next(payload_of(t) for _, t, *_ in texts() if hashlib.sha256(payload_of(t)).hexdigest() == r.payload_sha256)
        assert r.media_sha256 == hashlib.sha256(to_png(p)).hexdigest() and r.media_bytes == len(to_png(p)) and r.feature
    assert media_columns(empty(spark), str(tmp_path / "none")).count() == 0


def test_shards_are_tar_files_and_headers_are_read_alone(spark, tmp_path):
    import tarfile

    folder = f"file://{tmp_path}/store"
    manifest = store(messy(spark).coalesce(1), folder, shard_bytes=4000).persist()
    rows = manifest.collect()
    shards = {r.shard for r in rows}
    assert len(shards) > 1
    found = {}
    for s in shards:
        with tarfile.open(tmp_path / "store" / s) as t:
            for m in t.getmembers():
                found[s, m.offset_data] = (m.name, t.extractfile(m).read())
    for r in rows:
        name, data = found[r.shard, r.offset]
        assert name == f"{r.payload_sha256}.png" and len(data) == r.length and hashlib.sha256(from_png(data)).hexdigest() == r.payload_sha256
    heads = read_headers(manifest.select("shard", "offset"), folder).collect()
    assert all(h.width * h.height == len(from_png(found[h.shard, h.offset][1])) for h in heads)


def test_media_is_read_where_it_lies(spark, tmp_path, monkeypatch):
    """No shuffle, no sort, one Python worker a task; copies within and beyond what is remembered, null ids."""
    monkeypatch.setattr(media, "REMEMBERED", 3)
    rows = [(None if k % 50 == 0 else k, f"text {k % 7 if k % 2 else 0}") for k in range(400)]
    got = media_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "store"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and not any(x in plan for x in ("Exchange", "Sort", "Join", "Aggregate"))
    found = got.collect()
    assert Counter((r.doc_id, r.payload_sha256) for r in found) == Counter((i, hashlib.sha256(payload_of(t)).hexdigest()) for i, t in rows)
    assert len({tuple(r)[1:] for r in found}) == len({t for _, t in rows})
