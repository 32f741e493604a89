"""Language-model scoring with a log-frequency Bloom filter.

Counts of n-grams over all training documents are quantised on a logarithmic scale; an n-gram of level q is in
the filter once for each level 1..q. A scorer probes levels until one is missing, so a count comes from repeated
membership probes, is never too low, and is too high by a level only with the filter's error rate. The filter is
cut into segments by n-gram hash: a reducer counts its n-grams exactly and builds its segment. The filter grows with
the input and holds every n-gram: finished segments go to files in the shared folder, which workers map into memory
and probe there; the driver and the broadcast hold their places and sizes alone.

What a token adds to a score hangs on three levels: those of the word before, of its own and of the pair. So each
token is probed once and kept as a code of the three; the weights are fitted on the codes of all training documents,
and the scores summed from a table over the codes.
"""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import shared_dir, ship, written

END = b""  # no word is empty
BASE = 2.0
BANDS, QUOTIENTS = 40, 258
#: Segments in a file of the stored filter.
SEGMENTS_A_FILE = 16
#: A code is three levels below LEVELS.
LEVELS = 64
CODES = LEVELS**3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW40 = np.uint64((1 << 40) - 1)


def words_of(text: str | None) -> list[bytes]:
    """A text's words, A-Z lowered; words are what stands between ``[\\x20\\x09-\\x0D]``."""
    return (text or "").encode().lower().split()


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bigrams(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each token's pair with the one before; a document's first follows an end token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = _END_HASH
    return mix64(before * _M1 + (h ^ _M2))


class Words(dict):
    """Word to row number of growing arrays: its hash, its exact count (-1: unknown here), its level in the filter.

    When there are too many, all are forgotten before the next look-up.
    """

    def __init__(self, counts: dict[bytes, int] | None = None, table: Filter | None = None, most: int = 600_000):
        super().__init__()
        self.counts, self.table, self.most = counts or {}, table, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[bytes] = []
        self.hashes, self.known, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row numbers of words."""
        if len(self) > self.most:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            import xxhash

            h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.fresh), np.uint64, len(self.fresh))
            self.hashes = np.concatenate([self.hashes, h])
            if self.table is not None:
                self.known = np.concatenate([self.known, np.fromiter((self.counts.get(w, -1) for w in self.fresh), np.int64, len(h))])
                self.seen = np.concatenate([self.seen, self.table.levels(mix64(h + _M1))])
            self.fresh = []
        return at


def _end_hash() -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(END))


_END_HASH = _end_hash()


def chunks(texts, most_tokens: int = 400_000):
    """(first text, words of all, start of each text) for runs of texts; each text ends with END."""
    words, starts, first = [], [], 0
    for i, text in enumerate(texts):
        starts.append(len(words))
        words += words_of(text)
        words.append(END)
        if len(words) >= most_tokens:
            yield first, words, np.array(starts, np.int64)
            words, starts, first = [], [], i + 1
    if starts:
        yield first, words, np.array(starts, np.int64)


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 40-bit keys and counts as bytes: 5 bytes a key, 1 a count, larger counts apart."""
    large = np.flatnonzero(counts >= 255)
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    head = np.array([len(keys), len(large)], "<u8").tobytes()
    return head + raw + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 16).reshape(n, 5)
    counts = np.frombuffer(blob, np.uint8, n, 16 + 5 * n).astype(np.int64)
    at = 16 + 6 * n
    counts[np.frombuffer(blob, "<u8", m, at).astype(np.int64)] = np.frombuffer(blob, "<u8", m, at + 8 * m)
    return keys.reshape(-1).view("<u8").astype(np.uint64), counts


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _seed(level: int) -> np.uint64:
    return np.uint64(level * int(_M2) & 0xFFFFFFFFFFFFFFFF)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1)) / math.log2(BASE) + 1e-9).astype(np.int64)


def positions(keys: np.ndarray, level: int, bits: int, hashes: int):
    """The bit positions of (key, level) within a segment of so many bits."""
    h = mix64(keys * _M1 + _seed(level))
    step = mix64(h ^ _M2) | np.uint64(1)
    for _ in range(hashes):
        yield h % np.uint64(bits)
        h = h + step


def build_segment(keys: np.ndarray, counts: np.ndarray, most_bits: int | None, bits_per_item: int, hashes: int) -> tuple[bytes, int, int]:
    """(bytes, bits, lowest level): a segment for n-grams, with the lowest level at which it stays within ``most_bits``.

    Without ``most_bits`` it holds all n-grams.
    """
    levels, least = level_of(counts), 1
    while True:
        items = int(np.maximum(0, levels - least + 1).sum())
        if most_bits is None or items * bits_per_item <= most_bits:
            break
        least += 1
    bits = max(64, -(-items * bits_per_item // 64) * 64)
    out = np.zeros(bits, np.bool_)
    for level in range(least, int(levels.max(initial=0)) + 1):
        for at in positions(keys[levels >= level], level, bits, hashes):
            out[at.astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes(), bits, least


class Filter:
    """The segments of a log-frequency Bloom filter."""

    def __init__(self, buckets: int, segments: dict[int, tuple[bytes, int, int]], hashes: int):
        self._place(buckets, {b: (len(raw), bits, least) for b, (raw, bits, least) in segments.items()}, hashes, buckets)
        self.data = np.frombuffer(bytes(8) + b"".join(raw for _, (raw, _, _) in sorted(segments.items())), np.uint8)

    def _place(self, buckets: int, sizes: dict[int, tuple[int, int, int]], hashes: int, a_file: int) -> None:
        """Where the segments of so many bytes, bits and lowest levels begin, ``a_file`` of them after one another."""
        self.buckets, self.hashes, self.a_file = buckets, hashes, a_file
        self.bits, self.least, self.start = np.full(buckets, 64, np.uint64), np.ones(buckets, np.int64), np.zeros(buckets, np.uint64)
        at: dict[int, int] = {}
        for b, (n, bits, least) in sorted(sizes.items()):
            here = at.get(b // a_file, 8)  # a bucket without a segment has the 64 empty bits before them
            self.bits[b], self.least[b], self.start[b] = bits, least, here * 8
            at[b // a_file] = here + n

    def file(self, number: int) -> np.ndarray:
        return self.data

    def _there(self, data, keys, bits, start, probe, level):
        """Those of ``probe`` that have all bits of (key, level)."""
        h = mix64(keys[probe] * _M1 + _seed(level))
        step = mix64(h ^ _M2) | np.uint64(1)
        for _ in range(self.hashes):
            at = h % bits[probe] + start[probe]
            ok = ((data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            probe, h, step = probe[ok], h[ok], step[ok]
            h = h + step
        return probe

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram hash: 0 if its lowest level isn't there."""
        bucket = bucket_of(hashes, self.buckets)
        found = np.zeros(len(hashes), np.int64)
        if self.a_file >= self.buckets:
            return self._levels(self.file(0), hashes, bucket)
        order = np.argsort(bucket // self.a_file, kind="stable")
        edges = np.searchsorted(bucket[order] // self.a_file, np.arange(-(-self.buckets // self.a_file) + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]):
            here = order[edges[k] : edges[k + 1]]
            found[here] = self._levels(self.file(int(k)), hashes[here], bucket[here])
        return found

    def _levels(self, data: np.ndarray, hashes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        keys, bits, start, least = hashes & _LOW40, self.bits[bucket], self.start[bucket], self.least[bucket]
        found, alive, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
        while len(alive) and level <= 64:
            # An n-gram whose segment begins at a higher level passes the lower ones unprobed.
            above = alive[least[alive] > level]
            there = self._there(data, keys, bits, start, alive[least[alive] <= level], level)
            found[there] = level
            alive = np.concatenate([there, above])
            level += 1
        return found


class StoredFilter(Filter):
    """A filter whose segments lie in files of the shared folder; a process maps a file when it first probes it."""

    def __init__(self, buckets: int, sizes: dict[int, tuple[int, int, int]], hashes: int, folder: str, names: dict[int, str]):
        self._place(buckets, sizes, hashes, SEGMENTS_A_FILE)
        self.folder, self.names, self.mapped = folder, names, {}

    def __getstate__(self):
        return self.__dict__ | {"mapped": {}}

    def file(self, number: int) -> np.ndarray:
        if number not in self.mapped:
            self.mapped[number] = map_file(self.folder, self.names[number]) if number in self.names else np.zeros(8, np.uint8)
        return self.mapped[number]


def map_file(folder: str, name: str) -> np.ndarray:
    """A file's bytes in mapped memory; what isn't on a file system of this machine is copied to its disk first."""
    from pyarrow import fs

    filesystem, root = fs.FileSystem.from_uri(folder)
    if isinstance(filesystem, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", np.uint8, "r")
    with tempfile.TemporaryFile() as out, filesystem.open_input_stream(f"{root}/{name}") as raw:
        shutil.copyfileobj(raw, out, 8 << 20)
        out.flush()
        return np.memmap(out, np.uint8, "r")


def store(found: DataFrame, buckets: int, hashes: int) -> StoredFilter:
    """The filter of segments ``bucket, data, bits, least``, in files of its own in the shared folder."""
    folder = f"{shared_dir(found.sparkSession).rstrip('/')}/filter-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"

    def put(key, part):
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        name = uuid.uuid4().hex  # of this attempt: a retried task has a file of its own
        part = part.sort_values("bucket")
        with filesystem.open_output_stream(f"{root}/{name}") as out:
            out.write(bytes(8))
            for raw in part["data"]:
                out.write(raw)
        return pd.DataFrame(
            {"bucket": part["bucket"], "n": part["data"].map(len).astype("int64"), "bits": part["bits"], "least": part["least"], "name": name}
        )

    kept = found.select("bucket", "data", "bits", "least", F.floor(F.col("bucket") / SEGMENTS_A_FILE).cast("int").alias("_file"))
    rows = kept.groupBy("_file").applyInPandas(put, "bucket int, n long, bits long, least long, name string").collect()
    names = {r.bucket // SEGMENTS_A_FILE: r.name for r in rows}
    return StoredFilter(buckets, {r.bucket: (r.n, r.bits, r.least) for r in rows}, hashes, folder, names)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def expected(levels: np.ndarray) -> np.ndarray:
    """A count for a level: 0, 1, then the mean of the counts of the level under their usual 1 / c decay."""
    low = BASE ** (levels - 1.0)
    return np.where(levels <= 0, 0.0, np.where(levels == 1, 1.0, low * (BASE - 1) / math.log(BASE)))


class Model:
    """A stored filter, the weights of pairs, and beside them exact counts of frequent words for the base score."""

    def __init__(self, table: Filter, heavy: dict[bytes, int], total: int, distinct: int, weights: np.ndarray):
        self.table, self.heavy, self.total, self.distinct, self.weights = table, heavy, total, distinct, weights

    def words(self) -> Words:
        return Words(self.heavy, self.table)

    def codes(self, words: Words, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The code of each token: levels in the filter of the token before, of its own, of the pair."""
        one = words.seen[at]
        before = np.empty_like(one)
        before[1:] = one[:-1]
        before[starts] = self.table.levels(mix64(np.array([_END_HASH]) + _M1))[0]
        pairs, back = np.unique(bigrams(words.hashes[at], starts), return_inverse=True)
        out = np.zeros(len(at), "<u4")
        for levels in (before, one, self.table.levels(pairs)[back]):
            out = out * np.uint32(LEVELS) + np.minimum(levels, LEVELS - 1).astype("<u4")
        return out

    def log10(self) -> np.ndarray:
        """What a token of each code adds to a score."""
        before, one, pair = counts_of(np.arange(CODES))
        alone = (one + 1) / (self.total + self.distinct + 1)
        weight = self.weights[band_of(before)]
        share = np.minimum(1.0, pair / np.maximum(1.0, before))
        return np.log10(np.where(before > 0, weight * share + (1 - weight) * alone, alone))

    def observed(self, tokens: np.ndarray) -> np.ndarray:
        """How many tokens, given for each code, have each band and quotient of the pair's estimate by the word's.

        The token itself is left out of its counts. The first of QUOTIENTS columns is quotient 0; the others are
        quarters of its binary logarithm.
        """
        used = np.flatnonzero(tokens)
        before, one, pair = counts_of(used)
        share = np.minimum(1.0, np.maximum(0, pair - 1) / np.maximum(1.0, before - 1))
        alone = np.maximum(one, 1.0) / max(1, self.total + self.distinct)
        step = np.where(share > 0, np.clip(np.floor(4 * np.log2(np.maximum(share, 1e-300) / alone)) + QUOTIENTS // 2, 1, QUOTIENTS - 1), 0)
        return np.bincount(band_of(before) * QUOTIENTS + step.astype(np.int64), tokens[used], BANDS * QUOTIENTS)


def counts_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the token before, of the token and of the pair, as codes have them."""
    return expected(codes // LEVELS**2), expected(codes // LEVELS % LEVELS), expected(codes % LEVELS)


def band_of(before: np.ndarray) -> np.ndarray:
    return np.minimum(BANDS - 1, np.log2(before + 1).astype(np.int64))


def fit_weights(observed: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Share of the pair's estimate by band of the first word's count: expectation maximisation over what was observed."""
    observed = observed.reshape(BANDS, QUOTIENTS)
    quotient = 2.0 ** ((np.arange(QUOTIENTS) - QUOTIENTS // 2 + 0.5) / 4)
    quotient[0] = 0.0
    weights, n = np.full((BANDS, 1), 0.3), observed.sum(axis=1)
    for _ in range(rounds):
        from_pair = weights * quotient / (weights * quotient + 1 - weights)
        weights = (((observed * from_pair).sum(axis=1) + 0.5) / (n + 2.0))[:, None]
    return weights[:, 0]


def segments(docs: DataFrame, text_col: str, buckets: int, bits_per_item: int, hashes: int) -> DataFrame:
    """``bucket, data, bits, least, tokens, counts``: the filter over single tokens and pairs of all documents.

    ``tokens`` and ``counts`` are the bucket's share of the vocabulary, each token with its exact count. Texts are cut
    into words once; a task sends each bucket what it has counted of pairs, as hashes, and of words.
    """

    def count(batches):
        words, one = Words(), np.zeros(0, np.int64)
        keys, counts, held = [], [], 0

        def rows():
            own = mix64(words.hashes + _M1)
            k, c = merged(np.concatenate([*keys, own]), np.concatenate([*counts, one]))
            b = bucket_of(k, buckets)
            order = np.argsort(b, kind="stable")
            k, c, b = k[order], c[order], b[order]
            edges = np.searchsorted(b, np.arange(buckets + 1))
            of = bucket_of(own, buckets)
            at = np.argsort(of, kind="stable")
            ends, spelled = np.searchsorted(of[at], np.arange(buckets + 1)), list(words)
            used = [i for i in range(buckets) if edges[i] < edges[i + 1]]
            return pd.DataFrame(
                {
                    "bucket": np.array(used, np.int32),
                    "blob": [pack_counts(k[edges[i] : edges[i + 1]] & _LOW40, c[edges[i] : edges[i + 1]]) for i in used],
                    "tokens": [b" ".join([spelled[j] for j in at[ends[i] : ends[i + 1]]]) for i in used],
                    "counts": [one[at[ends[i] : ends[i + 1]]].astype("<u4").tobytes() for i in used],
                }
            )

        for batch in batches:
            for _, some, starts in chunks(batch["_text"]):
                at = words.rows(some)
                one = np.bincount(at, minlength=len(words)) + np.pad(one, (0, len(words) - len(one)))
                k, c = np.unique(bigrams(words.hashes[at], starts), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 3_000_000 or len(words) > 500_000:
                    yield rows()
                    words.forget()
                    keys, counts, one, held = [], [], np.zeros(0, np.int64), 0
        if len(words):  # Spark takes no frame without rows
            yield rows()

    def build(key, parts):
        keys, counts = (np.concatenate(x) for x in zip(*(unpack_counts(b) for b in parts["blob"]), strict=True))
        data, bits, least = build_segment(*merged(keys, counts), None, bits_per_item, hashes)
        total: dict[bytes, int] = {}
        for tokens, n in zip(parts["tokens"], parts["counts"], strict=True):
            for w, c in zip(tokens.split(b" ") if n else [], np.frombuffer(n, "<u4").tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        row = (key[0], data, bits, least, [w.decode() for w in total], list(total.values()))
        return pd.DataFrame([row], columns=["bucket", "data", "bits", "least", "tokens", "counts"])

    counted = docs.select(F.col(text_col).alias("_text")).mapInPandas(count, "bucket int, blob binary, tokens binary, counts binary")
    return counted.groupBy("bucket").applyInPandas(build, "bucket int, data binary, bits long, least long, tokens array<string>, counts array<long>")


def vocabulary(kept: DataFrame) -> DataFrame:
    """Exact count of every token: ``token, n``; the end token is empty."""
    return kept.select(F.explode(F.arrays_zip("tokens", "counts")).alias("_t")).select(F.col("_t.tokens").alias("token"), F.col("_t.counts").alias("n"))


def counted(
    docs: DataFrame,
    text_col: str = "text",
    bits_per_item: int = 8,
    hashes: int = 5,
    most_heavy: int = 100_000,
    max_buckets: int = 1 << 20,
) -> tuple[Model, DataFrame]:
    """(model, vocabulary) of all of ``docs``, with weights that aren't fitted yet."""
    spark = docs.sparkSession
    ship(spark)
    buckets = 64
    while buckets < min(max_buckets, 2 * docs.rdd.getNumPartitions()):
        buckets *= 2
    kept = written(segments(docs, text_col, buckets, bits_per_item, hashes), "segments")
    vocab = vocabulary(kept)
    bands = vocab.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()
    total, distinct = sum(r.n for r in bands), sum(r.v for r in bands)
    least, have = 1, 0
    for r in sorted(bands, reverse=True):
        if have + r.v > most_heavy:
            least = 1 << (r.b + 1)
            break
        have += r.v
    frequent = vocab.where(((F.col("n") >= least) & (F.length("token") <= 64)) | (F.col("token") == ""))
    heavy = {r.token.encode(): r.n for r in frequent.collect()}
    return Model(store(kept, buckets, hashes), heavy, total, distinct, np.full(BANDS, 0.3)), vocab


def fit(model: Model, coded: DataFrame) -> None:
    """Fit the model's weights on all rows of ``_codes``. The driver gets a number for each band and quotient."""

    def observe(batches):
        tokens = np.zeros(CODES, np.int64)
        for batch in batches:
            tokens += np.bincount(np.frombuffer(b"".join(batch["_codes"]), "<u4"), minlength=CODES)
        seen = numbers.value.observed(tokens)
        at = np.flatnonzero(seen)
        if len(at):  # Spark takes no frame without rows
            yield pd.DataFrame({"at": at.astype(np.int32), "n": seen[at].astype(np.int64)})

    numbers = coded.sparkSession.sparkContext.broadcast(Model(None, {}, model.total, model.distinct, model.weights))
    observed = np.zeros(BANDS * QUOTIENTS)
    for r in coded.select("_codes").mapInPandas(observe, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        observed[r["at"]] = r["n"]
    model.weights = fit_weights(observed)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters) -> tuple[Model, DataFrame]:
    """(model, vocabulary): all of ``docs`` counted into a filter, in the shared folder, that holds every n-gram.

    The filter grows with its input; segments follow the number of input partitions. ``most_heavy`` of the most
    frequent words have their exact counts beside it, for the base score alone. The weights are fitted on all of
    ``docs`` too. ``parameters`` are those of ``counted``.
    """
    model, vocab = counted(docs, text_col, **parameters)
    fit(model, probed(docs, model, None, id_col, text_col))
    return model, vocab


def probed(docs: DataFrame, model: Model, held_out: Column | None, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``_row, doc_id, held_out, n_tokens, _known, _base, _codes, _rest``.

    ``_codes`` has a code of 4 bytes for each token. ``_known`` and ``_base`` are of the model's frequent words, and
    ``_rest`` has the others.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    below = float(model.total + model.distinct + 1)

    def read(batches):
        m = shared.value
        words, number = m.words(), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, held = list(batch["doc_id"]), list(batch["held_out"])
            for first, some, starts in chunks(batch["_text"]):
                at = words.rows(some)
                known = words.known[at]
                codes = m.codes(words, at, starts)
                base = np.where(known >= 0, np.log10((np.maximum(known, 0) + 1) / below), 0.0)
                ends = np.append(starts[1:], len(some))
                rest = known < 0
                n = len(starts)
                yield pd.DataFrame(
                    {
                        "_row": number + np.arange(n),
                        "doc_id": pd.Series(keys[first : first + n], dtype=batch["doc_id"].dtype),
                        "held_out": held[first : first + n],
                        "n_tokens": ends - starts,
                        "_known": np.add.reduceat(known > 0, starts, dtype=np.int64),
                        "_base": np.add.reduceat(base, starts),
                        "_codes": [codes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
                        "_rest": [
                            b" ".join([some[i] for i in a + np.flatnonzero(rest[a:b])]).decode() for a, b in zip(starts, ends, strict=True)
                        ],
                    }
                )
                number += n

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("_text")
    )
    return rows.mapInPandas(read, f"_row long, doc_id {kind}, held_out boolean, n_tokens long, _known long, _base double, _codes binary, _rest string")


def summed(coded: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """The scores of written rows of ``probed``."""
    below, table = float(model.total + model.distinct + 1), coded.sparkSession.sparkContext.broadcast(model.log10())

    @F.pandas_udf("double")
    def score_of(codes: pd.Series) -> pd.Series:
        n = codes.map(len).to_numpy(np.int64) // 4  # the end token's at least
        logs = table.value[np.frombuffer(b"".join(codes), "<u4")]
        return pd.Series(np.add.reduceat(logs, np.cumsum(n) - n) if len(n) else np.zeros(0))

    rare = (
        coded.where("_rest != ''")
        .select("_row", F.explode(F.split("_rest", " ")).alias("token"))
        .join(vocab, "token", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(below))).alias("_more"),
            F.count("n").alias("_more_known"),
        )
    )
    # The codes stay behind as rows go to the join.
    return coded.select("_row", "doc_id", "held_out", "n_tokens", "_known", "_base", score_of("_codes").alias("score")).join(rare, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score(docs: DataFrame, model: Model, vocab: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` and ``n_known`` are exact: words outside the model's frequent ones are looked up in the whole
    vocabulary by a join. ``score`` is the model's log10 probability; all its counts, of words and of pairs, come from
    the filter by membership probes.

    Defined cases: a null or empty text is the end token alone; very long texts are scored whole; repeated rows and null ids give a row each; with
    nothing learned all counts are 0; an empty table gives an empty result; other columns are ignored.
    """
    return summed(written(probed(docs, model, held_out, id_col, text_col), "scored"), model, vocab)


def learn_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """Learn from the rows that aren't ``held_out``, and score all, as ``train`` and ``score`` do, with each token probed once."""
    model, vocab = counted(docs.where(~held_out), text_col, **parameters)
    coded = written(probed(docs, model, held_out, id_col, text_col), "scored")
    fit(model, coded.where("NOT held_out"))
    return summed(coded, model, vocab)
