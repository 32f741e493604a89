"""Best-fit decreasing packing with a segment tree over remaining capacities.

Lengths are integers up to the capacity, so the whole corpus is a histogram of at most ``capacity`` numbers.
Best-fit decreasing runs on it exactly, on the driver: the segment tree's leaf ``r`` holds the ranges of open
bins with ``r`` places left, and finds the tightest one in logarithmic time. A step places a range of equal
lengths into a range of bins at once, so its work hangs on the capacity and not on the number of documents.
Executors then look their pieces' places up by rank within a length.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import remembers, ship, working, written

END_ID = 2
_CACHES: dict[str, Recent] = {}
_LOADED: dict[str, tuple] = {}
#: Bytes that a half of what is remembered may take in a worker; smaller halves encode more words anew.
_MOST_CACHED = 96 << 20
_LONG = 64
_ENTRY = 100  # bytes of a dictionary for each entry, at most
#: The byte-level pre-tokenizer's word pattern, and characters of which all Unicode versions agree.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile("[\t\n\r -~\xa1-\u024f]*")
#: Bytes as the characters that stand for them in the vocabulary: printable ones as they are, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE = _BYTES[0x20]
_ODD = re.compile(r" (?:(?<=\s )|(?<=^ )|(?=\s)|\Z)")  # a space beside white space or an end; its first sign found fast
#: Keys of up to 64 plain characters, no space among them and no white space around.
_SIMPLE = re.compile("[!-~\xa1-\u024f](?:[\t\n\r!-~\xa1-\u024f]{0,62}[!-~\xa1-\u024f])?").fullmatch


class SegmentTree:
    """Counts of open bins by remaining capacity 0..n; finds the smallest one that is at least so large."""

    def __init__(self, n: int):
        self.size = 1
        while self.size < n + 1:
            self.size *= 2
        self.tree = [0] * (2 * self.size)

    def add(self, at: int, count: int) -> None:
        at += self.size
        while at:
            self.tree[at] += count
            at //= 2

    def tightest(self, least: int) -> int:
        """Smallest index >= ``least`` with a count, or -1."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Places for ``counts[length]`` pieces of each length, and the number of bins.

    For each length, (first rank, first bin, offset) in order of rank: the piece of rank ``k`` in the range that
    starts at ``r`` goes to bin ``first bin + k - r`` at ``offset``.
    """
    tree = SegmentTree(capacity)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins, places = 0, {}

    def put(left: int, start: int, n: int) -> None:
        if n and left:
            open_[left].append((start, n))
            tree.add(left, n)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left_over, rank, out = counts[length], 0, []
        while left_over:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                start, n = bins, -(-left_over // each)
                bins += n
            else:
                start, n = open_[room].pop()
                tree.add(room, -n)
                each = room // length
            # A bin stays the tightest one until no further piece of this length fits, so it takes ``each``.
            full = min(n, left_over // each)
            for slot in range(each if full else 0):
                out.append((rank, start, capacity - room + slot * length))
                rank += full
            put(room - each * length, start, full)
            left_over -= full * each
            if full < n:
                part = min(left_over, each - 1) if left_over < each else 0
                for slot in range(part):
                    out.append((rank, start + full, capacity - room + slot * length))
                    rank += 1
                left_over -= part
                put(room - part * length, start + full, 1 if part else 0)
                put(room, start + full + (1 if part else 0), n - full - (1 if part else 0))
        places[length] = out
    return places, bins


class Recent(dict):
    """What ``make`` gives for a key, remembered; beyond ``most`` bytes those used since the last half stay.

    ``make_all`` gives the same for several keys at once, in their order.
    """

    def __init__(self, make, most: int = _MOST_CACHED, make_all=None):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most, {}, 0
        self.make_all = make_all or (lambda keys: map(make, keys))

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.keep(key, found)
        return found

    def keep(self, key: str, found: bytes) -> None:
        if len(key) <= _LONG:
            if self.held >= self.most:
                self.old = {}
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = found
            self.held += sys.getsizeof(key) + sys.getsizeof(found) + _ENTRY

    def of(self, keys: list[str]) -> list[bytes]:
        """For each of the keys, which aren't in the newer half, what is remembered or else made."""
        found = list(map(self.old.get, keys))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(gaps, self.make_all([keys[k] for k in gaps]), strict=True):
            found[k] = ids
        for key, ids in zip(keys, found, strict=True):
            if key not in self:
                self.keep(key, ids)
        return found


def _forget() -> None:
    for cache in _CACHES.values():
        cache.old, cache.held = {}, 0
        cache.clear()


remembers("packing", _forget)


def _loaded(path: str) -> tuple:
    """A file's one tokenizer, and a search for its added tokens (None without any)."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        _LOADED.clear()
        _LOADED[path] = tokenizer, re.compile("|".join(map(re.escape, added))).search if added else None
    return _LOADED[path]


def _as_loaded(tokenizer, text: str) -> list[int]:
    """A text's ids by the tokenizer as its file has it: added tokens get their ids."""
    tokenizer.encode_special_tokens = False
    try:
        return tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        tokenizer.encode_special_tokens = True


def _tokenizer(path: str) -> Recent:
    """Ids of what stands between two cuts, as bytes, for one tokenizer file."""
    if path not in _CACHES:
        import regex

        tokenizer, _ = _loaded(path)
        model, words = tokenizer.model, regex.compile(_WORDS)

        def of_symbols(symbols: str) -> bytes:
            return array("I", [t.id for t in model.tokenize(symbols)]).tobytes()

        def of_word(word: str) -> bytes:
            if word.isascii() and word.isprintable():
                return of_symbols(word.replace(" ", _SPACE))
            return of_symbols(word.encode().decode("latin-1").translate(_BYTES))

        def of_key(key: str) -> bytes:
            """Ids of a space and the key; of the rest alone if the key begins with a space."""
            if key.isascii() and key.isalpha():
                return of_symbols(_SPACE + key)
            part = key[1:] if key[:1] == " " else " " + key
            # Where all versions of Unicode agree on letters and digits, the words are found here and go to the
            # tokenizer's model one by one; other text goes through the tokenizer on the whole.
            if not _PLAIN.fullmatch(part):
                return array("I", tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
            found = words.findall(part)
            if len(found) <= 1:
                return b"".join(map(of_word, found))
            return b"".join([cache[w[1:] if w[:1] == " " and len(w) > 1 and w[1] != " " else " " + w] for w in found])

        def together(keys: list[str]) -> list[bytes]:
            """``of_key`` of simple keys; each begins a word with its space, and no other word begins with one."""
            out: list[bytes] = []
            for word in words.findall(" " + " ".join(keys)):
                begins = word[0] == " "
                key = word[1:] if begins else " " + word
                ids = cache.get(key) or cache.old.get(key)
                if ids is None:
                    ids = of_word(word)
                    cache.keep(key, ids)
                if begins:
                    out.append(ids)
                else:
                    out[-1] += ids
            return out

        def of_keys(keys: list[str]) -> list[bytes]:
            simple = [k for k in keys if not (k.isascii() and k.isalpha()) and _SIMPLE(k)]
            made = dict(zip(simple, together(simple), strict=True)) if simple else {}
            return [made[k] if k in made else of_key(k) for k in keys]

        cache = Recent(of_key, make_all=of_keys)
        _CACHES.clear()
        _CACHES[path] = cache
    return _CACHES[path]


def _cuts(text: str) -> list[str]:
    """What stands between the cuts of a text; the first begins with a space that isn't the text's."""
    words = text.split(" ")
    words[0] = " " + words[0]
    if _ODD.search(text):
        parts = [words[0]]
        for w in words[1:]:
            if not w or w[0].isspace() or parts[-1] == " " or parts[-1][-1].isspace():
                parts[-1] += " " + w
            else:
                parts.append(w)
        words = parts
    return words


def encode(texts: list[str], path: str, added: bool = False) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers.

    With ``added``, a text that holds one of the tokenizer's added tokens goes through it whole, so that they get
    their ids; otherwise their strings are ordinary text.

    The byte-level pre-tokenizer always cuts before a space that stands between two characters that are not
    white space, so what lies between such spaces is encoded once and remembered; what is new in a text is cut into
    words together. A text with other runs of white space around a space is joined back there before it is looked up.
    """
    cache, out = _tokenizer(path), []
    tokenizer, holds = _loaded(path)
    for text in texts:
        if added and holds and holds(text):
            out.append(np.asarray(_as_loaded(tokenizer, text), "<u4").tobytes())
            continue
        words = _cuts(text)
        found = list(map(cache.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(gaps, cache.of([words[k] for k in gaps]), strict=True):
            found[k] = ids
        out.append(b"".join(found))
    return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and END_ID, cut if over ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        working("packing")
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            texts = [t or "" for t in batch["_text"]]
            keys = list(batch["doc_id"])
            for at in range(0, len(texts), 256):
                for key, ids in zip(keys[at : at + 256], encode(texts[at : at + 256], tokenizer_path, added=True), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    out += [
                        (key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
                    ]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInPandas(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    ranks_a_group: int = 20_000,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces of a sequence fill it from 0 without gaps, at most ``capacity`` ids, packed by best-fit decreasing
    over the whole corpus. A document over ``capacity`` is cut into pieces of ``capacity``; the first may be
    shorter.

    Pieces of a length are ranked in groups of about ``ranks_a_group``, so no task ranks all pieces of a common length.

    Defined cases: a null or empty text is a document of END_ID alone; a very long one gives all its pieces; repeated
    rows and null ids are packed one by one, and equal pieces are ranked in any order; an empty table gives an empty
    result; other columns are ignored. The driver gets one number for each group, so one for ``capacity`` lengths and
    for ``ranks_a_group`` pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    groups = np.ones(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        groups[r.length] = -(-r.n // ranks_a_group)
    first = np.concatenate([[0], np.cumsum(groups)])  # of a length's groups among all
    of_length = F.element_at(F.lit(groups.tolist()).cast("array<long>"), (F.col("length") + 1).cast("int"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of_length))
    counts: dict[int, int] = {}
    base = np.zeros(int(first[-1]), dtype=np.int64)
    for length, salt, n in sorted((r[0], r[1], r[2]) for r in salted.groupBy("length", "_salt").count().collect()):
        base[first[length] + salt] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    places, _ = best_fit_decreasing(counts, capacity)
    lookup = spark.sparkContext.broadcast(
        ({length: tuple(np.asarray(c, dtype=np.int64) for c in zip(*at, strict=True)) for length, at in places.items()}, first, base)
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, firsts, bases = lookup.value
        size = length.to_numpy(dtype=np.int64)
        k = bases[firsts[size] + salt.to_numpy(dtype=np.int64)] + rank.to_numpy(dtype=np.int64) - 1
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for one in np.unique(size):
            here = size == one
            ranks, bins, offsets = table[int(one)]
            at = np.searchsorted(ranks, k[here], side="right") - 1
            seq[here] = bins[at] + k[here] - ranks[at]
            off[here] = offsets[at]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    return (
        salted.withColumn("_rank", rank)
        .withColumn("_at", place("length", "_salt", "_rank"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
    )
