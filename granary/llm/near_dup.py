"""Near-duplicate detection: BagMinHash signatures, bands, and verification of multiset overlap.

A document is the multiset of its five-word shingles. Weights are discretised into unit cells under dyadic roots
[0,1), [1,2), [2,4), ...; each (shingle, root) has a Poisson process that is split hierarchically: an interval gives
one point, then the halves beside the point's way down to its cell go on as processes of their own, and the cell
with its next points. Intervals above a document's weight are left out, and a process ends at a horizon by which
nearly all registers have a point; documents with an empty one go on with a farther horizon. A register keeps the
earliest point that falls to it, and two registers agree with a probability equal to the weighted Jaccard similarity.

Two texts are candidates if a band of theirs is equal. They are proven or refuted in three steps, each linear in
what it is given:

1. Stars. A bucket's hub is its text that meets most others over all its buckets; each text is verified against the
   hubs of its buckets. Copies with few edits of their own are hubs, so families join here.
2. Buckets whose texts are in several components still: the pairs between them, where these are few for the bucket's
   size (``CROWDED`` for each text at most).
3. Texts of the other buckets: an exact set-similarity join over their shingles, rarest first. Two texts alike to the
   threshold share a shingle in short prefixes; what many texts share is not in them, unlike their own edits.

Pairs carry numbers only; texts travel to the verification of pairs alone. Links give classes as connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, one_row_each, remembers, ship, working, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Pairs between components, for each text of a bucket, up to which they are made from the bucket.
CROWDED = 8
#: Size classes of the set-similarity join are steps of 1 / STEPS in the logarithm of the size.
STEPS = 50
#: Counters of shingles in the set-similarity join, and how many of them are merged at once. They bound what is
#: broadcast, 1 byte each; shingles that share a counter only count as more frequent.
COUNTERS, CHUNK = 1 << 22, 1 << 14
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
remembers("near_dup", _HASHES.clear)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, in order, and how often each stands in it.

    Words are runs of letters, digits and non-ASCII characters, lower-cased. A text of fewer words than ``width``
    is one shingle of all of them; a text without words is one shingle of itself without outer white space.
    """
    words = (text or "").lower().encode().translate(_TABLE).split()
    if not words:
        words = [b"\x00" + (text or "").strip().encode()]
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix64(out * _P1 + h[k : len(h) - width + 1 + k])
    return np.unique(out, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _stream(element: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The seed of the process of an element's interval [low, low + width)."""
    return mix64(element + (low.astype(np.uint64) * _P2 + width.astype(np.uint64) * _P3))


def _cells(rest: tuple, horizon: np.ndarray, flat: np.ndarray, registers: int) -> tuple:
    """Take the point of each wide interval and split it; the unit cells, and when each goes on.

    Intervals are arrays (element, owner, weight, low, width, time). After its point an interval leaves, for each
    level on the point's way down to a cell, the half beside the way, and that cell.
    """
    cells: list[tuple] = []
    while True:
        element, owner, weight, low, width, time = rest
        unit = width == 1
        cells.append((_stream(element[unit], low[unit], width[unit]), owner[unit], time[unit]))
        element, owner, weight, low, width, time = (x[~unit] for x in rest)
        if not len(element):
            break
        h = mix64(_stream(element, low, width) + _P3)
        time = time - np.log(_uniform(h)) / width
        early = time <= horizon[owner]
        element, owner, weight, low, width, time = (x[early] for x in (element, owner, weight, low, width, time))
        g = mix64(h[early] ^ _P1)
        place = low + ((g & np.uint64(0xFFFFFFFF)) % width.astype(np.uint64)).astype(np.int64)
        counts = place < weight
        np.minimum.at(flat, (owner * registers + ((g >> np.uint64(32)) % np.uint64(registers)).astype(np.int64))[counts], time[counts])
        parts = []
        while len(element):
            half = width // 2
            right = place >= low + half
            beside = np.where(right, low, low + half)
            live = beside < weight
            parts.append(tuple(x[live] for x in (element, owner, weight, beside, half, time)))
            low = np.where(right, low + half, low)
            down = (half > 1) & (low < weight)
            end = (half == 1) & (low < weight)
            parts.append(tuple(x[end] for x in (element, owner, weight, low, half, time)))
            element, owner, weight, low, width, time, place = (x[down] for x in (element, owner, weight, low, half, time, place))
        rest = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (element, owner, weight, low, width, time)
    return tuple(np.concatenate(x) for x in zip(*cells, strict=True))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS, slack: float = 4.0) -> np.ndarray:
    """BagMinHash: a row of ``registers`` earliest points for each multiset."""
    out = np.full((len(bags), registers), np.inf)
    todo = np.arange(len(bags))
    while len(todo):
        element = np.concatenate([bags[d][0] for d in todo])
        weight = np.concatenate([bags[d][1] for d in todo]).astype(np.int64)
        owner = np.repeat(np.arange(len(todo)), [len(bags[d][0]) for d in todo])
        horizon = registers * (np.log(registers) + slack) / np.bincount(owner, weight, len(todo))
        rows = out[todo]
        flat = rows.reshape(-1)
        roots, low, width, live = [], 0, 1, np.arange(len(element))
        while len(live):  # the dyadic roots that begin below an element's weight
            fill = np.ones(len(live), np.int64)
            roots.append((element[live], owner[live], weight[live], low * fill, width * fill, np.zeros(len(live))))
            low, width = low + width, low + width
            live = np.flatnonzero(weight > low)
        state, own, time = _cells(tuple(np.concatenate(x) for x in zip(*roots, strict=True)), horizon, flat, registers)
        until, own = horizon[own], own * registers
        while len(state):
            state = mix64(state + _P3)
            time = time - np.log(_uniform(state))
            keep = time <= until
            state, own, time, until = state[keep], own[keep], time[keep], until[keep]
            register = ((mix64(state ^ _P1) >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(flat, own + register, time)
        out[todo] = rows
        todo = todo[np.isinf(rows).any(axis=1)]
        slack = 2 * slack + 8
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _P2, bits.shape[:2])
    for k in range(bits.shape[2]):
        key = mix64(key * _P1 + bits[:, :, k])
    return key.view(np.int64)


def text_id(text: Column) -> Column:
    """128 bits of a text's SHA-256: it stands for all documents with this text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def signed(docs: DataFrame, id_col: str, text_col: str, at_once: int = 400) -> DataFrame:
    """``doc_id, id, n, bands`` for every row; ``n`` is the number of shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        working("near_dup")
        for batch in batches:
            n, keys, texts = [], [], list(batch["_text"])
            at = 0
            while at < len(texts):
                bags, held = [], 0
                while at < len(texts) and len(bags) < at_once and held < 200_000:
                    bags.append(shingles(texts[at]))
                    held += len(bags[-1][0])
                    at += 1
                n += [int(w.sum()) for _, w in bags]
                keys += list(band_keys(signatures(bags)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "id": batch["id"], "n": n, "bands": keys})

    return docs.select(F.col(id_col).alias("doc_id"), text_id(F.col(text_col)).alias("id"), F.col(text_col).alias("_text")).mapInPandas(
        sign, f"doc_id {kind}, id binary, n long, bands array<long>"
    )


def _similar_size(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold - 1e-9)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts are similar to the threshold."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[int, tuple] = {}

        def of(key, text):
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = shingles(text)
            return known[key]

        return pd.Series([similarity(of(i, s), of(j, t)) >= threshold - 1e-12 for i, s, j, t in zip(a, x, b, y, strict=True)], dtype=bool)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("_x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("_y"))
    # The similarity is a column of its own, so that it is computed once, after both joins.
    return pairs.join(left, "a").join(right, "b").withColumn("_ok", similar("a", "_x", "b", "_y")).where("_ok").select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, comp`` of every node that has an edge ``a, b``: connected components by large and small stars.

    ``comp`` is the least node of the component. Edges are written between rounds; no list of neighbours is ever
    gathered, only its minimum.
    """

    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = scratch.write(e.where("u != v").distinct(), "edges")
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return e, (r[0], r[1])

    e, state = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while state[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        after, now = settled(small)
        scratch.drop(e)
        e = after
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def mixed(rows: DataFrame, *keys: str) -> DataFrame:
    """Of keys whose rows ``node, comp`` are in several components: the one with most rows, ``_rows``, and pairs between components, ``_pairs``."""
    sizes = rows.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("c"))
    told = sizes.groupBy(*keys).agg(
        F.max(F.struct("c", "comp")).alias("_m"), F.count(F.lit(1)).alias("_comps"), F.sum("c").alias("_rows"), F.sum(F.expr("double(c) * c")).alias("_q")
    )
    return told.where("_comps > 1").select(*keys, F.col("_m.comp").alias("_major"), "_rows", ((F.expr("double(_rows) * _rows") - F.col("_q")) / 2).alias("_pairs"))


def across(rows: DataFrame, keys: list[str], told: DataFrame, also, threshold: float) -> DataFrame:
    """Pairs ``a < b`` of similar size and different components that share a key, ``also(x, y)`` holding too.

    Rows of a key's largest component meet only those of its others, so a large component costs nothing by itself.
    """
    tagged = rows.join(told.select(*keys, "_major"), keys)
    x = tagged.where("comp != _major").alias("x")
    y = tagged.alias("y")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    once = (F.col("y.comp") == F.col("y._major")) | (F.col("x.node") < F.col("y.node"))
    near = same & (F.col("x.comp") != F.col("y.comp")) & once & _similar_size(F.col("x.n"), F.col("y.n"), threshold) & also
    return x.join(y, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def elements(text: str) -> np.ndarray:
    """A text's multiset of shingles as a set: the i-th of equal shingles is an element of its own."""
    s, w = shingles(text)
    if int(w.max()) == 1:
        return s
    s, i = np.repeat(s, w), np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return np.where(i == 0, s, mix64(s + i.astype(np.uint64) * _P2))


def counters(texts: DataFrame, of) -> np.ndarray:
    """How many of the hashes ``of(n, text)`` of all texts fall to each of COUNTERS, as a byte that grows with the logarithm.

    1 is one alone. Tasks count what they read, chunks of counters are added up, and the driver gets COUNTERS bytes.
    """

    def count(batches):
        working("near_dup")
        held: list[np.ndarray] = []

        def rows():
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edges = np.searchsorted(slot, np.arange(0, COUNTERS + 1, CHUNK))
            used = np.flatnonzero(edges[1:] > edges[:-1])
            part = lambda a, kind: [a[edges[k] : edges[k + 1]].astype(kind).tobytes() for k in used]
            return pd.DataFrame({"chunk": used.astype(np.int32), "slot": part(slot % CHUNK, "<u2"), "n": part(n, "<u4")})

        for batch in batches:
            for n, text in zip(batch["n"], batch["text"], strict=True):
                held.append(place(of(n, text)))
                if len(held) >= 2000:
                    yield rows()
        if held:  # Spark takes no frame without rows
            yield rows()

    def add(key, parts):
        total = np.zeros(CHUNK, np.float64)
        for slot, n in zip(parts["slot"], parts["n"], strict=True):
            total[np.frombuffer(slot, "<u2")] += np.frombuffer(n, "<u4")
        level = np.where(total > 0, 1 + np.floor(6 * np.log2(np.maximum(total, 1))), 0)
        return pd.DataFrame({"chunk": [key[0]], "level": [np.minimum(255, level).astype(np.uint8).tobytes()]})

    def place(h):
        return (h % np.uint64(COUNTERS)).astype(np.int64)

    parts = texts.mapInPandas(count, "chunk int, slot binary, n binary").groupBy("chunk").applyInPandas(add, "chunk int, level binary")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.uint8)
    for r in parts.collect():  # at most COUNTERS bytes
        out[r.chunk] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def size_class(n: int) -> int:
    return math.floor(math.log(n) * STEPS + 1e-9)


def prefix(ordered: np.ndarray, shared: np.ndarray, partner: float, threshold: float) -> np.ndarray:
    """What must have a common element with a text of at least ``partner`` elements that is alike to the threshold.

    Texts of n and m elements that are alike to t have ceil((n + m) t / (1 + t)) in common at least, so among all but
    so many less one of their elements, in any order that both follow, is a common one. One that isn't ``shared``
    can't be it.
    """
    most = len(ordered) - math.ceil(threshold / (1 + threshold) * (len(ordered) + partner) - 1e-6) + 1
    return ordered[:most][shared[:most]]


def key_of(element: np.ndarray, size: int) -> np.ndarray:
    return mix64(element + np.uint64(size * int(_P3) & 0xFFFFFFFFFFFFFFFF))


def prefix_rows(texts: DataFrame, threshold: float) -> DataFrame:
    """``element, size, smaller, node, n, comp``: what a text's prefixes hold, for partners of each class of sizes.

    The smaller text of a pair stands in its own class of sizes, the larger one in the classes down to t times its
    size, with what smaller texts of the class may have.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast
    levels = broadcast(counters(texts, lambda n, text: elements(text)))
    at = lambda table, h: table[(h % np.uint64(COUNTERS)).astype(np.int64)]

    def in_order(text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's elements, rarest first, and whether another text may have them."""
        e = elements(text)
        level = at(levels.value, e)
        order = np.lexsort((e, level))
        return e[order], level[order] > 1

    smaller_keys = broadcast(counters(texts, lambda n, text: key_of(prefix(*in_order(text), n, threshold), size_class(n))))

    def emit(batches):
        working("near_dup")
        held, rows = [], 0
        columns = ["size", "smaller", "node", "n", "comp"]

        def frame():
            often = [len(x[0]) for x in held]
            told = {c: np.repeat(np.array([x[1 + k] for x in held]), often) for k, c in enumerate(columns)}
            return pd.DataFrame({"element": np.concatenate([x[0] for x in held])} | told)

        for batch in batches:
            for node, n, comp, text in zip(batch["node"], batch["n"], batch["comp"], batch["text"], strict=True):
                e, shared = in_order(text)
                own = size_class(n)
                parts = [(prefix(e, shared, n, threshold), own, True)]
                for size in range(size_class(max(1, math.ceil(threshold * n - 1e-6))), own + 1):
                    smallest = max(math.exp((size - 1e-6) / STEPS), threshold * n - 1e-6, 1.0)
                    part = prefix(e, shared, smallest, threshold)
                    # Its own smaller row is one of those that it meets in its own class.
                    there = at(smaller_keys.value, key_of(part, size))
                    parts.append((part[(there > 1) | (there == 1) & ~np.isin(part, parts[0][0]) if size == own else there > 0], size, False))
                for part, size, smaller in parts:
                    held.append((part.view(np.int64), size, smaller, node, n, comp))
                    rows += len(part)
                if rows > 100_000:
                    yield frame()
                    held.clear()
                    rows = 0
        if rows:
            yield frame()

    return texts.mapInPandas(emit, "element long, size int, smaller boolean, node long, n long, comp long")


def text_nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text: ``node`` (its number), ``id, n, bands``, its smallest document id and its copies."""
    rows = signed(docs, id_col, text_col).groupBy("id", "n", "bands").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("node", F.monotonically_increasing_id())


def linked(nodes: DataFrame, docs: DataFrame, text_col: str, threshold: float, scratch: Scratch) -> DataFrame:
    """``node, comp`` of every node that has a link."""
    members = nodes.select("node", "n", F.explode("bands").alias("k"))
    full = members.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = scratch.write(members.join(full, "k"), "shared")
    meets = shared.groupBy("node").agg(F.sum("c").alias("meets"))
    hubs = shared.join(meets, "node").groupBy("k").agg(F.max(F.struct("meets", "node", "n")).alias("_h"))
    placed = scratch.write(shared.drop("c").join(hubs.select("k", F.col("_h.node").alias("hub"), F.col("_h.n").alias("m")), "k"), "placed")
    scratch.drop(shared)

    wanted = placed.select("node").distinct().join(nodes.select("node", "id"), "node")
    texts = docs.select(text_id(F.col(text_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = scratch.write(texts.groupBy("id").agg(F.first("text").alias("text")).join(wanted, "id").select("node", "text"), "texts")

    stars = placed.where("node != hub").where(_similar_size(F.col("n"), F.col("m"), threshold)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    comps = scratch.write(components(verified(stars, texts, threshold), scratch), "comps")

    rows = placed.join(comps, "node", "left").select("k", "node", "n", "hub", F.coalesce("comp", "node").alias("comp"))
    told = mixed(rows, "k")
    open_ = scratch.write(rows.join(told, "k").withColumn("_crowded", F.col("_pairs") > CROWDED * F.col("_rows")), "open")
    scratch.drop(placed)
    few, several = open_.where("NOT _crowded"), ["k", "node", "n", "comp", "hub"]
    # All pairs with a bucket's hub are settled.
    settled = (F.col("x.node") != F.col("x.hub")) & (F.col("y.node") != F.col("x.hub"))
    pairs = across(few.select(*several), ["k"], few.select("k", "_major").distinct(), settled, threshold)
    crowd = scratch.write(open_.where("_crowded").select("node", "n", "comp").distinct().join(texts, "node"), "crowd")
    if not crowd.isEmpty():
        found = scratch.write(prefix_rows(crowd, threshold), "prefixes")
        roles = ((F.col("x.smaller") & ~F.col("y.smaller") & (F.col("x.n") <= F.col("y.n"))) | (F.col("y.smaller") & ~F.col("x.smaller") & (F.col("y.n") <= F.col("x.n"))))
        pairs = pairs.union(across(found, ["element", "size"], mixed(found, "element", "size"), roles, threshold)).distinct()
    links = scratch.write(verified(pairs, texts, threshold), "links")
    if links.isEmpty():
        return comps
    of = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moved = components(between, scratch)
    alone = moved.join(comps.select("node").distinct(), "node", "left_anti")
    there = comps.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    return there.union(alone)


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``doc_id, id, _class, class_id, class_size`` of every row; ``id`` stands for its text, ``_class`` for its class."""
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        nodes = scratch.write(text_nodes(docs, id_col, text_col), "nodes")
        comps = linked(nodes, docs, text_col, threshold, scratch)
        placed = nodes.join(comps, "node", "left").select("id", "first_id", "copies", F.coalesce("comp", "node").alias("_class"))
        sizes = placed.groupBy("_class").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
        told = written(placed.select("id", "_class").join(sizes, "_class"), "classes")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(F.col(text_col)).alias("id"))
    return rows.join(told, "id").select("doc_id", "id", "_class", "class_id", "class_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept, text_id``.

    Documents are linked when the weighted Jaccard similarity of their five-word shingles is at least
    ``threshold``; classes are connected components of links, and equal texts are always in one class.
    ``class_id`` is the class's smallest document id, and that document is kept.

    Defined cases: a null text is an empty one; texts without words are alike only if equal but for outer white
    space; very long texts count whole; a null id is never smaller than another (a class of null ids has a null
    ``class_id``, and those rows are kept); rows that repeat an id share its verdict; an empty table gives an empty
    result; other columns are ignored.
    """
    return classes(docs, id_col, text_col, threshold).select(
        "doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.lower(F.hex("id")).alias("text_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each class, with all their columns.

    Of a class's rows with the kept id, which may be null, those with the smallest text id count; if they repeat,
    the largest by all columns in order stays. Null, empty and very long texts, null ids and empty tables are as in
    ``near_duplicates``; other columns may have any name and come back unchanged.
    """
    kept = classes(docs, id_col, text_col, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = kept.groupBy("_class", "doc_id", "id").agg(F.count(F.lit(1)).alias("_copies"))
    kept = kept.groupBy("_class").agg(F.min(F.struct("id", "doc_id", "_copies")).alias("_m"))
    kept = kept.select(F.col("_m.doc_id").alias("_kept_id"), F.col("_m.id").alias("_kept_text"), F.col("_m._copies").alias("_copies"))
    return one_row_each(docs, text_id(F.col(text_col)), id_col, text_col, kept)
