"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer rewrites a clause's words as marks: insult, threat, target, negation, report; a word may have
several. It is composed with one small transducer for each pattern, which read the marks left to right, rewrite
some (a denied or quoted insult is not one that is aimed) and take weighted arcs. A clause weighs what its heaviest
path weighs: insults their own weights, aim and threat more, denial and report less. Lexicon entries and the arcs'
weights are learned from labelled documents; a document's score comes from its heaviest clause and from the weight
of all its matched clauses, as such and against its length, not from words on their own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ship, working, written

#: Words of the grammar's closed classes.
TARGET = "you your yours yourself he him she her they them their these those we us people everyone"
NEGATION = "not no never isn't aren't wasn't neither nor nicht kein keine pas jamais nunca"
REPORT = "said says say called calls wrote writes quoted quotes reported claimed shouted yelled sagte dit dijo"
THREAT = "kill hurt destroy murder attack beat stab shoot burn"
WILL = "will shall should must gonna going want"

INSULT, THREATEN, AIM, NOT, SAID, WILLING, OTHER = "I", "T", "A", "N", "S", "W", "o"
#: Marks that transducers write in place of others: a denied and a quoted insult, a threat that is willed.
DENIED, QUOTED, MEANT = "n", "q", "t"
_CLOSED = {w: m for words, m in ((TARGET, AIM), (NEGATION, NOT), (REPORT, SAID), (THREAT, THREATEN), (WILL, WILLING)) for w in words.split()}

_TOKEN = re.compile(r"[^\W\d_]+(?:'[a-z]+)?|[.!?;:\n|]")
_ENDS = frozenset(".!?;:\n|")
STEM_LENGTHS = (4, 5, 6)
PATTERNS = ("none", "reported", "negated", "plain", "aimed", "threat")
#: Weights of the patterns' arcs, believed beforehand; a labelled corpus moves them.
ARCS = {"negated": -2.0, "reported": -2.0, "aimed": 1.0, "threat": 2.0}
_GAP = 6


class Transducer:
    """A letter transducer: ``arcs[state][mark] = (next state, mark written, name of the arc's weight or None)``.

    A mark without an arc takes the state's arc ``""`` and is written as it is. All states accept.
    """

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state: int, mark: str) -> tuple[int, str, str | None]:
        arcs = self.arcs[state]
        if mark in arcs:
            return arcs[mark]
        after, _, name = arcs[""]
        return after, mark, name


def after(trigger: str, mark: str, write: str, gap: int, name: str | None) -> Transducer:
    """Writes ``mark`` as ``write``, by the arc ``name``, with at most ``gap`` marks between it and the ``trigger`` before it."""
    arcs: dict = {0: {trigger: (1, trigger, None), "": (0, "", None)}}
    for k in range(1, gap + 2):
        on = k + 1 if k <= gap else 0
        arcs[k] = {mark: (on, write, name), "": (on, "", None)}
        arcs[k][trigger] = (1, trigger, None) if trigger != mark else (1, write, name)
    return Transducer(arcs)


def near(one: str, other: str, gap: int, name: str) -> Transducer:
    """Takes the arc ``name`` once, where ``one`` and ``other`` stand in either order with at most ``gap`` marks between."""
    free, done = 0, 2 * gap + 3
    arcs: dict = {free: {one: (1, one, None), other: (gap + 2, other, None), "": (free, "", None)}, done: {"": (done, "", None)}}
    for first, then, base in ((one, other, 1), (other, one, gap + 2)):
        for k in range(gap + 1):
            arcs[base + k] = {then: (done, then, name), first: (base, first, None), "": (base + k + 1 if k < gap else free, "", None)}
    return Transducer(arcs)


#: Lexicon marks pass through these from left to right: threats that are willed, and aimed; denied and quoted insults,
#: which aren't aimed; insults near a target.
PARTS = (
    after(WILLING, THREATEN, MEANT, _GAP, None),
    after(MEANT, AIM, AIM, _GAP, "threat"),
    after(NOT, INSULT, DENIED, 2, "negated"),
    after(SAID, INSULT, QUOTED, _GAP, "reported"),
    near(INSULT, AIM, _GAP, "aimed"),
)


class Composed:
    """The composition of transducers, its arcs made when first taken, with weights for their names."""

    def __init__(self, parts=PARTS, weights: dict[str, float] | None = None):
        self.parts, self.weights, self.arcs = parts, dict(ARCS if weights is None else weights), {}

    def __getstate__(self):
        return self.__dict__ | {"arcs": {}}

    def step(self, state: tuple, mark: str) -> tuple[tuple, tuple, float]:
        """(next state, mark written at the end and arcs taken, their weight)."""
        found = self.arcs.get((state, mark))
        if found is None:
            after_, names, out = [], [], mark
            for part, at in zip(self.parts, state, strict=True):
                to, out, name = part.step(at, out)
                after_.append(to)
                names += [name] if name else []
            found = self.arcs[state, mark] = (tuple(after_), (out, *names), sum(self.weights[n] for n in names))
        return found

    def best(self, words: list[tuple]) -> tuple[float, float, frozenset]:
        """The heaviest path of a clause whose words have alternatives (mark, weight): its weight, the lexicon's part
        of it, and the marks and arcs on it. Ties go to the earlier alternative."""
        paths = {(0,) * len(self.parts): (0.0, 0.0, frozenset())}
        for alternatives in words:
            onward: dict = {}
            for state, (weight, lexical, taken) in paths.items():
                for mark, own in alternatives:
                    to, names, more = self.step(state, mark)
                    if to not in onward or weight + own + more > onward[to][0]:
                        onward[to] = (weight + own + more, lexical + own, taken.union(names))
            paths = onward
        return max(paths.values(), key=lambda p: p[0])


def pattern_of(taken: frozenset) -> str:
    """The name of a path's pattern: insults that are neither denied nor quoted count before those that are."""
    if "threat" in taken:
        return "threat"
    if INSULT in taken:
        return "aimed" if "aimed" in taken else "plain"
    return "negated" if "negated" in taken else "reported" if "reported" in taken else "none"


def clauses(text: str):
    """The words of each clause of a lower-cased text."""
    words: list[str] = []
    for t in _TOKEN.findall(text.lower()):
        if t in _ENDS:
            if words:
                yield words
            words = []
        else:
            words.append(t)
    if words:
        yield words


_PLAIN = ((OTHER, 0.0),)


class Lexicon:
    """The first transducer: words to marks with weights, by whole word, then by the longest learned stem.

    A learned word of a closed class keeps the mark of its class as an alternative.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.known = words, stems, {}

    def marks(self, word: str) -> tuple:
        """The word's alternatives (mark, weight)."""
        found = self.known.get(word)
        if found is None:
            weight = self.words.get(word) or max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) > n), default=0.0)
            found = ((INSULT, weight),) if weight else ()
            found += ((_CLOSED[word], 0.0),) if word in _CLOSED else ()
            if len(self.known) > 150_000:
                self.known.clear()
            self.known[word] = found = found or _PLAIN
        return found

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "known": {}}


_HOT = (INSULT, THREATEN)


def matches(lexicon: Lexicon, grammar: Composed, text: str) -> tuple[list[tuple[float, float, frozenset]], int]:
    """(the best path of each clause that matches a pattern, words of the text)."""
    tokens = _TOKEN.findall(text.lower())
    marks = lexicon.marks
    marked = [marks(t) for t in tokens]
    hot = [k for k, m in enumerate(marked) if m is not _PLAIN and (m[0][0] in _HOT or m[-1][0] in _HOT)]
    found: list = []
    end = -1
    for k in hot:
        if k < end:
            continue  # in the clause before
        start, end = k, k
        while start and tokens[start - 1] not in _ENDS:
            start -= 1
        while end < len(tokens) and tokens[end] not in _ENDS:
            end += 1
        path = grammar.best(marked[start:end])
        if pattern_of(path[2]) != "none":
            found.append(path)
    return found, len(tokens)


def features(paths: list[tuple[float, frozenset]], words: int, rate: float) -> list[float]:
    """What a document's score hangs on: its heaviest clause, all its clauses' weight and that against its length.

    ``paths`` are (weight, taken) of its clauses; a clause below 0 weighs nothing. ``rate`` is how much toxic
    documents have for a word; one stray clause in a long text weighs little.
    """
    heaviest, total = max((w for w, _ in paths), default=0.0), sum(max(0.0, w) for w, _ in paths)
    if heaviest <= 0:
        return [1.0, *([0.0] * (_FEATURES - 1))]
    told = {pattern_of(t) for _, t in paths}
    return [1.0, 1.0, math.log1p(heaviest), math.log1p(total), math.log((total + 0.5) / (rate * words + 1.0)), float("aimed" in told), float("threat" in told)]


#: Weights believed beforehand, and how firmly: no clause, any clause, the heaviest, all, against length, aimed, threat.
_PRIOR = (-3.0, 2.5, 0.25, 0.25, 0.5, 0.5, 1.0)
_FEATURES = len(_PRIOR)


class Model:
    """Lexicon, grammar with its learned arcs, weight a word in toxic documents, and weights of the features."""

    def __init__(self, lexicon: Lexicon, grammar: Composed, rate: float, weights: list[float]):
        self.lexicon, self.grammar, self.rate, self.weights = lexicon, grammar, rate, weights

    def score(self, text: str | None) -> tuple[float, str, int]:
        """(probability, pattern of the heaviest clause, clauses that match)."""
        paths, words = matches(self.lexicon, self.grammar, text) if text else ([], 0)
        z = sum(w * x for w, x in zip(self.weights, features([(w, t) for w, _, t in paths], words, self.rate), strict=True))
        best = pattern_of(max(paths, key=lambda p: p[0])[2]) if paths else "none"
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), best, len(paths)


def learn_arcs(told: list[tuple[set, int]], firmness: float = 20.0) -> dict[str, float]:
    """Weights of the grammar's arcs from (patterns of a document's clauses, its label).

    An arc weighs by how much likelier its pattern makes a document toxic than a plain insult does, pulled towards
    what is believed beforehand; denial and report never add, aim and threat never take away.
    """
    odds, seen = {}, {}
    for name in ("plain", *ARCS):
        toxic, clean = (sum(name in p and y == k for p, y in told) for k in (1, 0))
        odds[name], seen[name] = math.log((toxic + 1) / (clean + 1)), toxic + clean
    out = {}
    for name, prior in ARCS.items():
        n = min(seen[name], seen["plain"])
        learned = (n * (odds[name] - odds["plain"]) + firmness * prior) / (n + firmness)
        out[name] = min(0.0, learned) if prior < 0 else max(0.0, learned)
    return out


def fit_weights(rows: np.ndarray, y: np.ndarray, firmness: float = 1.0) -> list[float]:
    """Logistic regression pulled towards the prior, by Newton's method."""
    prior = np.array(_PRIOR)
    w = prior.copy()
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - y) + firmness * (w - prior)
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + firmness * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return [float(x) for x in w]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 12_000
) -> Model:
    """Learn lexicon and weights from labelled documents, at most about ``most``, picked by a hash of their id.

    A word counts once for each pair of neighbours it has, so copies of a document teach nothing new. It becomes
    an insult when its contexts in toxic documents are too many to come from chance over the whole vocabulary and
    few are clean; a stem does when that holds for its words without the most frequent one. Words are counted by
    Spark; the driver gets entries, and the matched clauses' weights and patterns of each labelled document.
    """
    ship(docs.sparkSession)
    known = (
        labels.select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where("_id IS NOT NULL AND _y IN (0, 1)")
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    total = known.count()
    edge = int(min(1.0, most / max(1, total)) * (1 << 32))
    picked = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 32)) < edge
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).where(picked)
    rows = written(rows.join(known.where(picked), "_id").where("_text IS NOT NULL").select("_text", "_y"), "labelled")

    def contexts(batches):
        working("toxicity")
        seen: dict[tuple, list[int]] = {}

        def flushed():
            out = pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["word", "around", "clean", "toxic"])
            seen.clear()
            return out

        for batch in batches:
            for text, y in zip(batch["_text"], batch["_y"], strict=True):
                if len(seen) > 100_000:
                    yield flushed()
                for words in clauses(text):
                    for i, w in enumerate(words):
                        around = hash_of(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                        seen.setdefault((w, around), [0, 0])[y] += 1
        if seen:  # Spark takes no frame without rows
            yield flushed()

    # A context counts as toxic only if no clean document has it too.
    pairs = rows.mapInPandas(contexts, "word string, around long, clean long, toxic long").groupBy("word", "around")
    counted = pairs.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).groupBy("word").agg(
        F.sum(F.when(F.col("clean") == 0, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("clean") > 0, 1).otherwise(0)).alias("neg"),
        F.sum("clean").alias("clean"),
        F.sum("toxic").alias("toxic"),
    )
    words = written(counted, "words")
    sums = words.agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "clean", "toxic")], F.count(F.lit(1)).alias("n")).first()
    share = min(0.5, max(1e-3, (sums.pos or 0) / max(1, (sums.pos or 0) + (sums.neg or 0))))
    least = max(3, math.ceil((math.log(max(2, sums.n)) + 2) / -math.log(share)))
    sure = (F.col("pos") - F.col("top") >= least) & (F.col("pos") >= 3 * F.col("neg")) & (F.col("toxic") >= 3 * F.col("clean"))
    columns = ["entry", "pos", "clean", "toxic"]
    whole = words.withColumn("entry", F.col("word")).withColumn("top", F.lit(0)).where(sure).select(*columns)
    stems = (
        words.where(F.length("word") > min(STEM_LENGTHS))
        .select("*", F.explode(F.array(*[F.lit(n) for n in STEM_LENGTHS])).alias("_n"))
        .where(F.length("word") > F.col("_n"))
        .groupBy(F.expr("left(word, _n)").alias("entry"))
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "clean", "toxic")], F.max("pos").alias("top"))
        .where(sure & (2 * F.col("top") <= F.col("pos")))
        .select(*columns)
    )

    def weighed(frame: DataFrame) -> dict[str, tuple[float, int]]:
        found = frame.collect()  # learned from the sample alone, so bounded as it is
        base = math.log((sums.toxic + 1) / (sums.clean + 1)) if found else 0.0
        return {r.entry: (max(0.5, math.log((r.toxic + 0.5) / (r.clean + 0.5)) - base), r.pos) for r in sorted(found, key=lambda r: r.entry)}

    by_stem = weighed(stems)
    # Of nested stems the longest that has nearly all contexts of the shorter one.
    kept = {s: w for s, (w, n) in by_stem.items() if not any(t != s and t.startswith(s) and by_stem[t][1] >= 0.9 * n for t in by_stem)}
    lexicon, grammar = Lexicon({s: w for s, (w, _) in weighed(whole).items()}, kept), Composed()

    def match(batches):
        for batch in batches:
            found = [matches(lexicon, grammar, t) for t in batch["_text"]]
            yield pd.DataFrame(
                {
                    "lexical": [[p[1] for p in paths] for paths, _ in found],
                    "taken": [[" ".join(sorted(p[2])) for p in paths] for paths, _ in found],
                    "words": [n for _, n in found],
                    "y": batch["_y"],
                }
            )

    told = [
        ([(w, frozenset(t.split(" "))) for w, t in zip(r.lexical, r.taken, strict=True)], r.words, r.y)
        for r in rows.mapInPandas(match, "lexical array<double>, taken array<string>, words long, y int").collect()
    ]
    arcs = learn_arcs([({pattern_of(t) for _, t in paths}, y) for paths, _, y in told])
    weighted = [([(w + sum(arcs[n] for n in t if n in arcs), t) for w, t in paths], n, y) for paths, n, y in told]
    rate = max(1e-4, sum(max(0.0, w) for paths, _, y in weighted if y for w, _ in paths) / max(1, sum(n for _, n, y in weighted if y)))
    x = np.array([features(paths, n, rate) for paths, n, _ in weighted], dtype=float).reshape(len(weighted), _FEATURES)
    return Model(lexicon, Composed(weights=arcs), rate, fit_weights(x, np.array([y for *_, y in weighted], dtype=float)))


def hash_of(left: str, right: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{left}\x00{right}") - (1 << 63)


def score(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, pattern, n_clauses``, from the text alone.

    Defined cases: a null or empty text, or one without a matched clause, has the rate of such documents; a very long
    text is scored whole; equally heavy paths of a clause count the same; repeated rows and null ids give a row each; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches):
        working("toxicity")
        for batch in batches:
            found = [shared.value.score(t) for t in batch["_text"]]
            s = [f[0] for f in found]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "score": s,
                    "predicted": [int(x >= threshold) for x in s],
                    "pattern": [f[1] for f in found],
                    "n_clauses": [f[2] for f in found],
                }
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("_text")
    )
    return rows.mapInPandas(read, f"doc_id {kind}, held_out boolean, score double, predicted int, pattern string, n_clauses long")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, whatever their names.

    Rows are judged one by one by their text alone, as ``score`` states; an empty table stays empty.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shared.value.score(t)[0] < threshold).astype(bool)

    return docs.where(clean(F.col(text_col)))
