"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier over hashed byte n-grams for each bit predicts it; the
language whose codeword has the smallest logistic loss under all bits' margins wins, and a runner-up close to
it flags the text as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ship

UNDETERMINED = "und"
DIMENSIONS = 1 << 14
_LETTER = regex.compile(r"\p{L}")
#: Bytes that aren't part of an ASCII letter or a multi-byte character become spaces.
_TABLE = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def features(text: str) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of a lower-cased text, those of white space alone left out."""
    b = np.frombuffer((b" " + text.lower().encode().translate(_TABLE) + b" "), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    grams = np.concatenate([two[two != 0x2020] | 0x2000000, three[(three >> 8 != 0x2020) & (three & 0xFFFF != 0x2020)]])
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(18), minlength=DIMENSIONS)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """An n-row matrix of +1 and -1: all splits in two for few languages, else the best of seeded random codes."""
    if n <= 5:
        columns = [[1 - 2 * (k >> i & 1) for i in range(n)] for k in range(1, 1 << max(0, n - 1))]
        return np.array(columns or [[1] * n], dtype=np.int8).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), (-1, None)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), size=(n, bits))
        apart = ((bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + bits * np.eye(n, dtype=np.int32)).min()
        best = max(best, (int(apart), code), key=lambda x: x[0])
    return best[1]


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, scale: float):
        self.languages, self.code, self.weights, self.bias, self.scale = languages, code, weights, bias, scale

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, whether a runner-up is close)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        counts = features(text)
        used = np.flatnonzero(counts)
        margins = np.sqrt(counts[used] / max(1, counts.sum())) @ self.weights[used] + self.bias
        loss = np.logaddexp(0, -self.code * margins * self.scale).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        close = len(p) > 1 and bool(p[order[0]] < 2 * p[order[1]])
        return self.languages[order[0]], float(p[order[0]]), close


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 300) -> Model:
    """Logistic regression for each bit of the code; rows are (language, used features, counts)."""
    languages = sorted({lang for lang, _, _ in rows})
    code = codewords(len(languages)) if languages else np.zeros((0, 1), np.int8)
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (_, used, counts) in enumerate(rows):
        x[i, used] = np.sqrt(counts / max(1, counts.sum()))
    which = np.array([languages.index(lang) for lang, _, _ in rows], dtype=np.int64)
    y = code[which].astype(np.float32)
    share = np.bincount(which, minlength=len(languages)) if len(rows) else np.zeros(0)
    weight = (len(rows) / np.maximum(1, share * len(languages)))[which].astype(np.float32)[:, None] if len(rows) else None
    w, bias = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    past, past_b, rate = np.full_like(w, 1e-8), np.full_like(bias, 1e-8), 0.5
    for _ in range(rounds if len(rows) else 0):
        g = -y * weight / (1 + np.exp(y * (x @ w + bias)))
        gw, gb = x.T @ g / len(rows) + 1e-5 * w, g.mean(axis=0)
        past += gw * gw
        past_b += gb * gb
        w -= rate * gw / np.sqrt(past)
        bias -= rate * gb / np.sqrt(past_b)
    return Model(languages, code, w, bias, 1.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 300, most: int = 4000) -> Model:
    """Fit on about ``per_language`` rows of each language, picked by a hash of their id, at most ``most`` in all.

    Only rows with a language and a letter count; beyond ``most``, those with the smallest hashes stay. Texts are
    read whole; the driver gets their feature counts.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    known = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(per_language, max(1, most // max(1, len(known))))
    picked = F.lit(False)
    for lang, n in sorted(known.items()):
        edge = int(min(1.0, 1.2 * share / n) * (1 << 32))
        picked = picked | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 32)) < edge))

    def count(batches):
        for batch in batches:
            out = []
            for lang, h, text in zip(batch["lang"], batch["h"], batch["text"], strict=True):
                if _LETTER.search(text):
                    c = features(text)
                    used = np.flatnonzero(c)
                    out.append((lang, h, used.astype(np.int32), c[used].astype(np.int32)))
            if out:  # Spark takes no frame without rows
                yield pd.DataFrame(out, columns=["lang", "h", "used", "counts"])

    counted = rows.where(picked).mapInPandas(count, "lang string, h long, used array<int>, counts array<int>")
    found = counted.orderBy("h", "lang", "used", "counts").limit(most).collect()
    return fit([(r.lang, np.asarray(r.used, np.int64), np.asarray(r.counts, np.float64)) for r in sorted(found, key=lambda r: (r.lang, r.h))])


def predict(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, ambiguous``, from the whole text alone.

    Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; of languages
    with equal losses the first in code point order is predicted, and the text is ambiguous; very long texts count
    whole; repeated rows and null ids give a row each; a model without languages says ``und`` everywhere; an empty table gives an empty result;
    other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["_text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "ambiguous": [f[2] for f in found],
                }
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("_text")
    )
    return rows.mapInPandas(read, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
