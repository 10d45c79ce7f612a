"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text, with blanks in place of all that isn't
a letter and without those of blanks alone; weights 1 + log(count) times inverse document frequency, rows scaled to length one.
Document frequencies cover all rows that may be learnt from. The classifier is trained by
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded
sample, in which rare languages have at least a quarter of an equal share; a tenth of the sample
is kept back to calibrate a temperature.

Null texts and texts without a letter (str.isalpha) are `und` with score 0. Repeated rows get
equal predictions. If nothing can be learnt from (no rows or no labels), every row is `und`. An
empty table gives no rows. Null ids are predicted too; other columns stay as they are, but for
those that have the names of the two new ones.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import map_batches

BUCKETS = 1 << 15
#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 4000
#: Characters that are hashed at once.
BLOCK = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's n-grams; long texts go in overlapping blocks."""
    letters = _alpha()
    total = np.zeros(BUCKETS, np.int64)
    text = f" {text.lower()} "
    for start in range(0, len(text), BLOCK):
        fresh = min(BLOCK, len(text) - start)
        code = np.frombuffer(text[max(0, start - 2) : start + fresh].encode("utf-32-le", "replace"), np.uint32)
        code = np.where(letters[code], code, 32).astype(np.uint32)
        old = len(code) - fresh
        for n in (1, 2, 3):
            if len(code) < n:
                continue
            h = np.zeros(len(code) - n + 1, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + code[k : len(code) - n + 1 + k]
            blank = code[n - 1 :] == 32
            for k in range(1, n):
                blank &= code[n - 1 - k : len(code) - k] == 32
            h = (h + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(17)
            lo = max(0, old - n + 1)
            h = h[lo:][~blank[lo:]]
            total += np.bincount(h, minlength=BUCKETS)
    at = total.nonzero()[0]
    return at, total[at]


@dataclass
class Model:
    """What prediction needs: names, idf by bucket, weights (bucket, language), bias, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        size = math.sqrt(float(x @ x)) or 1.0
        return (x / size) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
            return UNKNOWN, 0.0
        z = self.logits(*counts(text)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, rounds: int = 2) -> Model:
    """FTRL-proximal over rows (buckets, counts, label); every tenth row calibrates the temperature."""
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    kept, fitted = rows[::10], [r for i, r in enumerate(rows) if i % 10] or rows

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for at, c, label in fitted:
            x = (1 + np.log(c)) * idf[at]
            x = np.append(x / (math.sqrt(float(x @ x)) or 1.0), 1.0)
            at = np.append(at, BUCKETS)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    full = weights(np.arange(BUCKETS + 1))
    model = Model(languages, idf, full[:-1], full[-1], 1.0)
    scored = [(model.logits(a, c), label) for a, c, label in kept]

    def loss(t: float) -> float:
        out = 0.0
        for s, label in scored:
            s = s / t
            out += float(np.log(np.exp(s - s.max()).sum()) + s.max() - s[label])
        return out / max(1, len(scored)) + 1e-3 * abs(math.log(t))

    if scored:
        model.temperature = min((math.exp(v) for v in np.linspace(-4, 2, 61)), key=loss)
    return model


def _frequencies(docs: DataFrame) -> np.ndarray:
    """Number of documents by bucket; the sums have BUCKETS rows, whatever the input."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            seen = np.zeros(BUCKETS, np.int64)
            for text in batch.column(0).to_pylist():
                seen[counts(text or "")[0]] += 1
            at = seen.nonzero()[0]
            return {"bucket": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())}

        return work

    sums = map_batches(docs, make, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def fit(docs: DataFrame, may_learn: Column, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of the rows where may_learn holds and neither text nor label is null.

    Each label gives the rows whose ids hash lowest, in proportion to its number of rows but a
    quarter of an equal share at least; in all about sample_rows, and never more than twice that.
    """
    rows = docs.where(may_learn & F.col(text_column).isNotNull() & F.col(label_column).isNotNull()).select(
        F.col(text_column).alias("text"), F.col(label_column).alias("label"), F.xxhash64(F.col(id_column)).alias("h")
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    languages, total = sorted(sizes), sum(sizes.values())
    if not total:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + total) / (1 + _frequencies(rows.select("text")))) + 1
    least = sample_rows / (4 * len(sizes))
    shares = {name: min(1.0, max(sample_rows / total, least / n)) for name, n in sizes.items()}
    bounds = {name: int(-(1 << 63) + share * ((1 << 64) - 1025)) for name, share in shares.items()}
    low = F.element_at(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)), F.col("label"))
    picked = rows.where(F.col("h") <= low).orderBy("h", "label").limit(2 * sample_rows)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [counts(t) for t in batch.column(0).to_pylist()]
            return {
                "label": batch.column(1),
                "h": batch.column(2),
                "at": pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                "n": pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
            }

        return work

    number = {name: i for i, name in enumerate(languages)}
    got = map_batches(picked, make, "label string, h long, at array<int>, n array<int>").toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    labels, at, n = got.column("label").to_pylist(), got.column("at").combine_chunks(), got.column("n").combine_chunks()
    data = [(at[int(i)].values.to_numpy(), n[int(i)].values.to_numpy(), number[labels[int(i)]]) for i in order]
    return train(data, languages, idf)


def predicted(docs: DataFrame, model: Model, text_column: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows with the predicted language and its score added (or put in place of columns of these names)."""
    kept = [c for c in docs.columns if c not in names]
    df = docs.select(*kept)
    place = kept.index(text_column)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            said = [model.predict(t) for t in batch.column(place).to_pylist()]
            own = {f"`{c}`": batch.column(i) for i, c in enumerate(kept)}
            return own | {f"`{names[0]}`": pa.array([a for a, _ in said], pa.string()), f"`{names[1]}`": pa.array([b for _, b in said], pa.float64())}

        return work

    return map_batches(df, make, f"{ddl}, `{names[0]}` string, `{names[1]}` double")
