"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, tune

BUCKETS = 1 << 14  # hashed n-grams of 1 to 3 characters
SAMPLE = 2400  # labelled documents that a model is fitted on, over all languages
SLICE = 1 << 20  # characters counted at once
EPOCHS = 4
UNKNOWN = "und"


_tables: dict = {}  # of this process


def _letters():
    """Which code points are letters."""
    import sys

    import numpy as np

    if "letters" not in _tables:
        _tables["letters"] = np.frombuffer(bytes(chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool)
    return _tables["letters"]


def counts(text: str | None):
    """Counts of hashed character n-grams of a whole text, or None if it has no letter.

    Lower case; each run of other characters is one space; a space stands before and after the text.
    """
    import numpy as np

    if not text:
        return None
    text, letter = text.lower(), _letters()
    total, seen, carry = np.zeros(BUCKETS, dtype=np.int64), False, np.array([32], dtype=np.uint64)
    for at in range(0, len(text), SLICE):
        c = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ok = letter[c]
        seen = seen or bool(ok.any())
        c = np.where(ok, c, 32).astype(np.uint64)
        if at + SLICE >= len(text):
            c = np.append(c, np.uint64(32))
        old = len(carry)
        c = np.concatenate([carry, c])
        fresh = ~((c[1:] == 32) & (c[:-1] == 32))  # keeps the first space of a run
        fresh[: old - 1] = True
        c = np.concatenate([c[:1], c[1:][fresh]])
        keys = [c[old:], (c[old - 1 : -1] << np.uint64(21)) + c[old:] + np.uint64(1 << 60)]
        if len(c) > 2:
            third = (c[:-2] * np.uint64(0xD6E8FEB86659FD93)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
            keys.append(third[max(0, old - 2) :])
        slots = (np.concatenate(keys) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        total += np.bincount(slots.astype(np.int64), minlength=BUCKETS)
        carry = c[-2:]
    return total if seen else None


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    df, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for b in batches:
        for t in b["text"]:
            c = counts(t.as_py())
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], names=["bucket", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        out = []
        for lang, key, t in zip(b["lang"].to_pylist(), b["key"].to_pylist(), b["text"]):
            c = counts(t.as_py())
            if c is not None:
                at = np.flatnonzero(c)
                out.append((lang, key, at.astype("<u4").tobytes(), c[at].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "key", "at", "n"])


@dataclass
class Model:
    languages: list[str]
    idf: "object"
    weights: "object"  # buckets x languages; zero where the penalty removed a feature
    bias: "object"
    temperature: float

    def vector(self, n, at=None):
        import numpy as np

        v = np.log1p(n) * (self.idf if at is None else self.idf[at])
        return v / (np.sqrt(v @ v) or 1.0)

    def probabilities(self, c):
        import numpy as np

        at = np.flatnonzero(c)
        z = (self.vector(c[at], at) @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def ftrl(rows, y, buckets: int, classes: int, alpha=0.5, beta=1.0, l1=0.002, l2=0.0005, epochs=EPOCHS):
    """Weights and bias by follow-the-regularised-leader (McMahan et al. 2013) with elastic-net penalties.

    rows: (places, values) of each document; their order is fixed, so the result is repeatable.
    """
    import numpy as np

    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            at, v = np.append(at, buckets), np.append(v, 1.0)
            w = weights(z[at], n[at])
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature(scores, y) -> float:
    """The softmax temperature with the least log loss, by golden-section search."""
    import numpy as np

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = -4.0, 4.0, 0.6180339887
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, learn: "F.Column", sample: int = SAMPLE) -> Model:
    """Fits on a sample of the rows of docs (doc_id, text, lang) where `learn` holds and lang is not null.

    Document frequencies come from all texts. The sample is at most about `sample` whole documents, an equal
    share of each language and one of each at least, chosen by a hash of doc_id. A fifth of it sets the temperature
    only. Where nothing can be learned, the model knows no language. The driver holds 32 bytes for each bucket and
    language, executors 8.
    """
    import numpy as np

    tune(docs.sparkSession)
    df = dict(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_df, "bucket int, df long").groupBy("bucket").agg(F.sum("df")).collect())
    n = df.pop(-1, 0)
    idf = np.full(BUCKETS, np.log(n + 1.0) + 1)
    for b, x in df.items():
        idf[b] = np.log((n + 1) / (x + 1)) + 1
    able = docs.where(learn & F.col("lang").isNotNull())
    langs = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    each = max(1, sample // max(1, len(langs)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in langs], "lang string, share double")
    key = F.xxhash64(F.lit("langid"), "doc_id")
    picked = able.join(F.broadcast(shares), "lang").where(F.pmod(key, F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", key.alias("key"), F.col("text").cast("string").alias("text"))
    rows = sorted(picked.mapInArrow(_sparse, "lang string, key long, at binary, n binary").collect(), key=lambda r: (r["key"], r["lang"], r["at"], r["n"]))
    if not rows:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    model = Model(sorted({r["lang"] for r in rows}), idf, None, None, 1.0)
    place = {x: i for i, x in enumerate(model.languages)}
    x = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in rows]
    x = [(at, model.vector(c, at)) for at, c in x]
    y = np.array([place[r["lang"]] for r in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.ones(len(rows), dtype=bool)
    seen = [i for i in range(len(rows)) if not held[i] or len(rows) < 50]
    model.weights, model.bias = ftrl([x[i] for i in seen], y[seen], BUCKETS, len(place))
    scores = np.array([v @ model.weights[at] + model.bias for (at, v), h in zip(x, held) if h])
    model.temperature = temperature(scores, y[held])
    return model


def _predict(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    import numpy as np

    m = sent.value
    for b in batches:
        lang, score = [], []
        for t in b["text"]:
            c = counts(t.as_py())
            if c is None or not m.languages:
                lang.append(UNKNOWN)
                score.append(1.0 if c is None else 0.0)
            else:
                p = m.probabilities(c)
                i = int(np.argmax(p))
                lang.append(m.languages[i])
                score.append(float(p[i]))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; `und` with score 1 where a text is null or has no letter, and
    `und` with score 0 for any other text if the model knows no language.

    Ties go to the language that sorts first. Repeated rows stay; other columns are not looked at.
    """
    tune(docs.sparkSession)
    sent = Sent(docs.sparkSession, model)  # BUCKETS x languages numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, sent), "doc_id long, lang_pred string, score double")
