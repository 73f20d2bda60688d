"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

All words of all sampled examples are indexed, so any text with a known word has neighbours, votes and evidence.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, tune, written

SAMPLE = 2000  # labelled documents that the index holds
NEAREST = 15
BLOCK = 256  # examples of a block
FIRST = 2  # blocks scored before any is passed over
FREQUENT = 1024  # terms whose postings lie side by side
BATCH = 256  # texts scored together
SURE = 4.0  # deviations from chance beyond which a term's association with the label adds to its weight
CACHE = 400_000  # tokens whose terms a worker keeps
SHORT, LONG = 4, 6  # letters of the two beginnings that stand for a word
WORD = regex.compile(r"\p{L}+").findall


def terms_of(word: str) -> tuple[str, ...]:
    """The beginnings of SHORT and LONG letters, which inflected forms share; a short word is one term."""
    return (word[:LONG],) if len(word) <= SHORT else (word[:SHORT], word[:LONG])


class Terms(dict):
    """Terms of what stands between white space, found at first look-up."""

    def __missing__(self, token: str) -> tuple:
        found = tuple(t for w in ([token] if token.isalpha() else WORD(token)) for t in terms_of(w))
        if len(token) <= 64 and len(self) < CACHE:
            self[token] = found
        return found

    def of(self, text: str | None) -> set:
        return {t for token in set((text or "").lower().split()) for t in self[token]}


class Numbers(dict):
    """Codes of what stands between white space; a code gives the numbers of the terms of its one word, 0 of none."""

    def __init__(self, at: dict[str, int]) -> None:
        super().__init__()
        self.at, self.first, self.second = at, array("i", [-1]), array("i", [-1])

    def __missing__(self, token: str) -> int:
        words = [token] if token.isalpha() else WORD(token)
        if len(words) > 1:
            code = -1
        else:
            known = [self.at[t] for t in (terms_of(words[0]) if words else ()) if t in self.at]
            code = len(self.first) if known else 0
            if known:
                self.first.append(known[0])
                self.second.append(known[1] if len(known) > 1 else -1)
        if len(token) <= 64 and len(self) < CACHE:
            self[token] = code
        return code

    def counts(self, texts: list):
        """(text, term, how often), sorted, over whole texts in lower case, as three arrays."""
        import numpy as np

        codes, lengths, more = [], [], []
        for i, text in enumerate(texts):
            tokens = (text or "").lower().split()
            got = [self[t] for t in tokens]
            if -1 in got:  # several words without white space between them
                more += [(i, self.at[t]) for token, c in zip(tokens, got) if c < 0 for w in WORD(token) for t in terms_of(w) if t in self.at]
            codes.append(np.array(got, dtype=np.int32))
            lengths.append(len(got))
        code, where = np.concatenate(codes) if codes else np.empty(0, dtype=np.int32), np.repeat(np.arange(len(lengths)), lengths)
        where, code = where[code > 0], code[code > 0]
        both = [np.array(x, dtype=np.int32)[code] for x in (self.first, self.second)]
        extra = np.array(more, dtype=np.int64).reshape(-1, 2)
        cell = np.concatenate([*(where[t >= 0] * len(self.at) + t[t >= 0] for t in both), extra[:, 0] * len(self.at) + extra[:, 1]])
        cell, n = np.unique(cell, return_counts=True)
        return cell // max(1, len(self.at)), cell % max(1, len(self.at)), n


def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled documents with each term, by label; term '' counts documents."""
    terms, yes, no = Terms(), Counter(), Counter()
    for b in batches:
        for toxic, text in zip(b["toxic"].to_pylist(), b["text"]):
            found = terms.of(text.as_py()) | {""}
            (yes if toxic else no).update(found)
            if len(yes) + len(no) > 500_000:
                yield _association_rows(yes, no)
                yes, no = Counter(), Counter()
    yield _association_rows(yes, no)


def _association_rows(yes: Counter, no: Counter) -> pa.RecordBatch:
    names = list(yes.keys() | no.keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([yes[t] for t in names], pa.int64()), pa.array([no[t] for t in names], pa.int64())], names=["term", "yes", "no"])


def _vectors(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    import numpy as np

    known = Numbers(sent.value)
    for b in batches:
        doc, term, n = known.counts(b["text"].to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, n)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], *lists], names=["doc_id", "toxic", "at", "n"])


def document_frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(number, df) of the terms (term, number) over all texts; number -1 counts the texts."""
    low = F.lower("text")

    def beginnings(n: int) -> "F.Column":
        return F.explode(F.array_distinct(F.split(F.regexp_replace(low, rf"(\p{{L}}{{{n}}})\p{{L}}+", "$1"), r"[^\p{L}]+"))).alias("term")

    found = texts.select(beginnings(SHORT)).unionByName(texts.select(beginnings(LONG)).where(F.length("term") > SHORT)).join(F.broadcast(terms), "term")
    return found.groupBy("number").agg(F.count("*").alias("df")).unionByName(texts.select(F.lit(-1).alias("number")).groupBy("number").agg(F.count("*").alias("df")))


def term_weights(df, n: int, yes, no, toxic: int, clean: int):
    """Weight of each term: idf over all n documents, times what its association with the label adds.

    A term that stands as often in toxic as in other examples, or too seldom to tell, keeps its plain idf. Beyond SURE
    standard deviations (the root of chi-square) the factor grows in proportion, so that two texts that share an
    insult are nearer than two that share a topic. No term is left out.
    """
    import numpy as np

    idf = np.log((n + 1) / (np.asarray(df, dtype=float) + 1)) + 1
    if not toxic or not clean or not len(idf):
        return idf
    a, b, all_ = np.asarray(yes, dtype=float), np.asarray(no, dtype=float), float(toxic + clean)
    rest = np.maximum(all_ - a - b, 0.5)
    z = np.abs(a * (clean - b) - b * (toxic - a)) * np.sqrt(all_ / ((a + b) * rest * toxic * clean))
    return idf * (1 + np.maximum(0, z - SURE))


class Index:
    """Block-max inverted index of labelled examples; nearest() is exact.

    Queries go in batches. The FREQUENT terms of the most examples have their postings side by side, a matrix for each
    block; all other terms have posting lists by block. Bounds of a block are its largest weight of each term.
    """

    def __init__(self, terms: list[str], weight_of, examples: list[tuple[int, int, list[int], list[int]]]) -> None:
        import numpy as np

        self.terms, self.weight_of = terms, weight_of
        rows = [(doc, toxic, at, self.weigh(at, n), n) for doc, toxic, at, n in examples if len(at)]
        # examples with the same leading term stand together, which makes block maxima tight
        rows.sort(key=lambda r: (r[2][int(r[3].argmax())], -float(r[3].max()), r[0]))
        self.docs = np.array([r[0] for r in rows], dtype=np.int64)
        self.toxic = np.array([r[1] for r in rows], dtype=float)
        self.ends = np.cumsum([0, *(len(r[2]) for r in rows)])
        self.term = np.concatenate([r[2] for r in rows]).astype(np.int32) if rows else np.empty(0, dtype=np.int32)
        self.weight = np.concatenate([r[3] for r in rows]) if rows else np.empty(0)
        self.n = np.concatenate([r[4] for r in rows]).astype(np.int32) if rows else np.empty(0, dtype=np.int32)
        zero = [toxic for _, toxic, at, _ in examples if not len(at)]
        base = sum(toxic for _, toxic, _, _ in examples)
        self.none = (sum(zero) + (base + 0.5) / (len(examples) + 1)) / (len(zero) + 1)  # texts without a known word: the rate of such examples, drawn to the rate of all
        self.slope, self.shift = self.calibrated()

    @property
    def blocks(self) -> int:
        return -(-len(self.docs) // BLOCK)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "dense", "heads", "starts", "top", "at", "w")}

    def ready(self) -> None:
        """Lays out the postings, once in each process."""
        import numpy as np

        if hasattr(self, "place") or not self.blocks:
            return
        n, t = len(self.docs), len(self.terms)
        df = np.bincount(self.term, minlength=t)
        often = np.argsort(-df, kind="stable")[:FREQUENT]
        self.place = np.full(t, -1, dtype=np.int32)
        self.place[often] = np.arange(len(often))
        doc = np.repeat(np.arange(n), np.diff(self.ends))
        col = self.place[self.term]
        self.dense = np.zeros((n, FREQUENT))
        self.dense[doc[col >= 0], col[col >= 0]] = self.weight[col >= 0]
        doc, term, weight = doc[col < 0], self.term[col < 0], self.weight[col < 0]
        cell = (doc // BLOCK) * t + term
        order = np.argsort(cell, kind="stable")
        cell, self.at, self.w = cell[order], doc[order], weight[order]
        self.starts = np.searchsorted(cell, np.arange(self.blocks * t + 1)).astype(np.int64)
        self.top = np.zeros(self.blocks * t)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        if len(first):
            self.top[cell[first]] = np.maximum.reduceat(self.w, first)
        self.top = np.ascontiguousarray(self.top.reshape(self.blocks, t).T)
        self.heads = np.maximum.reduceat(self.dense, np.arange(0, n, BLOCK), axis=0).T

    def known(self) -> Numbers:
        return Numbers({t: i for i, t in enumerate(self.terms)})

    def weigh(self, at, n):
        import numpy as np

        v = (1 + np.log(np.array(n, dtype=float))) * self.weight_of[np.array(at, dtype=int)]
        return v / np.sqrt(v @ v)

    def nearest(self, doc, term, n, count: int, k: int = NEAREST, skip=None) -> list[tuple[list[int], list[float]]]:
        """For each of `count` queries, the k examples of the largest cosine over zero, ties to the smaller doc_id.

        doc, term, n: the queries' terms, sorted. skip: an example that each query passes over. The FIRST blocks with
        the largest upper bounds are scored first, then those whose bound can still reach the k-th cosine found.
        """
        import numpy as np

        self.ready()
        if not self.blocks or not count:
            return [([], [])] * count
        v = (1 + np.log(n)) * self.weight_of[term]
        v = v / np.sqrt(np.bincount(doc, weights=v * v, minlength=count))[doc]
        col = self.place[term]
        q = np.zeros((count, FREQUENT))
        q[doc[col >= 0], col[col >= 0]] = v[col >= 0]
        doc, term, v = doc[col < 0], term[col < 0], v[col < 0]
        ends = np.searchsorted(doc, np.arange(count + 1))
        bound = q @ self.heads
        if len(doc):
            inside = np.flatnonzero(np.diff(ends))
            bound[inside] += np.add.reduceat(self.top[term] * v[:, None], ends[inside], axis=0)
        sums, todo = np.zeros((count, len(self.docs))), bound > 0
        early = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        now = np.zeros_like(todo)
        np.put_along_axis(now, early, True, axis=1)
        for last in (False, True):
            now = todo if last else now & todo
            for b in np.flatnonzero(now.any(axis=0)).tolist():
                asks = np.flatnonzero(now[:, b])
                lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.docs))
                found = q[asks] @ self.dense[lo:hi].T
                size = ends[asks + 1] - ends[asks]
                i = np.arange(int(size.sum())) + np.repeat(ends[asks] - np.cumsum(size) + size, size)
                start = self.starts[b * len(self.terms) + term[i]]
                many = self.starts[b * len(self.terms) + term[i] + 1] - start
                some = np.flatnonzero(many)
                start, many = start[some], many[some]
                j = np.arange(int(many.sum())) + np.repeat(start - np.cumsum(many) + many, many)
                row = np.repeat(np.repeat(np.arange(len(asks)), size)[some], many)
                found += np.bincount(row * (hi - lo) + self.at[j] - lo, weights=self.w[j] * np.repeat(v[i[some]], many), minlength=found.size).reshape(found.shape)
                sums[asks, lo:hi] = found
            if skip is not None:
                sums[np.arange(count), skip] = 0
            least = np.partition(sums, -k, axis=1)[:, -k] if k <= sums.shape[1] else np.zeros(count)
            todo = todo & ~now & (bound >= least[:, None] - 1e-9)
        out = []
        for s, low in zip(sums, least):
            ids = np.flatnonzero((s > 0) & (s >= low - 1e-12))
            keep = ids[np.lexsort((self.docs[ids], -np.round(s[ids], 12)))[:k]]
            out.append((keep.tolist(), s[keep].tolist()))
        return out

    def vote(self, ids: list[int], sims: list[float]) -> float:
        """Share of toxic examples, each weighted by the inverse of its distance, with a little of the rate of
        documents that have no known word."""
        w = [1 / (0.05 + 1 - min(s, 1.0)) for s in sims]
        return (sum(x * self.toxic[i] for x, i in zip(w, ids)) + 0.5 * self.none) / (sum(w) + 0.5)

    def calibrated(self) -> tuple[float, float]:
        """Platt scaling of votes that each example gets from the others."""
        import numpy as np

        if not self.blocks:
            return 1.0, 0.0
        x: list = []
        for lo in range(0, len(self.docs), BATCH):
            hi = min(lo + BATCH, len(self.docs))
            some = slice(self.ends[lo], self.ends[hi])
            doc = np.repeat(np.arange(hi - lo), np.diff(self.ends[lo : hi + 1]))
            found = self.nearest(doc, self.term[some], self.n[some], hi - lo, skip=np.arange(lo, hi))
            x += [self.logit(self.vote(*f)) for f in found]
        x = np.array(x)
        y = self.toxic
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * b])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 1.0 / max(abs(step)))
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        return (float(a), float(b)) if a > 0 else (1.0, 0.0)

    @staticmethod
    def logit(p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def scores(self, texts: list, known: Numbers) -> list[tuple[float, list[int]]]:
        """(calibrated score, doc_ids of the three nearest examples) of each text."""
        out = []
        for lo in range(0, len(texts), BATCH):
            some = texts[lo : lo + BATCH]
            for ids, sims in self.nearest(*known.counts(some), len(some)):
                if not ids:
                    out.append((self.none, []))
                    continue
                z = self.slope * self.logit(self.vote(ids, sims)) + self.shift
                out.append((1 / (1 + math.exp(-max(min(z, 500), -500))), [int(self.docs[i]) for i in ids[:3]]))
        return out


def fit(docs: DataFrame, labels: DataFrame, learn: "F.Column", sample: int = SAMPLE) -> Index:
    """Builds the index from at most `sample` labelled documents, chosen by a hash of doc_id.

    docs (doc_id, text), labels (doc_id, toxic); `learn` is a condition on labels.doc_id. A doc_id with several
    labels counts as toxic if half of them do or more. Terms are all those of the sampled documents; their document
    frequencies come from all documents. Without labels or documents the index is empty and scores 0.5.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample)
    examples = written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"))
    seen = examples.mapInArrow(_associations, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    seen = seen.toArrow().sort_by("term").to_pydict()  # the words of `sample` documents
    (toxic, clean), first = ((seen["yes"][0], seen["no"][0]), 1) if seen["term"] and not seen["term"][0] else ((0, 0), 0)
    terms, yes, no = seen["term"][first:], seen["yes"][first:], seen["no"][first:]
    sent = Sent(spark, {t: i for i, t in enumerate(terms)})
    listed = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "number": pa.array(range(len(terms)), pa.int32())}))
    df = dict(document_frequencies(texts.select("text"), listed).collect())
    n = df.pop(-1, 0)
    weight_of = term_weights([df.get(i, 0) for i in range(len(terms))], n, yes, no, toxic, clean)
    rows = examples.mapInArrow(lambda it: _vectors(it, sent), "doc_id long, toxic int, at array<int>, n array<int>").toArrow()
    return Index(terms, weight_of, sorted((r["doc_id"], r["toxic"], r["at"], r["n"]) for b in rows.to_batches() for r in b.to_pylist()))


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    index = sent.value
    v = index.known()
    for b in batches:
        got = index.scores(b["text"].to_pylist(), v)
        yield pa.RecordBatch.from_arrays([b["row_no"], b["doc_id"], pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], names=["row_no", "doc_id", "score", "evidence"])


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(row_no, doc_id, score, evidence) of every whole text; the score is a function of the text alone.

    Texts that are null, empty or without any word of an example get the smoothed rate of such examples and no
    evidence. evidence holds doc_ids of the nearest labelled examples. Repeated rows stay.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = Sent(spark, index)  # the words of SAMPLE examples
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, sent), "row_no long, doc_id long, score double, evidence array<long>")


def reject(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """docs without rows that score `threshold` or more; all columns kept."""
    spark = docs.sparkSession
    tune(spark)
    sent = Sent(spark, index)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        v = ix.known()
        at = names.index("text")
        for b in batches:
            yield b.filter(pa.array([s < threshold for s, _ in ix.scores(b.column(at).to_pylist(), v)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
