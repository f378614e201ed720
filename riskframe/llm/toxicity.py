"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic function of
a bias plus the weights of its words (and of the words' first 4 to 6 letters,
which carry over to inflected and compound forms); the document's score is the
noisy-or of its sentences. Only document labels are known: the weights maximise
the likelihood of the noisy-or, fitted on a bounded random sample of labelled
rows (``fit_docs`` documents, ``fit_bytes`` of their texts); every feature that stands out
there has a weight. Scoring runs over every sentence of every whole text and
locates the offending sentences.

Defined cases: a null or empty text is one empty sentence, so it gets the
bias's score; label rows that are null or match no document teach nothing, of several
labels for one id the largest counts; without both classes in the sample the
score is near 0 everywhere; rows with a null id are scored, not learnt from;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import text_or_empty

FIT_DOCS = 6_000          # labelled rows to learn from, at most
FIT_BYTES = 64 << 20      # of their texts, up to the one that reaches them
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
_MEMO = 500_000


def features(word: str) -> list[str]:
    """The word itself and, marked, its beginnings."""
    return [word, *(word[:n] + "~" for n in _PREFIXES if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence; one empty sentence in a text without any."""
    return [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]


@dataclass
class Model:
    bias: float = -12.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        v = self._memo.get(w)
        if v is None:
            v = sum(self.weights.get(f, 0.0) for f in features(w))
            if len(self._memo) > _MEMO:
                self._memo.clear()
            self._memo[w] = v
        return v

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its offending sentences (start, length, score)."""
        marked = {w for w in set(_WORD.findall(text.lower())) if self.word(w)}
        spans = sentences(text)
        total, plain, found = 0.0, softplus(self.bias), []
        if not marked:
            return -math.expm1(-plain * len(spans)), []
        for a, b in spans:
            here = marked.intersection(_WORD.findall(text[a:b].lower()))
            if not here:
                total += plain
                continue
            z = self.bias + sum(map(self.word, here))
            total += softplus(z)
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            if p >= 0.5:
                found.append((a, b - a, p))
        return -math.expm1(-total), found


def softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


@dataclass
class Bags:
    """Documents as numbers: word ``code`` of sentence ``sentence``, once per sentence;
    ``doc`` of every sentence; the ``words`` by code."""
    words: list[str]
    code: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Bags":
        index: dict[str, int] = {}
        codes, owners, docs, n = [], [], [], 0
        for d, text in enumerate(texts):
            own, at = [], []
            for a, b in sentences(text):
                here = {index.setdefault(w, len(index)) for w in _WORD.findall(text[a:b].lower())}
                own += here
                at += [n] * len(here)
                docs.append(d)
                n += 1
            codes.append(np.array(own, np.int32))
            owners.append(np.array(at, np.int32))
        return cls(list(index), np.concatenate(codes), np.concatenate(owners), np.array(docs, np.int32))


def _expand(code: np.ndarray, owner: np.ndarray, first: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) for every feature flat[first[c]:first[c + 1]] of every code."""
    n = first[code + 1] - first[code]
    at = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(owner, n), flat[at]


def _feature_table(words: list[str], index: dict[str, int], grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features of every word as runs of one array; unknown ones only when growing."""
    first, flat = [0], []
    for w in words:
        for f in features(w):
            k = index.setdefault(f, len(index)) if grow else index.get(f)
            if k is not None:
                flat.append(k)
        first.append(len(flat))
    return np.array(first, np.int64), np.array(flat, np.int32)


def choose_features(bags: Bags, y: np.ndarray, least_docs: int = 5, least_z: float = 3.5) -> list[str]:
    """Features that stand out in positive documents by a two-proportion z."""
    pair = np.unique(bags.doc[bags.sentence].astype(np.int64) * len(bags.words) + bags.code)
    doc, code = pair // len(bags.words), pair % len(bags.words)
    pos = y[doc] == 1
    # features of the words in positive documents, counted by document
    seen, local = np.unique(code[pos], return_inverse=True)
    index: dict[str, int] = {}
    first, flat = _feature_table([bags.words[c] for c in seen], index, True)
    owner, feat = _expand(local, doc[pos], first, flat)
    count = np.bincount(np.unique(owner * len(index) + feat) % max(1, len(index)), minlength=len(index))
    names = [f for f, n in zip(index, count) if n >= least_docs]
    a = count[count >= least_docs]
    index = {f: i for i, f in enumerate(names)}
    first, flat = _feature_table(bags.words, index, False)
    owner, feat = _expand(code[~pos], doc[~pos], first, flat)
    b = np.bincount(np.unique(owner * max(1, len(names)) + feat) % max(1, len(names)), minlength=len(names))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    p = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    return [f for _, f in sorted((-v, f) for v, f in zip(z, names) if v >= least_z)]


def fit_bags(texts: list[str], labels: list[int], steps: int = 800, rate: float = 0.1, ridge: float = 3e-4) -> Model:
    """Maximum likelihood of the noisy-or by Adam over the whole sample."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    bags = Bags.of(texts)
    names = choose_features(bags, y)
    first, flat = _feature_table(bags.words, {f: i for i, f in enumerate(names)}, False)
    owner, cols = _expand(bags.code, bags.sentence, first, flat)
    marked, rows = np.unique(owner, return_inverse=True)      # sentences with a feature
    doc, n = bags.doc[marked], len(marked)
    blank = np.bincount(bags.doc, minlength=len(y)) - np.bincount(doc, minlength=len(y))
    theta = np.zeros(len(names) + 1)
    theta[-1] = -5.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        b = theta[-1]
        z = np.bincount(rows, theta[cols], n) + b
        s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        sb = 1 / (1 + np.exp(-b))
        a = np.bincount(doc, np.logaddexp(0, z), len(y)) + blank * np.logaddexp(0, b)
        push = np.where(y == 1, -1 / np.expm1(np.clip(a, 1e-9, 60)), 1.0) / len(y)
        back = push[doc] * s
        grad = np.concatenate([np.bincount(cols, back[rows], len(names)) + ridge / max(1, len(names)) * theta[:-1],
                               [back.sum() + (push * blank).sum() * sb]])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        theta -= rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-8)
    return Model(float(theta[-1]), {f: float(v) for f, v in zip(names, theta) if abs(v) > 1e-6})


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_docs: int = FIT_DOCS,
        fit_bytes: int = FIT_BYTES, seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``fit_docs`` labelled documents, those of the smallest seeded
    hash of the id, among the label rows that ``learn`` (over id_col) admits; in this order
    up to the one whose text reaches ``fit_bytes``. Of repeated rows of a document the
    smallest text teaches, taken before the sample comes together."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.where(learn) if learn is not None else known
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(fit_docs)
    # the sample has at most fit_docs rows of two numbers
    rows = (docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
            .join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
    before = Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0)))
            .where(F.col("before") < fit_bytes).select("id", "text", "y"))
    # one task holds the bounded sample; the driver gets the weights
    found = rows.repartition(1).mapInArrow(_fit_task, "feature string, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in found}
    bias = weights.pop(None, None)
    return Model() if bias is None else Model(bias, weights)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, weight) rows of the fitted model, the bias under no feature."""
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
    rows.sort(key=lambda r: r[0])
    model = fit_bags([r[1] for r in rows], [r[2] for r in rows])
    yield pa.record_batch([pa.array([None, *model.weights], pa.string()),
                           pa.array([model.bias, *model.weights.values()], pa.float64())], ["feature", "weight"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, offending (array of start, length, score in code points)."""
    told = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*told.value)
        for batch in batches:
            got = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([g[0] for g in got], pa.float64()),
                 pa.array([[dict(zip(("start", "length", "score"), s)) for s in g[1]] for g in got], spans)],
                ["doc_id", "score", "offending"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, score double, "
             "offending array<struct<start:int,length:int,score:double>>")


def reject(docs: DataFrame, model: Model, at: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose document scores below ``at``."""
    told = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*told.value)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([own.score(t or "")[0] < at for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
