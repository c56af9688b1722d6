"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model over a sentence's distinct words, each with its first letters
as further features so that inflected forms share evidence, gives the probability that the sentence offends; noisy-or combines them: a document is toxic unless every one of its sentences is harmless,
``1 - prod(1 - q)``. Only documents carry labels, so the sentence model is trained through the noisy-or, and
then tells which sentences offend.

Scoring bounds what sentences below one half add together by ``MOST_BACKGROUND``: every sentence has some
probability, and without the bound a text would become toxic by its length alone.

The model is fitted on the driver from a bounded sample of labelled documents (``sample_per_class`` of each
class, chosen by hash). Scoring reads every text whole, in one pass without a shuffle.

Nulls and empty texts are bags of one empty sentence. Rows without a label, or whose id is null, are scored and
never learnt from. Without any labelled row of both classes there is nothing to learn: every score is then the
share of toxic labels, 0 if there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WORDS = re.compile(r"[^\W\d_]+")


def words(sentence: str) -> set[str]:
    return set(_WORDS.findall(sentence.lower()))


#: Lengths of the prefixes that are features besides the word.
PREFIXES = (4, 5, 6)
#: What the sentences that don't offend by themselves add to -log(1 - score) at most: with it, the score is 0.45.
MOST_BACKGROUND = 0.6
#: Words a model remembers the weight of.
_MEMORY = 100_000


def features(word: str) -> list[str]:
    """The word, and its prefixes marked with a caret."""
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


@dataclass
class ToxicityModel:
    """Feature weights and bias of the sentence model; ``prior`` is the answer where nothing could be learnt."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    prior: float | None = None
    _seen: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word(self, word: str) -> float:
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) >= _MEMORY:
                self._seen.clear()
            found = self._seen[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (begin, end, probability) of the sentences at 0.5 or more."""
        if self.prior is not None:
            return self.prior, []
        text, quiet, offending, calm, background = text or "", 0, [], 0.0, 0.0
        hot = {w: z for w in words(text) if (z := self.word(w))}
        # Sentences without a weighted word all have the bias alone; only the others are looked at one by one.
        for m in _SENTENCE.finditer(text):
            if hot and (hit := words(m[0]) & hot.keys()):
                z = self.bias + sum(sorted(hot[w] for w in hit))
                if z < 0:
                    background += _softplus(z)
                else:
                    calm += _softplus(z)
                    offending.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
            else:
                quiet += 1
        background += max(quiet, not text) * _softplus(self.bias)
        return -math.expm1(-calm - min(background, MOST_BACKGROUND)), offending


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def screen(bags: list[list[set[str]]], y: np.ndarray, min_docs: int, most: int) -> dict[str, int]:
    """At most ``most`` features that toxic documents have significantly oftener, the most telling first."""
    count = Counter(), Counter()
    for bag, label in zip(bags, y):
        count[int(label)].update({f for w in set().union(*bag) for f in features(w)})
    n1, n0, found = y.sum(), len(y) - y.sum(), []
    for f, k in count[1].items():
        p = (k + count[0][f]) / len(y)
        gap = k / n1 - count[0][f] / n0
        z = gap / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        if k >= min_docs and z > 3:
            found.append((-z, f))
    return {f: i for i, (_, f) in enumerate(sorted(found)[:most])}


def fit(texts: list[str], labels: list[int], l1: float = 3e-4, epochs: int = 400, min_docs: int = 3, most: int = 3000, rate: float = 0.1) -> ToxicityModel:
    """Fit by proximal Adam on the noisy-or likelihood, classes weighted alike, weights drawn to zero (L1).

    Weights are not negative: a sentence can't excuse itself. Copies of a text count once.
    """
    seen = dict(zip(texts, labels))
    texts, y = list(seen), np.array(list(seen.values()), np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(prior=float(y.mean()) if len(y) else 0.0)
    bags = [[words(m[0]) for m in _SENTENCE.finditer(t)] or [set()] for t in texts]
    vocabulary = screen(bags, y, min_docs, most)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    entries = [(s, vocabulary[f]) for s, ws in enumerate(ws for bag in bags for ws in bag) for w in sorted(ws) for f in features(w) if f in vocabulary]
    rows, cols = np.array(entries, np.int64).reshape(-1, 2).T
    size = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    v, b = np.zeros(len(vocabulary)), -6.0
    m1, m2 = np.zeros(len(v) + 1), np.zeros(len(v) + 1)
    for step in range(1, epochs + 1):
        z = b + np.bincount(rows, v[cols], len(doc))
        calm = np.bincount(doc, np.logaddexp(0, z), len(y))
        pull = size * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(calm, 500)), 1e-9), 1.0)
        by_sentence = pull[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cols, by_sentence[rows], len(v)) + l1, by_sentence.sum())
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad * grad - m2)
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-5)
        v = np.maximum(v - move[:-1], 0)
        b = float(np.clip(b - move[-1], -14, -4))
    return ToxicityModel({f: float(v[i]) for f, i in vocabulary.items() if v[i] > 1e-3}, b)


def sample_labelled(docs: DataFrame, labels: DataFrame, sample_per_class: int, doc_id: str, text: str) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``sample_per_class`` learnable documents of each class, by the hash of their id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    ids = []
    for y in (0, 1):
        ids += usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_per_class).collect()
    if not ids:
        return [], []
    # At most twice sample_per_class ids: a bounded side to broadcast.
    small = F.broadcast(docs.sparkSession.createDataFrame(ids, "_id bigint, _y int"))
    rows = docs.select(docs[doc_id].cast("bigint").alias("_id"), docs[text].cast("string").alias("_t")).join(small, "_id").select("_id", "_y", "_t").collect()
    rows.sort(key=lambda r: (r._id, r._t or ""))
    return [r._t or "" for r in rows], [r._y for r in rows]


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = 1000, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on labelled documents whose ``crc32(doc_id) mod 5`` isn't 0; those are held out."""
    return fit(*sample_labelled(docs, labels, sample_per_class, doc_id, text))


SCORED = "score double, offending array<struct<begin:int,end:int,probability:double>>"


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", names: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """All columns of ``docs`` and two more: the score and the offending sentences (begin, end, probability).

    ``names`` are the names of these two; columns of the input with those names are replaced, others keep their
    values. One row in, one row out, repeated rows included. The model is bounded by its training sample.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kept = docs.drop(*names)
    at, n = kept.columns.index(text), len(kept.columns)
    spec = spark.createDataFrame([], SCORED).schema
    kind = to_arrow_type(spec["offending"].dataType)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [own.score(t) for t in part.column(at).cast(pa.string()).to_pylist()]
                spans = pa.array([[{"begin": a, "end": b, "probability": q} for a, b, q in x] for _, x in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s for s, _ in found], pa.float64()), spans], names=[f"c{i}" for i in range(n + 2)])

    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept.schema, *spec])])
    return kept.toDF(*[f"c{i}" for i in range(n)]).mapInArrow(run, out).toDF(*kept.columns, *names)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("offending_sentences"),
    )
