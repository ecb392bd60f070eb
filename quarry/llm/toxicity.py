"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words learns from confirmed toxic
texts and from unlabelled ones. With class prior p, loss l, and averages over
positive (P) and unlabelled (U) texts, it minimises
``p * P l(+) + max(0, U l(-) - p * P l(-))``; a batch whose corrected negative
risk is below zero takes a step back instead (the non-negative estimator).
Held-back parts of both samples turn margins into probabilities: by Bayes' rule
a score is p times the share of positives over the share of unlabelled texts
near that margin, made monotone.

At most ``max_positive`` and ``max_unlabelled`` texts, those with the smallest
hashes of doc_id, teach; words known to fewer than ``least_docs`` of them, or
whose shares of the two samples differ by fewer than ``least_z`` standard errors,
have no weight. All documents are scored, on their whole texts.

Nulls and cases: a null or empty text has no words and gets the score of that
margin. Null labels and ids teach nothing. Without a toxic label all scores are
0. Repeated rows are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, text_slices, written
from quarry.llm.unicode_classes import LETTER
from quarry.llm.vector import group_of, join, kinds, prefix_hashes, runs, span_hashes

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
LEAST_DOCS = 12


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased words of each text as hashes: text, word; sorted by text."""
    points, starts = join([x.lower() for x in texts])
    a, b = runs(kinds()[points] == LETTER)
    who = group_of(a, starts)
    word = span_hashes(prefix_hashes(points), a, b) >> np.uint64(1)
    order = np.lexsort((word, who))
    who, word = who[order], word[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (word[1:] != word[:-1])]) if len(who) else np.zeros(0, bool)
    return who[new], word[new].astype(np.int64)


class Model:
    """Sorted word hashes with weights, a bias, and a monotone curve from margins to probabilities."""

    def __init__(self, word: np.ndarray, weight: np.ndarray, bias: float, margins: np.ndarray, chances: np.ndarray) -> None:
        self.word, self.weight, self.bias, self.margins, self.chances = word, weight, bias, margins, chances

    def margin(self, texts: list[str]) -> np.ndarray:
        who, word = words(texts)
        return self.bias + np.bincount(who, self._weights(word), minlength=len(texts))

    def _weights(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(word))
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, self.weight[at], 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.margins):
            return np.zeros(len(texts))
        return np.interp(self.margin(texts), self.margins, self.chances)


class _Rows:
    """Sparse rows of word numbers."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray) -> None:
        kept = []
        for r in rows:
            at = np.searchsorted(vocabulary, r)
            at[at == len(vocabulary)] = 0
            kept.append(at[vocabulary[at] == r] if len(vocabulary) else at[:0])
        self.sizes = np.fromiter(map(len, kept), np.int64, len(kept))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[which]
        at = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(which)), n), self.flat[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """What a step descends on, and its gradients by the margins of positive and unlabelled rows.

    The risk is the prior's share of the positives' loss as positives, and the
    unlabelled's loss as negatives less the prior's share of the positives' loss as
    negatives. Where that last part falls below zero it is overfitted: the step goes
    back on it alone.
    """
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative < 0:
        return -negative, prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)
    return prior * np.logaddexp(0, -zp).mean() + negative, np.full(len(zp), -prior / len(zp)), _sigmoid(zu) / len(zu)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], back_p: np.ndarray, back_u: np.ndarray, vocabulary: np.ndarray, prior: float, epochs: int = 30, batch: int = 500, rate: float = 0.02, l2: float = 1e-3, seed: int = 7) -> Model:
    """Fit the classifier; rows are arrays of word hashes, ``back`` says which are held back for the curve."""
    empty = np.zeros(0)
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), empty, 0.0, empty, empty)
    rng = np.random.default_rng(seed)
    back_p, back_u = (x if len(x) >= 50 and not x.all() else np.zeros(len(x), bool) for x in (back_p, back_u))
    p, u = _Rows(positive, vocabulary), _Rows(unlabelled, vocabulary)
    in_p, in_u = np.flatnonzero(~back_p), np.flatnonzero(~back_u)
    w, bias = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0

    def margins(rows: _Rows, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = rows.take(which)
        return bias + np.bincount(r, w[c], minlength=len(which)), r, c

    for _ in range(epochs):
        rng.shuffle(in_p), rng.shuffle(in_u)
        batches = max(1, -(-len(in_u) // batch))
        for us, ps in zip(np.array_split(in_u, batches), np.array_split(in_p, batches)):
            if not len(ps):
                ps = rng.choice(in_p, min(len(in_p), 32), replace=False)
            zu, ru, cu = margins(u, us)
            zp, rp, cp = margins(p, ps)
            _, gp, gu = risk(zp, zu, prior)
            gradient = np.zeros(len(w) + 1)
            gradient[:-1] = np.bincount(cu, gu[ru], len(w)) + np.bincount(cp, gp[rp], len(w)) + l2 * w
            gradient[-1] = gu.sum() + gp.sum()
            step += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - change[:-1], bias - change[-1]
    out_p, out_u = (np.flatnonzero(b) if b.any() else np.arange(len(b)) for b in (back_p, back_u))
    zp, zu = margins(p, out_p)[0], margins(u, out_u)[0]
    return Model(vocabulary, w, float(bias), *_curve(zp, zu, prior))


def _curve(zp: np.ndarray, zu: np.ndarray, prior: float, bins: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities over margins, by Bayes' rule in bins of equal weight, then pooled until monotone."""
    z = np.concatenate([zp, zu])
    weight = np.concatenate([np.full(len(zp), prior / len(zp)), np.full(len(zu), 1 / len(zu))])
    order = np.argsort(z, kind="stable")
    z, weight = z[order], weight[order]
    toxic = np.where(order < len(zp), weight, 0.0)
    seen = np.where(order < len(zp), 0.0, weight)
    cut = np.minimum((np.cumsum(weight) / weight.sum() * bins).astype(int), bins - 1)
    blocks: list[list[float]] = []
    for b in np.unique(cut):
        here = cut == b
        blocks.append([toxic[here].sum(), seen[here].sum() + 1e-4, z[here].mean(), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            x = blocks.pop()
            y = blocks.pop()
            blocks.append([y[0] + x[0], y[1] + x[1], (y[2] * y[3] + x[2] * x[3]) / (y[3] + x[3]), y[3] + x[3]])
    return np.array([b[2] for b in blocks]), np.clip([b[0] / b[1] for b in blocks], 0, 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, least_docs: int = LEAST_DOCS, least_z: float = 4.0) -> Model:
    """Learn from ``labels`` (doc_id, ``label``) and texts of ``docs`` without using their labels.

    The prior is the share of toxic rows among the labelled, unless it is given.
    Words are counted and screened in Spark; of at most ``max_positive + max_unlabelled``
    texts only the words that pass go to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    toxic = known.where(F.col(label) > 0).select(F.col("doc_id").cast("long").alias("doc_id"))
    if prior is None:
        prior = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0] or 0.0
    prior = float(np.clip(prior, 1e-3, 0.9))
    some = toxic.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).withColumn("kind", F.lit(1))
    other = _texts(docs).select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled).withColumn("kind", F.lit(0))
    chosen = _texts(docs).join(F.broadcast(some.unionByName(other)), "doc_id")  # bounded numbers of ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "doc_id", "kind"):
            who, word = words(texts)
            rows = np.split(word, np.searchsorted(who, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([pa.array(other["doc_id"], pa.int64()), pa.array(other["kind"], pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "kind", "words"])

    rows = written(chosen.mapInArrow(run, "doc_id long, kind int, words array<long>").withColumn("back", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 4))
    vocabulary = _telling(rows.where("not back"), least_docs, least_z)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # words of a bounded sample that pass a test

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x.values.to_numpy()[np.isin(x.values.to_numpy(), shared.value)] for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "kind", "back", "words"])

    few = rows.select("doc_id", "kind", "back", "words").mapInArrow(thin, "doc_id long, kind int, back boolean, words array<long>").toPandas().sort_values(["doc_id", "kind"])
    lists = [np.asarray(x, dtype=np.int64) for x in few["words"]]
    kind, back = few["kind"].to_numpy(), few["back"].to_numpy(dtype=bool)
    return train([r for r, k in zip(lists, kind) if k == 1], [r for r, k in zip(lists, kind) if k == 0], back[kind == 1], back[kind == 0], vocabulary, prior)


def _telling(rows: DataFrame, least_docs: int, least_z: float) -> np.ndarray:
    """Words whose share of the positive texts is not that of the unlabelled, beyond chance: sorted hashes."""
    sizes = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return np.zeros(0, np.int64)
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n + m)
    z = (a / n - b / m) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n + 1 / m))
    counted = rows.select("kind", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("kind") == 1).alias("a"), F.count_if(F.col("kind") == 0).alias("b"))
    kept = counted.where((a + b >= min(least_docs, max(1, n // 4))) & (F.abs(z) >= least_z)).select("word").toPandas()
    return np.sort(kept["word"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= threshold) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the words of a bounded sample
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "doc_id"):
            s = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([pa.array(other["doc_id"], pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id")))
