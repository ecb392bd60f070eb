"""Quality scores: histogram gradient-boosted trees over document statistics.

Statistics of each whole text (shares of character classes, word and line
lengths, repetition) are computed for a slice of texts at once. Trees are grown
level by level on binned statistics and kept as flat arrays, so that numpy moves
all documents of a slice down all trees together.

The model is fitted on at most ``max_rows`` labelled rows, those with the
smallest hashes of doc_id; all documents are scored.

Nulls and cases: a null or empty text has statistics of 0 and gets the model's
score for them. Rows with a null label or id teach nothing; several labels of one
document all count. Without labels every score is 0.5, with labels of one kind
only it is that label. Repeated rows are kept; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, text_slices
from quarry.llm.unicode_classes import LETTER, NUMBER, OTHER, SPACE
from quarry.llm.vector import group_of, join, kinds, prefix_hashes, runs, span_hashes, sums

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 30_000

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "spaces", "others", "non_ascii", "bars", "bangs", "marks",
    "stops", "commas", "line_length", "lines_distinct", "words_distinct", "words_repeated", "words_capital", "words_edged", "short_words", "top_word",
)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    points, starts = join(texts)
    n = len(texts)
    kind = kinds()[points]
    chars = np.maximum(np.diff(starts) - 1, 0)
    per_char = 1 / np.maximum(chars, 1)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE))

    def share(flags: np.ndarray) -> np.ndarray:
        return sums(flags, starts) * per_char

    a, b = runs(kind != SPACE)
    word_of = group_of(a, starts)
    words = np.bincount(word_of, minlength=n)
    per_word = 1 / np.maximum(words, 1)
    length = (b - a).astype(float)
    mean = np.bincount(word_of, length, n) * per_word
    sd = np.sqrt(np.maximum(np.bincount(word_of, length**2, n) * per_word - mean**2, 0))
    prefix = prefix_hashes(points)
    word = span_hashes(prefix, a, b)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (word_of[1:] == word_of[:-1])]) if len(word) else np.zeros(0, bool)
    # distinct words of each text, and how often its most frequent one stands there
    order = np.lexsort((word, word_of))
    w, o = word[order], word_of[order]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])) if len(w) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(w)]]))
    distinct = np.bincount(o[new], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, o[new], times)
    # lines that are not empty
    c, d = runs(points != 10)
    line_of = group_of(c, starts)
    lines = np.bincount(line_of, minlength=n)
    line = span_hashes(prefix, c, d)
    order = np.lexsort((line, line_of))
    w, o = line[order], line_of[order]
    fresh = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])]) if len(w) else np.zeros(0, bool)
    lines_distinct = np.bincount(o[fresh], minlength=n)
    capital = upper[a] if len(a) else np.zeros(0, bool)
    edged = (kind[b - 1] == OTHER) if len(b) else np.zeros(0, bool)
    columns = {
        "log_chars": np.log1p(chars), "log_words": np.log1p(words), "word_length": mean, "word_length_sd": sd,
        "letters": share(kind == LETTER), "upper": share(upper), "digits": share(kind == NUMBER), "spaces": (sums(kind == SPACE, starts) - 1) * per_char,
        "others": share(kind == OTHER), "non_ascii": share(points > 127), "bars": share(points == 124), "bangs": share((points == 33) | (points == 63)),
        "marks": share((points == 35) | (points == 36) | (points == 37) | (points == 38) | (points == 42)), "stops": share(points == 46), "commas": share(points == 44),
        "line_length": chars / np.maximum(lines, 1), "lines_distinct": lines_distinct / np.maximum(lines, 1), "words_distinct": distinct * per_word,
        "words_repeated": np.bincount(word_of, again, n) * per_word, "words_capital": np.bincount(word_of, capital, n) * per_word,
        "words_edged": np.bincount(word_of, edged, n) * per_word, "short_words": np.bincount(word_of, length <= 3, n) * per_word, "top_word": top * per_word,
    }
    return np.column_stack([columns[x] for x in STATISTICS]).astype(np.float32)


class Trees:
    """Boosted trees in flat arrays: feature, threshold and value for each tree and node."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float) -> None:
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        tree = np.arange(trees)
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(nodes + 1)) - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 12, l2: float = 2.0) -> Trees:
    """Fit trees to the logistic loss, by histograms of gradients over quantile bins."""
    nodes = 2 ** (depth + 1) - 1
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        base = base if len(y) == 0 else (9.0 if y[0] else -9.0)
        return Trees(np.zeros((1, nodes), np.int64), np.zeros((1, nodes)), np.zeros((1, nodes)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    features, thresholds, values = [], [], []
    raw = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            local = node - low
            best, choice = np.full(width, 1e-6), [None] * width
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                flat = local * bins + binned[:, j]
                sg, sh, sn = (np.bincount(flat, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain = np.where((sn >= least) & (tn - sn >= least), gain, 0)[:, : len(e)]
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k], choice[k] = gain[k, at[k]], (j, int(at[k]))
            for k, found in enumerate(choice):
                if found:
                    feature[low + k], threshold[low + k] = found[0], edges[found[0]][found[1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + l2) * rate
        value[:] = leaf
        raw += leaf[node]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Fit on at most ``max_rows`` rows of ``labels`` (doc_id and ``label``); their statistics go to the driver."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    joined = _texts(docs).join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "y"):
            yield pa.RecordBatch.from_arrays([pa.array(other["y"], pa.int32()), pa.array(list(statistics(texts)), pa.list_(pa.float32()))], names=["y", "x"])

    rows = joined.mapInArrow(run, "y int, x array<float>").toPandas()
    rows = rows.iloc[np.lexsort(np.array(rows["x"].tolist()).T)] if len(rows) else rows  # the same model whatever the order of rows
    x = np.array(rows["x"].tolist(), dtype=np.float32).reshape(len(rows), len(STATISTICS))
    return boost(x, rows["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= threshold) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # flat trees of a fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "doc_id"):
            s = shared.value.scores(statistics(texts))
            yield pa.RecordBatch.from_arrays([pa.array(other["doc_id"], pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id")))
