"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three
characters of lower-cased words, word edges included), most frequent first.
A document's own list is compared with each profile: the out-of-place distance
sums, over the document's n-grams, how far apart the two ranks are, or the
profile's length where the n-gram is missing. The nearest profile wins; ties go
to the smaller language name. Counts for profiles run over all learning rows.

Nulls and cases: a null text, one without a letter, or no profile at all gives
``und`` with score 0. Rows with a null lang teach nothing. Repeated rows are kept
(and count again when learning). Equal counts rank by code points. Empty tables
give no rows. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import held_out, text_slices
from quarry.llm.unicode_classes import LETTER
from quarry.llm.vector import group_of, join, kinds

#: N-grams in a profile, and in a document's own list.
PROFILE = 400
UNKNOWN = "und"
_BITS = np.int64(21)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: text, code, count; and whether a text has a letter.

    A code holds three code points of 21 bits; 0 stands for a word's edge, and
    above all for the missing places of shorter n-grams.
    """
    points, starts = join([x.lower() for x in texts])
    points = points.astype(np.int64)
    points[kinds()[points] != LETTER] = 0
    keep = (points != 0) | np.concatenate([[True], points[:-1] != 0])  # a run of other characters is one edge
    at = np.flatnonzero(keep)
    owner = group_of(at, starts)
    p = points[at]
    alphabet, dense = np.unique(p, return_inverse=True)
    if len(alphabet) == 0 or alphabet[0] != 0:
        alphabet, dense = np.concatenate([[0], alphabet]), dense + 1
    width = max(1, int(len(alphabet) - 1).bit_length())
    same = owner[1:] == owner[:-1]
    dense = dense.astype(np.int64)
    # one, two and three characters; the first text character of each text has an edge before it
    one = dense[dense > 0]
    first = np.concatenate([[True], ~same])
    before = np.where(first, 0, np.concatenate([[0], dense[:-1]]))
    two_ok = (before > 0) | (dense > 0)
    two = (before << width) | dense
    last = np.concatenate([~same, [True]])
    after = np.where(last, 0, np.concatenate([dense[1:], [0]]))
    three_ok = (dense > 0) & ((before > 0) | (after > 0))
    three = (((before << width) | dense) << width) | after
    size = np.int64(1) << np.int64(2)
    span = np.int64(3 * width)

    def keyed(who: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        return (((who.astype(np.int64) << span) | code) * size) + n

    keys = np.concatenate([keyed(owner[dense > 0], one, 1), keyed(owner[two_ok], two[two_ok], 2), keyed(owner[three_ok], three[three_ok], 3)])
    keys.sort()
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(keys)]]))
    distinct = keys[new]
    n, rest = distinct % size, distinct // size
    who, code = rest >> span, rest & ((np.int64(1) << span) - 1)
    mask = (np.int64(1) << np.int64(width)) - 1
    a, b, c = alphabet[(code >> np.int64(2 * width)) & mask], alphabet[(code >> np.int64(width)) & mask], alphabet[code & mask]
    # the lengths stay apart: an n-gram of n characters has 3 - n leading places of U+10FFFF + 1 - n
    filler = np.int64(0x110000)
    a = np.where(n < 3, filler + n, a)
    b = np.where(n < 2, filler, b)
    return who, (a << (2 * _BITS)) | (b << _BITS) | c, counts, np.bincount(owner[dense > 0], minlength=len(texts)) > 0


def fit(docs: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows with text and lang: n-gram codes, most frequent first.

    N-grams are counted over whole texts of all rows, inside each task first. The
    driver gets ``profile`` codes for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return codes, np.bincount(inverse, np.concatenate([x for _, x in parts])).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            codes, counts = merged(held.pop(lang))
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes)), "gram": pa.array(codes), "n": pa.array(counts)})

        for texts, other in text_slices(batches, "lang"):
            who, code, counts, _ = _grams(texts)
            names, number = np.unique(np.array(other["lang"], dtype=object).astype(str), return_inverse=True)
            of = number[who]
            for i, lang in enumerate(names.tolist()):
                held.setdefault(lang, []).append((code[of == i], counts[of == i]))
                if sum(len(x) for x, _ in held[lang]) > 300_000:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > 200_000:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = learn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", rank).where(F.col("place") <= profile).select("lang", "place", "gram").collect()
    found: dict[str, list[int]] = {}
    for x in sorted(top):
        found.setdefault(x["lang"], []).append(x["gram"])
    return found


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE) -> DataFrame:
    """All columns of ``docs`` but text-independent ones: doc_id, lang_pred, score, margin.

    ``score`` is 1 less the out-of-place distance to the nearest profile, as a
    share of the largest possible one; ``margin`` is by how much the next profile
    is farther away.
    """
    names = sorted(profiles)
    grams = np.array(sorted({g for x in profiles.values() for g in x}), dtype=np.int64)
    ranks = np.full((len(names), len(grams) + 1), -1, np.int32)  # the last column: in no profile
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(grams, np.array(profiles[name], dtype=np.int64))] = np.arange(len(profiles[name]))
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, ranks))  # profiles: a fixed length for each language
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams, ranks = shared.value
        for texts, other in text_slices(batches, "doc_id"):
            who, code, counts, letters = _grams(texts)
            order = np.lexsort((code, (who << np.int64(32)) - counts))
            who, code = who[order], code[order]
            first = np.searchsorted(who, np.arange(len(texts)))
            place = np.arange(len(who)) - first[who]
            top = place < profile
            who, code, place = who[top], code[top], place[top]
            size = np.bincount(who, minlength=len(texts))
            where = np.searchsorted(grams, code)
            where[(where == len(grams)) | (grams[np.minimum(where, len(grams) - 1)] != code if len(grams) else True)] = len(grams)
            far = np.ones((len(names) + 1, len(texts)))
            for i in range(len(names)):
                there = ranks[i, where]
                out = np.where(there < 0, profile, np.abs(there - place))
                far[i] = np.bincount(who, out, minlength=len(texts)) / np.maximum(size * profile, 1)
            best = far[: len(names)].argmin(axis=0) if names else np.zeros(len(texts), int)
            nearest = far[best, np.arange(len(texts))] if names else np.ones(len(texts))
            second = np.partition(far, 1, axis=0)[1] if names else nearest
            known = letters & bool(names)
            yield pa.RecordBatch.from_arrays([
                pa.array(other["doc_id"], pa.int64()),
                pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                pa.array(np.where(known, np.clip(1 - nearest, 0, 1), 0.0)),
                pa.array(np.where(known, np.clip(second - nearest, 0, 1), 0.0)),
            ], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))
