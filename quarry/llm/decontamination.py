"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least 80 % of its distinct five-word
shingles stand in it. Symmetric MinHash fails here, as a document can be
thousands of times longer than an item, so the sketch is one-sided: of each item
its smallest shingle hashes are kept, and documents are searched for them. Items
are partitioned by size; in the partition of items with n shingles up to m, all
but ceil(0.8 n) shingles may be missing, so a sketch of one more than that
always leaves a hit: the search loses nothing. Hits give candidates, which are
verified by exact containment of the shingles themselves.

Words are lower-cased runs of letters and digits, so case, punctuation and
spacing don't matter. An item of fewer than five words is one shingle of its
whole sequence, and documents are searched for sequences of such a length too.

Documents are first held against a bit table of sketch prefixes whose size is
fixed; what passes meets the sketches in a shuffled join, so the benchmark may be
of any size.

Cases: null or wordless items and texts match nothing; null ids match nothing.
Repeated rows count once. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_slices, written
from quarry.llm.shingles import WIDTH
from quarry.llm.unicode_classes import LETTER, NUMBER
from quarry.llm.vector import group_of, join, kinds, prefix_hashes, runs, span_hashes

PERCENT = 80
#: Bits of a hash that address the bit table: 2**22 bits, half a megabyte, whatever the benchmark's size.
PREFIX = 22
_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def sequence_hashes(texts: list[str], widths: list[int], whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word sequences of the given widths: text, hash; and words of each text.

    With ``whole_if_short``, a text of fewer than WIDTH words has its whole sequence.
    """
    points, starts = join([x.lower() for x in texts])
    kind = kinds()[points]
    a, b = runs((kind == LETTER) | (kind == NUMBER))
    owner = group_of(a, starts)
    word = span_hashes(prefix_hashes(points), a, b)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    at = np.arange(len(word))
    prefix = prefix_hashes(word)
    who, hashes = [], []
    for width in widths:
        begin = at[at - first[owner] + width <= count[owner]] if len(at) else at
        who.append(owner[begin]), hashes.append(span_hashes(prefix, begin, begin + width))
    if whole_if_short:
        short = np.flatnonzero((count > 0) & (count < WIDTH))
        who.append(short), hashes.append(span_hashes(prefix, first[short], first[short] + count[short]))
    w, h = np.concatenate(who), np.concatenate(hashes)
    order = np.lexsort((h, w))
    w, h = w[order], h[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]) if len(w) else np.zeros(0, bool)
    return w[new], h[new], count


def exact_shingles(text: str | None) -> list[tuple[str, ...]]:
    words = _WORDS.findall((text or "").lower())
    if len(words) < WIDTH:
        return [tuple(words)] if words else []
    return sorted(set(zip(*(words[i:] for i in range(WIDTH)))))


def contained(item: str | None, text: str | None) -> tuple[int, int]:
    """How many distinct shingles of the item stand in the text, of how many."""
    wanted = exact_shingles(item)
    if not wanted:
        return 0, 0
    words = _WORDS.findall((text or "").lower())
    there = set(zip(*(words[i:] for i in range(len(wanted[0])))))
    return sum(x in there for x in wanted), len(wanted)


def sketches(items: DataFrame) -> DataFrame:
    """item_id, width, hash: the sketch of each item. A partition holds items of up to a power of two of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "item_id"):
            who, hashes, words = sequence_hashes(texts, [WIDTH], True)
            n = np.bincount(who, minlength=len(texts))
            most = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)  # the partition's largest size
            size = np.minimum(n, most - -(-PERCENT * most // 100) + 1)  # at least one more than may be missing
            rank = np.arange(len(who)) - (np.cumsum(n) - n)[who]  # hashes of an item ascend
            keep = rank < size[who]
            ids = pa.array(other["item_id"], pa.int64()).take(pa.array(who[keep]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.minimum(words, WIDTH)[who[keep]].astype(np.int32)), pa.array(hashes[keep].view(np.int64))], names=["item_id", "width", "hash"])

    texts = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "item_id long, width int, hash long").distinct()


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_common, n_item: each document with each item that it contains."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketch = written(sketches(items.withColumnRenamed("item_text", "text")))
    # the bit table is put together by the executors; the driver gets its pieces, half a megabyte in all
    place = F.expr(f"shiftrightunsigned(hash, {64 - PREFIX}) + 1")
    pieces = sketch.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    table = np.zeros((1 << PREFIX) // 8, np.uint8)
    for x in pieces:
        at = (x["piece"] - 1) * len(x["bits"])
        table[at : at + len(x["bits"])] = np.frombuffer(x["bits"], np.uint8)
    widths = sorted({x["width"] for x in sketch.select("width").distinct().collect()} | {WIDTH})
    shared = spark.sparkContext.broadcast((table, widths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, widths = shared.value
        bits = np.unpackbits(packed, bitorder="little").view(bool)
        for texts, other in text_slices(batches, "doc_id"):
            who, hashes, _ = sequence_hashes(texts, widths, False)
            hit = bits[(hashes >> np.uint64(64 - PREFIX)).astype(np.int64)]
            ids = pa.array(other["doc_id"], pa.int64()).take(pa.array(who[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes[hit].view(np.int64))], names=["doc_id", "hash"])

    hits = texts.mapInArrow(run, "doc_id long, hash long")
    pairs = written(hits.join(sketch.select("item_id", "hash"), "hash").select("doc_id", "item_id").distinct())
    both = pairs.join(items, "item_id").join(texts, "doc_id").select("doc_id", "item_id", "item_text", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "doc_id", "item_id", "item_text"):
            rows = [(d, i, *contained(item, text)) for d, i, item, text in zip(other["doc_id"], other["item_id"], other["item_text"], texts, strict=True)]
            rows = [r for r in rows if r[3] and 100 * r[2] >= PERCENT * r[3]]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_common", "n_item"])

    return both.mapInArrow(verify, "doc_id long, item_id long, n_common long, n_item long").distinct()
