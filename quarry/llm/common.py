"""What the operators share: the shared work folder, folds, text slices."""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.scratch import removed, work_dir, written  # noqa: F401

#: Characters of text that one slice of vectorised work holds (a longer single text makes a slice of its own).
SLICE_CHARS = 300_000
#: Rows of an Arrow batch: texts are long, so a batch of the default size would be many megabytes.
BATCH_ROWS = 1000


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs``, its session set to batches of at most BATCH_ROWS rows on the way to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(docs.sparkSession.conf.get(name)) > BATCH_ROWS:
        docs.sparkSession.conf.set(name, str(BATCH_ROWS))
    return docs


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; remainder 2 is held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim  # only glibc has it
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Give freed memory back to the machine: workers are used again, and each would else hold the most that any stage took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batches: Iterator[pa.RecordBatch], *others: str, chars: int = SLICE_CHARS) -> Iterator[tuple[list[str], dict[str, list]]]:
    """Whole texts in slices of about ``chars`` characters, with other columns.

    The texts come from a column ``text``; null counts as empty. Memory is
    bounded by ``chars`` and the longest single text.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            to, total = at, 0
            while to < batch.num_rows and (to == at or total + sizes[to] <= chars):
                total += sizes[to]
                to += 1
            part = batch.slice(at, to - at)
            texts = [x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield texts, {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in others}
            at = to
            del part, texts
        del batch, column
    give_back()
