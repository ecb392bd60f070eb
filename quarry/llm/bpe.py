"""BPE encoding and decoding through a table of distinct words.

Texts are split into the pre-tokenizer's words. Each block of documents keeps
its words by position as codes of a dictionary of its own. The dictionaries are
dealt out by word, so that each distinct word of the corpus is in one bucket
and is encoded once; the ids go back to their blocks and are joined to the
codes by position. Decoding joins ids to pieces of the vocabulary.

Words travel packed, a row for each block and bucket: a frequent word costs one
entry in each block that has it, so no key is hot, however skewed the words.

The input is read twice and must give the same rows both times, as files do;
blocks are named by their content, and a block that changed raises an error.

Nulls: a null text counts as empty and has no ids. A null doc_id stays null.
Repeated rows and documents are kept, each on its own. Empty tables give empty
results. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, text_slices
from quarry.llm.unicode_classes import has_disputed

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text in a block (a single longer text makes a block of its own).
BLOCK_BYTES = 4_000_000
#: Bytes of text whose words a bucket should hold, on average; buckets at least, and at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 48, 1 << 20
#: Words that the tokenizer encodes in one call.
ENCODED_AT_ONCE = 5_000
#: Documents whose pieces are put together before they leave the worker.
DECODED_AT_ONCE = 500


class Vocabulary:
    """A byte-level BPE tokenizer from the text of its .json file."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(source)
        self.special = [x["content"] for x in spec["added_tokens"]]
        del spec
        give_back()
        split = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self._special = regex.compile(f"({split})") if split else None
        self._words = regex.compile(WORDS)

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded each on its own; together, the text."""
        if self._special is not None and any(x in text for x in self.special):
            return [w for x in self._special.split(text) if x for w in ([x] if x in self.special else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and has_disputed(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self._words.findall(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def pieces(source: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id. Its size is the vocabulary's."""
    spec = json.loads(source)
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
    table = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x.tobytes() if isinstance(x, np.ndarray) else x, 3)


def _planes(codes: np.ndarray) -> bytes:
    """Codes by byte planes, which compress better than whole numbers do."""
    return _pack(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _codes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


WORDS_BY_BUCKET = "block string, bucket int, words binary"
CODES = "block string, head binary, codes binary"


def split_blocks(source, buckets: int, block_bytes: int, words_wanted: bool):
    """mapInArrow: blocks of documents; either their words by bucket, or codes by position.

    A block is named by a digest of its content, so both passes name it alike.
    """

    def close(digest, ids: list, lengths: list[int], codes: array, table: dict[str, int]) -> pa.RecordBatch:
        block = digest.hexdigest()
        words = list(table)
        home = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int32, len(words))
        order = np.argsort(home, kind="stable").astype("<u4")  # codes as they lie in the buckets
        if not words_wanted:
            by_position = _planes(np.frombuffer(codes, "<u4"))
            both = len(by_position).to_bytes(8, "little") + by_position + _planes(order)
            return pa.RecordBatch.from_pydict({"block": [block], "head": pa.array([_pack(json.dumps([ids, lengths]).encode())], pa.binary()), "codes": pa.array([both], pa.binary())})
        bounds = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(bounds)):
            own = [words[i].encode() for i in order[bounds[b] : bounds[b + 1]]]
            sizes = np.fromiter(map(len, own), "<u4", len(own))
            rows.append((block, int(b), _pack(len(own).to_bytes(4, "little") + sizes.tobytes() + b"".join(own))))
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()))], names=["block", "bucket", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        digest, ids, lengths, codes, table, held = hashlib.md5(), [], [], array("I"), {}, 0
        for texts, other in text_slices(batches, "doc_id"):
            for text, doc in zip(texts, other["doc_id"], strict=True):
                raw = text.encode()
                if held and held + len(raw) > block_bytes:
                    yield close(digest, ids, lengths, codes, table)
                    digest, ids, lengths, codes, table, held = hashlib.md5(), [], [], array("I"), {}, 0
                digest.update(f"{doc} {len(raw)} ".encode() + raw)
                words = v.words(text)
                put = table.setdefault
                codes.extend([put(w, len(table)) for w in words])
                ids.append(doc)
                lengths.append(len(words))
                held += len(raw)
        if ids:
            yield close(digest, ids, lengths, codes, table)

    return run


def encode_bucket(source):
    """Arrow groups by bucket: encodes each distinct word of the bucket once; a row of ids for each block."""

    def run(group: pa.Table) -> pa.Table:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # its threads each keep memory, and a task has one core
        v = vocabulary(source.value)
        table: dict[bytes, int] = {}
        coded: list[np.ndarray] = []
        for packed in group.column("words"):
            raw = zstandard.decompress(packed.as_py())
            n = int.from_bytes(raw[:4], "little")
            ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
            starts = [4 + 4 * n, *ends[:-1].tolist()]
            coded.append(np.fromiter((table.setdefault(raw[a:b], len(table)) for a, b in zip(starts, ends.tolist(), strict=True)), np.int64, n))
        words = [w.decode() for w in table]
        del table
        held_sizes, held_ids = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for at in range(0, len(words), ENCODED_AT_ONCE):
            ids = v.encode(words[at : at + ENCODED_AT_ONCE])
            held_sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            held_ids.append(np.fromiter((i for x in ids for i in x), "<u4", int(held_sizes[-1].sum())))
            del ids
        del words
        sizes, flat = np.concatenate(held_sizes), np.concatenate(held_ids)
        first = np.cumsum(sizes) - sizes
        out = []
        for code in coded:
            n = sizes[code]
            at = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(_pack(len(code).to_bytes(4, "little") + n.astype("<u4").tobytes() + flat[at].astype("<u4").tobytes()))
        del coded, sizes, flat, first
        give_back()
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "ids": pa.array(out, pa.binary())})

    return run


def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
    """Cogroups by block: ids joined to codes by position; a row for each document."""
    docs: list[int | None] = []
    lengths_out: list[np.ndarray] = []
    values: list[np.ndarray] = []
    by_bucket = sorted(dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True)).items())  # equal blocks have equal rows
    sizes, flat = [], []
    for _, packed in by_bucket:
        raw = zstandard.decompress(packed)
        n = int.from_bytes(raw[:4], "little")
        sizes.append(np.frombuffer(raw, "<u4", n, 4).astype(np.int32))
        flat.append(np.frombuffer(raw, "<u4", -1, 4 + 4 * n))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
    ids = np.concatenate(flat) if flat else np.zeros(0, "<u4")
    first = np.cumsum(size, dtype=np.int32) - size
    for head, both in zip(left.column("head").to_pylist(), left.column("codes").to_pylist(), strict=True):
        doc, words = json.loads(zstandard.decompress(head))
        codes, order = _two(both)
        if len(order) != len(size):
            raise ValueError("a block has other words than before: the input must give the same rows each time it is read")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)  # code -> where its ids lie
        at = place[codes]
        n = size[at]
        stop = np.cumsum(n, dtype=np.int32)
        spot = np.repeat(first[at] - (stop - n), n)
        spot += np.arange(len(spot), dtype=np.int32)
        values.append(ids[spot])
        ends = np.concatenate([np.zeros(1, np.int32), stop])[np.concatenate([[0], np.cumsum(words)]).astype(np.int64)]
        docs += doc
        lengths_out.append(np.diff(ends))
    n = np.concatenate(lengths_out) if lengths_out else np.zeros(0, np.int64)
    flat_ids = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_ids))})


def _two(both: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes by position, and codes in the order of the buckets."""
    n = int.from_bytes(both[:8], "little")
    return _codes(both[8 : 8 + n]), _codes(both[8 + n :])


def encode(docs: DataFrame, source: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The ids of each whole text: doc_id, ids array<int>.

    ``source`` is the text of the tokenizer's .json file. Strings of special
    tokens inside texts become those tokens, as the library has it by default.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(source)  # a vocabulary's size, whatever the input's
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the number of buckets follows the counted size of the texts
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(LEAST_BUCKETS, -(-held // bucket_bytes)), MOST_BUCKETS))
    # the texts are split twice, which costs less than to keep the codes in a table beside their shuffle
    words = texts.mapInArrow(split_blocks(shared, buckets, block_bytes, True), WORDS_BY_BUCKET).repartition(buckets, "bucket")
    coded = words.groupBy("bucket").applyInArrow(encode_bucket(shared), "block string, bucket int, ids binary")
    heads = texts.mapInArrow(split_blocks(shared, buckets, block_bytes, False), CODES)
    return heads.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_back, "doc_id long, ids array<int>")


def decode(coded: DataFrame, source: str, hashed: bool = False) -> DataFrame:
    """doc_id, ids and the text of ``ids``, special tokens included; null ids give null.

    Ids are joined to the pieces of the vocabulary inside each batch: the table
    of pieces is as large as the vocabulary, whatever the input, so it is sent
    to the workers. Bytes that are no UTF-8 become U+FFFD.

    ``hashed`` adds ids_sha256 of ids as little-endian 32-bit integers, from the
    worker that has them already: each Python step after another keeps a worker
    of its own at every core.
    """
    shared = coded.sparkSession.sparkContext.broadcast(pieces(source))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), *[("ids_sha256", pa.string())] * hashed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([*shared.value, None], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_AT_ONCE):
                part = batch.slice(at, DECODED_AT_ONCE)
                column = part.column(1)
                out: list[str | None] = []
                hashes: list[str] = []
                for x in column:
                    ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
                    out.append(b"".join(table[ids].tolist()).decode("utf-8", "replace") if x.is_valid else None)
                    if hashed:
                        hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), column.cast(pa.list_(pa.int32())), pa.array(out, pa.string()), *[pa.array(hashes, pa.string())] * hashed], schema=schema)
            del batch
        give_back()

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string" + ", ids_sha256 string" * hashed)


def digest(hashed: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what :func:`decode` returns with ``hashed``."""
    n = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids"))
    return hashed.select("doc_id", n.cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"))


def read_text(path: str) -> str:
    """A tokenizer's file, read where the driver runs; workers get it from the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()
