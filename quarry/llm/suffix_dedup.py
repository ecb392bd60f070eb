"""Suffix-array dedup: removes every byte that lies in a repeated string of ``span`` bytes, 400 unless told otherwise.

Regions. Two equal strings of ``span`` bytes choose the same anchor: the smallest
hashed string of a few dozen bytes in them, the leftmost on ties. Windows (starts
of such long strings) that share an anchor form a region; equal windows are in
regions of one anchor string, at one distance from it. So windows are compared
inside groups of regions with equal anchor strings only, over the whole corpus;
regions whose anchor string stands nowhere else are dropped at once.

Classes. Regions that are equal as a whole form a class. In a class of two or
more, every window repeats; copies meet there as one row, however many.

Suffix arrays. Where an anchor string has several classes, one region of each is
read, and regions are dealt out by anchor string. Each task sorts the suffixes
that share their first ``span`` bytes with another (the others can't matter; hashes
of those bytes find them) into a suffix array with common-prefix lengths. Its
intervals of that length and more are the repeats; a stack scan finds the tree of
deeper intervals, and an interval whose suffixes have different bytes before them
(left-extension diversity) is a maximal repeat. ``dedup`` removes what these
cover; ``repeats`` returns them with all their occurrences. Regions are compared
as strings of their own: a region's start counts as nothing before it, and bytes
behind its end belong to the next region. So a repeat longer than a region comes
in several groups, whose spans together are the whole.

Very large groups (more than ``LARGE`` classes of one anchor string) don't go to
one task: for ``dedup`` their windows are hashed, counted by hash over all tasks,
and repeated ones marked; for ``repeats`` each repeated window's suffixes go to a
task. The results are the same.

Cases: a null or empty text has no bytes, nothing to remove and one digest, that
of no bytes. Texts under ``span`` bytes lose nothing. Matches never cross documents.
Repeated rows are texts of their own, so they match each other. Null ids are kept.
Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import removed, written
from quarry.llm.vector import mix, prefix_hashes, span_hashes

SPAN = 400
#: Windows of a text that are looked at together; a longer text is taken in parts that overlap.
PART = 1_000_000
#: Classes of one anchor string that go to one task, at most; bytes of regions that a task gets, about.
LARGE, BUCKET = 20_000, 2_000_000


def regions(raw: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """For each region of one text: first window, last window, anchor's place, anchor's hash, region's hash."""
    n, gram = len(raw) - span + 1, max(1, span * 4 // 25)
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    out = []
    for at in range(0, n, PART):
        part = raw[at : at + PART + span - 1]
        prefix = prefix_hashes(part)
        grams = np.arange(len(part) - gram + 1)
        hashes = span_hashes(prefix, grams, grams + gram)
        low = np.uint64((1 << 24) - 1)
        packed = (hashes & ~low) | grams.astype(np.uint64)
        width, reach = span - gram + 1, 1
        while 2 * reach <= width:
            packed = np.minimum(packed[:-reach], packed[reach:])
            reach *= 2
        if reach < width:
            packed = np.minimum(packed[: len(packed) - (width - reach)], packed[width - reach :])
        anchor = (packed & low).astype(np.int64)  # of each window
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        place = anchor[first]
        out.append((first + at, last + at, place + at, hashes[place], span_hashes(prefix, first, last + span)))
    return tuple(np.concatenate(x) for x in zip(*out))


OCCURRENCES = "k1 long, k2 long, start int, reach int, lead int, anchor long, region long"


def occurrences(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for each region: its text (k1, k2), start, number of windows less one, bytes before the anchor, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            for k1, k2, text in rows:
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                a, b, p, anchor, region = regions(raw, span)
                if len(a):
                    held.append((np.full(len(a), k1), np.full(len(a), k2), a, b - a, p - a, anchor.view(np.int64), region.view(np.int64)))
                    size += len(a)
                if size > 200_000:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        c = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32 if i in (2, 3, 4) else np.int64)) for i, x in enumerate(c)], names=["k1", "k2", "start", "reach", "lead", "anchor", "region"])

    return texts.where(F.length("text") > 0).select("k1", "k2", "text").mapInArrow(run, OCCURRENCES)


CLASS = ["anchor", "region", "lead", "reach"]


def _representatives(chosen: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """The bytes of one region of each class: CLASS, kin, n, bytes."""
    wanted = chosen.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.struct(F.col("first.start").alias("start"), *CLASS, "kin", "n").alias("r"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("r").alias("r"))  # regions of one text
    both = wanted.join(texts.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select("text", "r")
    names = [*CLASS, "kin", "n", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py().encode()
                found = batch.column(1)[i].as_py()
                rows = [(r["anchor"], r["region"], r["lead"], r["reach"], r["kin"], r["n"], raw[r["start"] : r["start"] + r["reach"] + span]) for r in found]
                c = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=names)

    return both.mapInArrow(run, "anchor long, region long, lead int, reach int, kin long, n long, bytes binary")


def repeated_windows(anchor: np.ndarray, reach: np.ndarray, data: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of several regions that stand in two of them at least: region, window, place in the joined bytes, hash."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    sizes = reach.astype(np.int64) + span
    begin = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(data)), reach + 1)
    window = np.arange(len(number)) - np.repeat(np.cumsum(reach + 1) - (reach + 1), reach + 1)
    at = begin[number] + window
    hashes = span_hashes(prefix_hashes(joined), at, at + span) ^ mix(anchor.view(np.uint64))[number]
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    keep = order[same | np.concatenate([same[1:], [False]])]
    return number[keep], window[keep], at[keep], hashes[keep]


def intervals(suffixes: list[bytes], span: int = SPAN) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The suffix array of the given suffixes, and its common-prefix intervals (length, from, to) of at least ``span``."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    lcp = [0]
    for a, b in zip(order, order[1:]):
        x, y = suffixes[a], suffixes[b]
        m = min(len(x), len(y))
        if x[:m] == y[:m]:
            lcp.append(m)
            continue
        u, v = np.frombuffer(x, np.uint8, m), np.frombuffer(y, np.uint8, m)
        lcp.append(int((u != v).argmax()))
    found, stack = [], []
    for i in range(1, len(order) + 1):
        value = lcp[i] if i < len(order) else 0
        left = i - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            found.append((length, left, i))
        if value >= span and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    return order, found


def _diverse(suffixes: list[bytes], left: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The suffix array, and those of its intervals whose suffixes have different bytes before them, or none."""
    order, found = intervals(suffixes, span)
    order = np.array(order)
    before = left[order]
    change = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    return order, [(length, a, b) for length, a, b in found if before[a] < 0 or change[b - 1] > change[a]]


def _trees(anchor: np.ndarray, reach: np.ndarray, data: list[bytes], span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """For each repeated window that doesn't extend to the left: regions and windows, the suffix array, maximal intervals."""
    number, window, at, hashes = repeated_windows(anchor, reach, data, span)
    if not len(number):
        return
    joined = np.frombuffer(b"".join(data), np.uint8)
    previous = np.where(window > 0, joined[np.maximum(at - 1, 0)].astype(np.int64), -1)  # nothing before a region's start is in the region
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    low, high = np.minimum.reduceat(previous, first), np.maximum.reduceat(previous, first)
    ends = np.concatenate([first[1:], [len(number)]])
    for g in np.flatnonzero((low != high) | (low < 0)).tolist():  # others extend to the left
        rows = slice(first[g], ends[g])
        who, where = number[rows], window[rows]
        yield who, where, *_diverse([data[i][j:] for i, j in zip(who.tolist(), where.tolist())], previous[rows], span)


def maximal(anchor: np.ndarray, reach: np.ndarray, times: np.ndarray, data: list[bytes], span: int = SPAN) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats among regions: length and all (region, window) of each. A region that stands several ``times`` repeats itself."""
    twice = np.repeat(np.arange(len(data)), np.minimum(times, 2))
    out = []
    for who, where, order, found in _trees(anchor[twice], reach[twice], [data[i] for i in twice.tolist()], span):
        who = twice[who]
        out += [(length, sorted({(int(who[i]), int(where[i])) for i in order[a:b]})) for length, a, b in found]
    return out


def _stretches(number: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, those that overlap or touch as one: region, first and last."""
    low = np.int64((1 << 32) - 1)
    begin = number.astype(np.int64) << 32 | first
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate((number.astype(np.int64) << 32 | last)[order])
    if not len(begin):
        return begin, begin, begin
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1] + 1]))
    until = end[np.concatenate([new[1:], [len(begin)]]) - 1]
    return begin[new] >> 32, begin[new] & low, until & low


MARKED = "anchor long, region long, lead int, reach int, first int, last int"


def _arrays(group: pa.Table) -> tuple:
    get = {c: group.column(c).to_numpy() for c in (*CLASS, "n")}
    return get, group.column("bytes").to_pylist()


def _mark(group: pa.Table, span: int | None = None) -> pa.Table:
    """Windows inside the maximal repeats: each suffix is covered as far as its longest interval."""
    span = span or SPAN
    c, data = _arrays(group)
    held = [np.zeros((3, 0), np.int64)]
    for who, where, order, found in _trees(c["anchor"], c["reach"], data, span):
        longest = np.zeros(len(order), np.int64)
        for length, a, b in found:
            longest[a:b] = np.maximum(longest[a:b], length)
        there = longest > 0
        who, where = who[order][there], where[order][there]
        held.append(np.stack([who, where, where + longest[there] - span]))
    who, first, last = _stretches(*np.concatenate(held, axis=1))
    return pa.table({**{n: pa.array(c[n][who]) for n in CLASS}, "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})


def _marked_small(parts: DataFrame, buckets: int, span: int) -> DataFrame:
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).repartition(buckets, "bucket")
    return dealt.groupBy("bucket").applyInArrow(lambda group: _mark(group, span), MARKED)


def _windows(parts: DataFrame, span: int) -> DataFrame:
    """Each window of the regions: CLASS, n, window, previous (the byte before it in the region, or -1), hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                c, data = _arrays(pa.table(part))
                reach = c["reach"]
                joined = np.frombuffer(b"".join(data), np.uint8)
                begin = np.cumsum(reach + span) - (reach + span)
                number = np.repeat(np.arange(len(data)), reach + 1)
                window = np.arange(len(number)) - np.repeat(np.cumsum(reach + 1) - (reach + 1), reach + 1)
                place = begin[number] + window
                previous = np.where(window > 0, joined[np.maximum(place - 1, 0)].astype(np.int32), -1)
                hashes = span_hashes(prefix_hashes(joined), place, place + span).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[n][number]) for n in (*CLASS, "n")), pa.array(window.astype(np.int32)), pa.array(previous.astype(np.int32)), pa.array(hashes)], names=[*CLASS, "n", "window", "previous", "hash"])

    return parts.mapInArrow(run, "anchor long, region long, lead int, reach int, n long, window int, previous int, hash long")


def _marked_large(parts: DataFrame, span: int) -> DataFrame:
    """The exact way for large groups: windows counted by hash over all tasks."""
    windows = _windows(parts, span)
    twice = windows.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "hash")
    kept = windows.join(twice, ["anchor", "hash"], "left_semi")
    order = Window.partitionBy(*CLASS).orderBy("window")
    runs = kept.select(*CLASS, "window").distinct().withColumn("stretch", F.col("window") - F.row_number().over(order))
    return runs.groupBy(*CLASS, "stretch").agg(F.min("window").alias("first"), F.max("window").alias("last")).select(*CLASS, "first", "last")


GROUPS = "group string, length int, anchor long, region long, lead int, reach int, window int"


def _grouped(rows: list[tuple]) -> pa.Table:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.table([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 7, types)], names=["group", "length", *CLASS, "window"])


def _groups_small(parts: DataFrame, buckets: int, span: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        c, data = _arrays(group)
        rows = []
        for length, places in maximal(c["anchor"], c["reach"], c["n"], data, span):
            name = hashlib.sha256(data[places[0][0]][places[0][1] : places[0][1] + length]).hexdigest()
            rows += [(name, length, *(c[n][i] for n in CLASS), j) for i, j in places]
        return _grouped(rows)

    return parts.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, GROUPS)


def _groups_large(parts: DataFrame, span: int) -> DataFrame:
    """Large groups go to tasks by repeated window, each with the suffixes that begin with it."""
    windows = _windows(parts, span)
    told = windows.groupBy("anchor", "hash").agg(F.sum("n").alias("times"), F.min("previous").alias("low"), F.max("previous").alias("high"))
    starts = windows.join(told.where("times > 1 and (low < 0 or low < high)").select("anchor", "hash"), ["anchor", "hash"], "left_semi")
    suffixes = starts.join(parts.select(*CLASS, "bytes"), CLASS).withColumn("bytes", F.expr("substring(bytes, window + 1)"))

    def run(group: pa.Table) -> pa.Table:
        c, data = _arrays(group)
        window, previous = group.column("window").to_numpy(), group.column("previous").to_numpy()
        twice = np.repeat(np.arange(len(data)), np.minimum(c["n"], 2))
        order, found = _diverse([data[i] for i in twice.tolist()], previous[twice], span)
        rows = []
        for length, a, b in found:
            inside = np.unique(twice[order[a:b]]).tolist()
            name = hashlib.sha256(data[inside[0]][:length]).hexdigest()
            rows += [(name, length, *(c[n][i] for n in CLASS), window[i]) for i in inside]
        return _grouped(rows)

    return suffixes.groupBy("anchor", "hash").applyInArrow(run, GROUPS)


def _keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, a key of both (k1, k2), and the columns ``carry`` as one struct, so that no name clashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("text").isNull().alias("null"), F.struct(*carry, F.lit(0).alias("_")).alias("carried"))
    return kept.select("*", F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))


def _compared(texts: DataFrame, span: int, alone: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Occurrences whose anchor string stands twice at least; classes with how often they stand and how many their
    anchor string has; regions to compare (with those that meet copies of themselves only, if ``alone``); buckets."""
    found = written(occurrences(texts, span))
    shared = found.groupBy("anchor").count().where("count > 1").select("anchor")
    every = written(found.join(shared.repartition("anchor"), "anchor", "left_semi"))
    removed(found)
    classes = written(every.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("first")))
    kin = classes.groupBy("anchor").agg(F.count("*").alias("kin"))
    classes = written(classes.join(kin.repartition("anchor"), "anchor").where("n > 1 or kin > 1"))
    parts = written(_representatives(classes if alone else classes.where("kin > 1"), texts, span))
    size = parts.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    return every, classes, parts, max(12, -(-size // BUCKET))


def spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """k1, k2 (a text) and its repeated stretches as an array of structs (a, b) of bytes, unordered, maybe overlapping."""
    texts = _keyed(docs)
    every, classes, parts, buckets = _compared(texts, span)
    marked = _marked_small(parts.where(F.col("kin") <= LARGE), buckets, span)
    if parts.where(F.col("kin") > LARGE).head(1):
        marked = marked.unionByName(_marked_large(parts.where(F.col("kin") > LARGE), span))
    whole = classes.where("n > 1").select(*CLASS, F.lit(0).alias("first"), F.col("reach").alias("last"))
    repeated = written(whole.unionByName(marked.join(classes.where("n > 1"), CLASS, "left_anti")))
    found = every.join(repeated, CLASS).select("k1", "k2", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + span).alias("b")).alias("span"))
    return found.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Maximal repeats of regions: group, length, doc_id, start; all occurrences of each, exact copies included."""
    texts = _keyed(docs)
    every, _, parts, buckets = _compared(texts, span, alone=True)
    groups = _groups_small(parts.where(F.col("kin") <= LARGE), buckets, span)
    if parts.where(F.col("kin") > LARGE).head(1):
        groups = groups.unionByName(_groups_large(parts.where(F.col("kin") > LARGE), span))
    ids = texts.select("doc_id", "k1", "k2")
    return groups.join(every.distinct(), CLASS).join(ids, ["k1", "k2"]).select("group", "length", "doc_id", (F.col("start") + F.col("window")).alias("start"))


def _cut(raw: bytes, found: list | None, words: int = 0) -> tuple[list[bytes], int]:
    """The pieces that are left, and how many maximal runs were removed: with ``words``, those of over so many or of SPAN bytes."""
    runs: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in found or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    if words:
        runs = [(a, b) for a, b in runs if b - a >= SPAN or len(raw[a:b].split()) > words]
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return [*kept, raw[at:]], len(runs)


def dedup(docs: DataFrame, span: int = SPAN, carry: tuple[str, ...] = (), words: int = 0) -> DataFrame:
    """doc_id, kept (binary: what is left of the text's UTF-8 bytes), n_bytes, n_removed, n_spans, kept_text, carried.

    With ``words``, repeated runs of ``span`` bytes and more are removed only where
    they hold more words than that, or SPAN bytes.
    ``kept_text`` is what is left in whole characters: one that lost a byte goes
    whole; it is null where the text was. ``carried`` is a struct of the columns
    that ``carry`` names.
    """
    texts = _keyed(docs, carry)
    both = texts.join(spans(docs, span), ["k1", "k2"], "left").select("doc_id", "text", "null", "spans", "carried")
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_text", "carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, null, found in zip(part.column(1), part.column(2), part.column(3)):
                    raw = text.as_py().encode()
                    pieces, n = _cut(raw, found.as_py(), words)
                    left = b"".join(pieces)
                    # a piece ends or begins inside a character only where it was cut: the input is valid UTF-8
                    whole = None if null.as_py() else "".join(x.decode("utf-8", "ignore") for x in pieces)
                    rows.append((left, len(raw), len(raw) - len(left), n, whole))
                kept, size, gone, n, whole = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.string()), part.column(4)], names=names)

    kinds = [T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), both.schema["carried"].dataType]
    return both.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
