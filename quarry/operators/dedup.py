"""Exact and near deduplication, and decontamination against an evaluation set."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.sources.scratch import written

#: Modulus of the MinHash permutations.
PRIME = 2**31 - 1
#: Keys beyond those that a similar pair must share one of: an n-th of the set.
MORE = 16
#: Bits of a key; keys in a sorted block; characters of text whose keys make a part; meetings counted at once.
KEY_BITS, FLUSH_KEYS, PART_CHARS, HITS = 36, 2_000_000, 120_000_000, 2_000_000
#: Places where pairs are compared; pairs of one neighbourhood in a block, and blocks a side at most.
PLACES, BLOCK_PAIRS, BLOCKS = 4096, 5000, 64
#: From this band on (512 n-grams) keys are those of full cells of several deals, of which similar sets have MET in common but for a chance of exp(-SURE) e SURE.
DEALT, DEALS, MET, SURE = 9, 2, 2, 36.0


def exact_dedup(rows: DataFrame, key: Column, *best: Column) -> DataFrame:
    """Rows with ``kept``: true for the first of each key by the order ``best``, which must tell rows apart.

    The best of a key is an aggregate and a join, so that a key with very many rows
    is combined before the shuffle and can be split over tasks. Null keys are one key.
    """
    place = F.struct(*(c.alias(f"b{i}") for i, c in enumerate(best)))
    keyed = rows.withColumn("key", key)
    first = keyed.groupBy(F.col("key").alias("of")).agg(F.min(place).alias("first"))
    return keyed.join(first, F.col("key").eqNullSafe(F.col("of"))).withColumn("kept", place == F.col("first")).drop("of", "first")


def keep_first(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def gram_hashes(text: str, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct character n-grams; none for shorter texts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < n:
        return points[:0]
    h = np.zeros(len(points) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - n + 1 + i]
    h = _mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, prepare: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Pairs (a, b, similarity) of ``pairs`` whose texts in ``texts`` (id, text) are similar enough, by their n-grams.

    A pair goes to the place of its first text's smallest neighbour, so texts that are all
    similar meet at one place, and each is carried there once; large neighbourhoods are cut
    into blocks of texts, and a text is carried once for each of BLOCKS blocks of partners at most.
    """
    pairs = written(pairs.distinct())
    ends = pairs.select(F.col("a").alias("of"), F.least("a", "b").alias("label")).unionAll(pairs.select("b", F.least("a", "b")))
    pairs = written(pairs.join(ends.groupBy("of").agg(F.min("label").alias("label")), pairs["a"] == F.col("of")).drop("of"))
    large = pairs.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK_PAIRS)
    large = large.select("label", F.least(F.ceil(F.sqrt(F.col("n") / BLOCK_PAIRS)), F.lit(BLOCKS)).alias("blocks"))
    pairs = pairs.join(F.broadcast(large), "label", "left")
    block = [F.pmod(F.xxhash64(F.lit(1), x), F.coalesce("blocks", F.lit(1))) for x in ("a", "b")]
    pairs = pairs.select("a", "b", F.concat_ws(":", F.pmod(F.xxhash64(F.lit(2), "label"), F.lit(PLACES)), *block).alias("group"))
    places = pairs.select(F.col("a").alias("id"), F.col("group").alias("place")).unionAll(pairs.select("b", "group")).distinct()
    held = texts.join(places, "id").select("id", prepare(F.col("text")).alias("text"), "place")
    kind = texts.schema["id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict = {}
        for i, x in set(zip(right.column("id").to_pylist(), right.column("text").to_pylist())):
            sets.setdefault(i, []).append(gram_hashes(x or ""))
        out = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            for x in sets.get(a, ()):
                for y in sets.get(b, ()):
                    common = _common(x, y)
                    if common and common / (len(x) + len(y) - common) >= threshold:
                        out.append((a, b, common / (len(x) + len(y) - common)))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], left.schema.field("a").type), pa.array(columns[1], left.schema.field("b").type), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])

    return pairs.groupBy("group").cogroup(held.groupBy("place")).applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.8, firsts: DataFrame | None = None, prepare: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Pairs (a, b, similarity) whose sets of character 5-grams have a Jaccard similarity of ``threshold`` or more.

    A set of n n-grams belongs to a size band (a power of two) that fixes a number of cells;
    each n-gram falls into one, and a cell's key is a hash of all it holds. Similar sets differ
    in D n-grams, in D cells at most. Below 512 n-grams the first D + 1 + x cells of a set by one
    global order (fullest first) have x + 1 keys or more in common, and a pair with s common
    keys has s / parts of them in some part. From 512 on that many keys would be met by chance
    too often, with the square of the input; there the n-grams are dealt into fewer, larger cells,
    and keys are those of cells with a least number of n-grams. ``layout`` sets the numbers so
    that a similar pair shares two keys or more but for a chance under 1e-13 (less the more
    similar it is), over the hash of n-grams; nothing else can be missed, and every pair told is
    compared in full. Keys go in sorted blocks of some five bytes a key to the task of their
    band and part; what a pair shares is added up over parts. Sets with too few cells have keys
    for empty ones too. Copies meet as one text, known by 64 bits of its digest, and aren't paired
    with each other; the row that stands for a text is the one in ``firsts`` (node, id), else
    each. ``prepare`` is applied to the texts first. Texts under 5 characters, empty and null ones and null ids are in no pair.
    """
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    norm = prepare(F.col("text"))
    met = _met(named.select(F.xxhash64(norm).alias("node"), norm.alias("text"), F.lit(0).alias("side")), False, threshold)
    return _named(met, named, firsts, threshold, prepare)


def _named(met: DataFrame, named: DataFrame, firsts: DataFrame | None, threshold: float, prepare: Callable[[Column], Column]) -> DataFrame:
    """Verified pairs of ids from pairs (a, b) of nodes, digests of texts."""
    names = firsts if firsts is not None else named.select(F.xxhash64(prepare(F.col("text"))).alias("node"), "id")
    met = _renamed(met.distinct(), names).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    return _verified(met, named, threshold, prepare)


def similar_across(rows: DataFrame, others: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Pairs (a of ``rows``, b of ``others``, similarity) as in ``similar_pairs``; pairs within one table aren't compared. Repeated rows are compared once."""
    sides = [x.where(F.col(key).isNotNull()).select(F.struct(F.lit(i).alias("side"), F.col(key).alias("key")).alias("id"), F.col(text).alias("text"), F.lit(i).alias("side")) for i, x in enumerate((rows, others))]
    both = sides[0].unionAll(sides[1]).select(F.xxhash64("id").alias("node"), F.col("id.key").alias("key"), "text", "side")
    told = written(_verified(_met(both.select("node", "text", "side"), True, threshold), both.select(F.col("node").alias("id"), "text"), threshold).distinct())
    asked = told.select(F.col("a").alias("node")).unionAll(told.select("b")).distinct()
    names = written(both.select("node", F.col("key").alias("id")).join(asked, "node", "left_semi").distinct())
    return _renamed(told, names)


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` with the ids of ``names`` (node, id) in the place of nodes."""
    others = [c for c in pairs.columns if c not in ("a", "b")]
    for x in ("a", "b"):
        pairs = pairs.withColumnRenamed(x, "node").join(names, "node").withColumnRenamed("id", x).drop("node")
    return pairs.select("a", "b", *others)


def _tail(mean: float, least: int) -> float:
    """The chance that a Poisson number is ``least`` or more."""
    term = math.exp(-mean)
    under = 0.0
    for i in range(least):
        under += term
        term *= mean / (i + 1)
    return max(0.0, 1 - under)


@lru_cache
def layout(band: int, threshold: float) -> tuple[int, int, int]:
    """Deals, cells of each and the n-grams that a cell must hold to be a key, for sets of 2 ** band n-grams to twice as many.

    The n-grams that similar sets don't share, n (1 - t) / t at most, leave a cell alone with a
    chance of exp(-those / cells), whatever common ones it holds, at least 2 n t / (1 + t) in all.
    Cells hit are negatively associated, so the number of cells shared has a tail no heavier than a
    Poisson number's of the same mean, which is SURE at least. Of the layouts that reach it the one with
    fewest meetings by chance is taken, at a guess of what sets of that size have in common.
    """
    sizes = [2**band * (1 + i / 4) for i in range(5)]
    usual = min(0.7, 0.14 * 1.4 ** (band - 10))
    best = None
    for half in range(2, 40):
        cells = max(1, int(2**band / (half / 2)))
        for least in range(1, 28):
            mean = min(cells * math.exp(-n * (1 - threshold) / threshold / cells) * _tail(2 * n * threshold / (1 + threshold) / cells, least) for n in sizes)
            deals = math.ceil(SURE / mean) if mean > SURE / 20 else 99
            union = 2 * 1.4 * 2**band / (1 + usual) / cells
            chance = deals * cells * math.exp(-union * (1 - usual)) * _tail(union * usual, least)
            if deals < 99:
                best = min(best or (99, 0.0, 0, 0), (max(deals, DEALS), chance, cells, least))
    return best[0], best[2], best[3]


def _dealt(h: np.ndarray, band: int, threshold: float) -> np.ndarray:
    deals, cells, least = layout(band, threshold)
    out = []
    for i in range(deals):
        x = _mixed(h + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        cell = (((x >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
        held = np.bincount(cell, minlength=cells)
        told = np.bincount(cell, (x & np.uint64(0xFFFFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
        full = np.flatnonzero(held >= least)
        out.append(_mixed(told[full] + _mixed((full + (i << 32)).astype(np.uint64))))
    return np.concatenate(out)


def cell_keys(h: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """Band, keys and the number of them that a similar set of that band must share (0: MET of dealt cells), for each band that the set ``h`` has partners in."""
    n = len(h)
    own = n.bit_length() - 1
    band = own
    while band >= 0 and threshold * n <= 2 ** (band + 1) - 1 + 1e-6:
        if band >= DEALT:
            yield band, _dealt(h, band, threshold), 0
            band -= 1
            continue
        # as the smaller of a pair, or its like; in bands below, as the larger one
        most = int(n * (1 - threshold) / threshold + 1e-6) if band == own else int((n + min(n, 2 ** (band + 1) - 1)) * (1 - threshold) / (1 + threshold) + 1e-6)
        cells = int(2.4 * 2**band * (1 - threshold) / threshold) + 3
        cell = ((h >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        held = np.diff(np.append(first, n))
        key = _mixed(np.add.reduceat(_mixed(h), first) + _mixed(cell[first]))
        if len(key) <= most:
            empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), cell[first])
            yield band, np.concatenate([key, _mixed(_mixed(empty))]), 1
        else:
            key = key[np.lexsort((key, -held))][: most + 1 + n // MORE]
            yield band, key, len(key) - most
        band -= 1


def _packed(keys: np.ndarray, who: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted keys as differences, three bytes each and the rest compressed; two bytes say whose they are among ``docs``."""
    there, at = np.unique(who, return_inverse=True)
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    told = docs[there].tobytes()
    high = zlib.compress(steps[3:5].tobytes(), 1)
    return np.array([len(keys), len(there), len(high)], np.int64).tobytes() + told + at.astype(np.uint16).tobytes() + steps[:3].tobytes() + high


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, size = np.frombuffer(blob, np.int64, 3)
    at = 24 + 32 * m
    docs = np.frombuffer(blob, np.int64, 4 * m, 24).reshape(m, 4)
    who = np.frombuffer(blob, np.uint16, n, at).astype(np.int64)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :3] = np.frombuffer(blob, np.uint8, 3 * n, at + 2 * n).reshape(3, n).T
    steps[:, 3:5] = np.frombuffer(zlib.decompress(blob[at + 5 * n : at + 5 * n + size]), np.uint8).reshape(2, n).T
    return np.cumsum(steps.view(np.uint64).ravel()), who, docs


def _met(rows: DataFrame, across: bool, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of ``rows`` (node, text, side) that share keys enough; ``across``: of side 0 with side 1. Rows of one node have one text."""
    size = rows.agg(F.sum(F.length("text").cast("long"))).head()[0] or 0
    parts = max(1, -(-size // PART_CHARS))
    few = -(-parts // 16)  # small sets have few keys, and count them within a part

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, groups, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate(keys)
            who = np.repeat(np.arange(len(docs)), [len(k) for k in keys])
            band = np.repeat(np.array(groups, np.uint64), [len(k) for k in keys])
            group = band * np.uint64(parts) + (key & np.uint64(0xFFFFFF)) % np.where(band < DEALT, few, parts).astype(np.uint64)
            order = np.argsort((group << np.uint64(KEY_BITS)) | (key >> np.uint64(64 - KEY_BITS)))
            key, who, group = (key >> np.uint64(64 - KEY_BITS))[order], who[order], group[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(first[1:], len(group))
            told = np.array(docs, np.int64)
            blobs = [_packed(key[i:j], who[i:j], told) for i, j in zip(first, ends)]
            return pa.RecordBatch.from_arrays([pa.array(group[first].astype(np.int64)), pa.array(blobs, pa.binary())], names=["group", "blob"])

        for batch in batches:
            for i in range(batch.num_rows):
                h = gram_hashes(batch.column(1)[i].as_py() or "")
                if not len(h):
                    continue
                for band, key, shared in cell_keys(h, threshold):
                    docs.append((batch.column(0)[i].as_py(), len(h), shared, batch.column(2)[i].as_py()))
                    keys.append(key), groups.append(band)
                    total += len(key)
                if total >= FLUSH_KEYS or len(docs) > 60_000:
                    yield flush()
                    docs, keys, groups, total = [], [], [], 0
        if docs:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        got = [_unpacked(x.as_py()) for x in table.column("blob")]
        begin = np.cumsum([0, *(len(x[2]) for x in got)])
        docs = np.concatenate([x[2] for x in got])
        key = np.concatenate([x[0] for x in got])
        who = np.concatenate([x[1] + b for x, b in zip(got, begin)])
        del got
        one = np.zeros(len(docs), bool)  # copies have the same keys
        one[np.unique(docs[:, 0], return_index=True)[1]] = True
        key, who = key[one[who]], who[one[who]]
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        del order
        edge = key[1:] != key[:-1]
        alone = np.concatenate([[True], edge]) & np.concatenate([edge, [True]])
        key, who = key[~alone], who[~alone]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        if across:
            side = docs[who, 3]
            order = np.lexsort((side, np.repeat(np.arange(len(first)), count)))
            who, side = who[order], side[order]
            near = np.add.reduceat(1 - side, first) if len(first) else count
            start, many = np.repeat(first, count), np.where(side == 1, np.repeat(near, count), 0)
        else:
            start = np.arange(len(key)) + 1
            many = np.repeat(first + count, count) - start
        # entries by text, in blocks of texts with a bounded number of meetings
        order = np.argsort(who, kind="stable")
        order = order[many[order] > 0]
        own, start, many = who[order], start[order], many[order]
        reach = np.cumsum(many)
        out, at = [], 0
        while at < len(own):
            to = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + HITS))
            to = max(int(np.searchsorted(own, own[min(to, len(own) - 1)])), int(np.searchsorted(own, own[at], "right"))) if to < len(own) else len(own)
            m = many[at:to]
            ends = np.cumsum(m)
            place = np.arange(ends[-1]) + np.repeat(start[at:to] - (ends - m), m)
            met = np.repeat(own[at:to], m) * len(docs) + who[place]
            met.sort()
            new = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
            times, met = np.diff(np.append(new, len(met))), met[new]
            x, y = docs[met // len(docs)], docs[met % len(docs)]
            small, large = np.minimum(x[:, 1], y[:, 1]), np.maximum(x[:, 1], y[:, 1])
            need = np.minimum(x[:, 2], y[:, 2])
            ok = (times * few >= need) & (small >= threshold * large - 1e-6)
            a, b = y[ok, 0], x[ok, 0]
            if not across:
                a, b = np.minimum(a, b), np.maximum(a, b)
            out.append((a, b, np.where(need[ok] > 0, MET, times[ok])))
            at = to
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)])) for i in range(3)], names=["a", "b", "times"])

    blobs = rows.mapInArrow(emit, "group long, blob binary")
    met = blobs.groupBy("group").applyInArrow(meet, "a long, b long, times long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= MET).select("a", "b")


def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    a, b, out = 42, 0, []
    for _ in range(permutations):  # a linear congruential generator
        a = (a * 1103515245 + 12345) % PRIME
        b = (a * 1103515245 + 54321) % PRIME
        out.append((a or 1, b))
    x = np.array(out, np.uint64)
    return x[:, :1], x[:, 1:]


def signature(text: str, a: np.ndarray, b: np.ndarray, n: int = 5, block: int = 2048) -> np.ndarray | None:
    """Minima of (a h + b) mod PRIME over the hashes of the distinct n-grams; None if there are none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < n:
        return None
    h = np.zeros(len(points) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - n + 1 + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.unique((h ^ (h >> np.uint64(32))) % np.uint64(PRIME))
    least = np.full(len(a), PRIME, np.uint64)
    for i in range(0, len(h), block):
        least = np.minimum(least, ((a * h[i : i + block] + b) % np.uint64(PRIME)).min(axis=1))
    return least.astype(np.int64)


def minhash(rows: DataFrame, key: str, text: str, permutations: int = 128, bands: int = 16) -> DataFrame:
    """(id, band, bucket) of MinHash signatures over character 5-grams. Rows without an n-gram have none.

    128 minima for every n-gram are numpy work: as columns they outgrow compiled code.
    """
    kind, a_b, each = rows.schema[key].dataType.simpleString(), _coefficients(permutations), permutations // bands

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(x or "", *a_b) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "m"])

    sketches = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(sketch, f"id {kind}, m array<bigint>").where("m is not null")
    keys = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("m", i * each + 1, each)).alias("bucket")) for i in range(bands)]
    return sketches.select("id", F.inline(F.array(*keys)))


def minhash_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.8, firsts: DataFrame | None = None, prepare: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Pairs that share a band of MinHash and pass the exact test: all true, not all of them. ``firsts`` and ``prepare`` as for ``similar_pairs``."""
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    norm = prepare(F.col("text"))
    buckets = written(minhash(named.select(F.xxhash64(norm).alias("node"), norm.alias("text")), "node", "text").distinct())
    met = buckets.alias("x").join(buckets.alias("y"), ["band", "bucket"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return _named(met, named, firsts, threshold, prepare)


def survivors(pairs: DataFrame, priority: DataFrame) -> DataFrame:
    """Ids that go: those like a better-ranked row. ``priority``: id, rank (smaller is better)."""
    ranked = pairs.join(priority.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(priority.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    return ranked.select(F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def contaminated(train: DataFrame, evaluation: DataFrame, key: Column) -> DataFrame:
    """Training rows whose key is one of the evaluation rows'."""
    return train.withColumn("key", key).join(evaluation.select(key.alias("key")).distinct(), "key", "left_semi")


def contaminated_near(train: DataFrame, evaluation: DataFrame, text: str, threshold: float = 0.8) -> DataFrame:
    """Training rows whose normalized text is an evaluation row's, or similar to one. Each distinct text is compared once, whatever ids stand with it."""
    key = t.exact_key(F.col(text))
    own, other = (x.select(key.alias("key"), t.normalize_question(F.col(text)).alias("norm")).where("key is not null") for x in (train, evaluation))
    near = similar_across(own, other, "key", "norm", threshold).select(F.col("a").alias("key"))
    return train.withColumn("key", key).join(other.select("key").unionByName(near).distinct(), "key", "left_semi")
