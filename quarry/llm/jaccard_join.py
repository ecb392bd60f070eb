"""N-gram Jaccard join: parity sketches, a pigeonhole join by size band, exact checks.

Two sets A and B with Jaccard similarity of at least 0.8 differ in at most
(|A| + |B|) / 9 shingles. A set of n shingles belongs to a size band (a power of
two) that fixes a number K of cells; each shingle is XORed into one cell by its
hash. A shingle that only one set has changes one cell, so the number of
differing cells bounds the symmetric difference from below. With at most D
differing cells, two sketches share some cell among any D + 1 non-empty ones
that both take first in one global order: the pigeonhole join needs those only.
The order puts cells with many shingles first, and cells all of whose shingles
are frequent ones last, which keeps join keys selective; it doesn't change the
result. Sets too close to their band's edge are in the next band as well.

Equal sets are one class, and its smallest doc_id stands for it from here on, so
copies are never paired. Documents of a join key are each paired with the
smallest that has it; pairs pass a size test, then a second parity sketch whose
Hamming distance bounds the symmetric difference, then the exact test. Sets too
large for that sketch have a third one, with a bit for every two shingles or more;
the longer of two is folded to the other's length. Links give components. Where a
key's documents are still in several components, rounds come first: each document
outside the key's largest component is paired with one of that component and one of
another, chosen by hash, and of the pairs that pass the tests the closest to each
component is verified. A large group of near copies so grows together by a few links
a document. Those then still outside are held against the others across components,
in blocks of bounded size that are dealt out over tasks, and pairs that pass the
tests are verified: no link is lost. Keys that very many documents share are found
in a sample and dealt out apart from the others; the sample doesn't change the result.

Cases: a null or empty text has an empty set and links with nothing. Fewer than
five words are one shingle. Repeated rows and ids are kept; rows of one doc_id
count as one node. Null ids get a null component. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import removed, text_slices, written
from quarry.llm.components import components
from quarry.llm.shingles import exact_set, shingles, similar
from quarry.llm.vector import mix

PERCENT = 80
#: Bits of the second sketch; a third one has half as many bits as the set has shingles, if those are more.
BITS = 1024
#: Documents of a key that one task holds against each other, about; keys that are dealt apart, at most.
BLOCK, MOST_HOT = 512, 4096
#: Rounds of chosen pairs at most, so long as comparisons are more than so many times a key's documents and a round finds over one in so many of
#: the first one's links. Keys choose by so many orders, so that a document gets a few partners from all of its keys. None of these changes the result.
ROUNDS, PATIENCE, FADED, ORDERS = 6, 8, 4, 8
#: What pairs are tested by.
TOLD = ("n", "sketch", "wide")
#: Frequent shingles are looked for in one document of so many; at most so many are told to the workers. They only order cells.
SPARSE, MOST_FREQUENT, FREQUENT = 64, 50_000, 4


def _cells(low: np.ndarray) -> np.ndarray:
    """K for a band whose smallest size is ``low``."""
    return (7 * low) // 10 + 3


def keys(who: np.ndarray, shingle: np.ndarray, size: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets: set, key. ``size``: of each set; ``frequent``: sorted hashes."""
    out_who, out_key = [], []
    n_all = size[who]
    band_all = np.floor(np.log2(np.maximum(n_all, 1))).astype(np.int64)
    hot = np.zeros(len(shingle), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingle), len(frequent) - 1)
        hot = frequent[at] == shingle
    for below in (False, True):
        if below:  # as the larger set of a pair whose smaller one is in the band below
            pick = (band_all > 0) & (4 * n_all <= 5 * ((1 << band_all) - 1))
            allowed = 2 * size // 9
        else:
            pick = np.ones(len(who), bool)
            allowed = size // 4
        if not pick.any():
            continue
        w, s, h, band = who[pick], shingle[pick], hot[pick], band_all[pick] - int(below)
        k = _cells(1 << band)
        cell = (s >> np.uint64(20)) % k.astype(np.uint64)
        place = (w.astype(np.uint64) << np.uint64(28)) | cell
        order = np.argsort(place, kind="stable")
        place, w, s, h, band, cell = place[order], w[order], s[order], h[order], band[order], cell[order]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        value = np.bitwise_xor.reduceat(mix(s), new)
        count = np.diff(np.concatenate([new, [len(w)]]))
        rare = np.logical_or.reduceat(~h, new)
        w, band, cell = w[new], band[new], cell[new].astype(np.uint64)
        key = _key(value, cell, band)
        cells_of = np.bincount(w, minlength=len(size))
        # too few cells to promise a common one: the empty cells of both sets count as well
        for i in np.flatnonzero((cells_of <= allowed) & (cells_of > 0)).tolist():
            own = w == i
            empty = np.setdiff1d(np.arange(_cells(1 << band[own][0]), dtype=np.uint64), cell[own])
            out_who.append(np.full(len(empty), i)), out_key.append(_key(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), band[own][0])))
        taken = np.lexsort((key, -np.minimum(count, 255), ~rare, w))
        w, key = w[taken], key[taken]
        rank = np.arange(len(w)) - (np.cumsum(cells_of) - cells_of)[w]
        keep = rank <= allowed[w]
        out_who.append(w[keep]), out_key.append(key[keep])
    if not out_who:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_who), np.concatenate(out_key)


def _key(value: np.ndarray, cell: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mix(value + mix(cell + (band.astype(np.uint64) << np.uint64(40)) + np.uint64(1)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that stand in many documents: a hint for the order of cells, of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in text_slices(batches):
            found, n = np.unique(shingles(texts)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SPARSE)) == 0)
    counted = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


SETS = "doc_id long, n long, one long, two long, sketch array<long>, wide array<long>, keys array<long>"


def sketches(who: np.ndarray, shingle: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the sets' shingles by hash, as 64-bit numbers; where each set's begin, and the end."""
    starts = np.concatenate([[0], np.cumsum(bits)])
    there = bits[who] > 0
    who, shingle = who[there], shingle[there]
    place = starts[who] + (shingle & (bits[who] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(place, minlength=starts[-1]) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64), starts // 64


def sets(docs: DataFrame) -> DataFrame:
    """A row for each document: size of its set, two 64-bit digests of the set, sketches, join keys."""
    texts = _texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts))  # MOST_FREQUENT numbers at most

    def listed(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, other in text_slices(batches, "doc_id"):
            who, shingle = shingles(texts)
            m = len(texts)
            size = np.bincount(who, minlength=m)
            one, two = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
            if len(first):
                one[who[first]] = np.bitwise_xor.reduceat(mix(shingle), first)
                two[who[first]] = np.add.reduceat(mix(shingle ^ np.uint64(0xA5A5)), first)
            sketch, starts = sketches(who, shingle, np.full(m, BITS))
            wanted = 1 << np.ceil(np.log2(np.maximum(size / 2, 1))).astype(np.int64)
            wide, ends = sketches(who, shingle, np.where(wanted > BITS, wanted, 0))
            w, key = keys(who, shingle, size, shared.value)
            order = np.argsort(w, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=m))])
            yield pa.RecordBatch.from_arrays([
                pa.array(other["doc_id"], pa.int64()), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                listed(starts, sketch), listed(ends, wide), listed(offsets, key[order].view(np.int64)),
            ], names=["doc_id", "n", "one", "two", "sketch", "wide", "keys"])

    return texts.mapInArrow(run, SETS)


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts link, by the exact test. Only texts in a pair are carried further than once."""
    texts = _texts(docs).where("doc_id is not null")
    asked = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = written(texts.join(asked, "doc_id", "left_semi"))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}  # texts and sets of the pivots that came last
        for texts, other in text_slices(batches, "a", "b", "text_b"):
            ok = []
            for x, b, y in zip(texts, other["b"], other["text_b"], strict=True):
                if b not in known or known[b][0] != y:
                    if len(known) > 64:
                        known.clear()
                    known[b] = y, exact_set(y)
                ok.append(similar(exact_set(x), known[b][1], PERCENT))
            a = [v for v, k in zip(other["a"], ok, strict=True) if k]
            b = [v for v, k in zip(other["b"], ok, strict=True) if k]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = written(both.mapInArrow(run, "a long, b long").distinct())
    removed(texts)
    return found


def _apart(left: str, right: str) -> str:
    """The distance of two sketches."""
    return " + ".join(f"bit_count({left}sketch[{i}] ^ {right}sketch[{i}])" for i in range(BITS // 64))  # written out, as loops aren't compiled


def _close(left: str, right: str) -> F.Column:
    """The size test and the sketch tests: none rejects a pair that links."""

    def folded(x: str, y: str) -> str:
        return f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"

    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    x, y = f"{left}wide", f"{right}wide"
    farther = F.expr(f"aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)")
    narrow = (F.size(x) == 0) | (F.size(y) == 0)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (9 * F.expr(_apart(left, right)) <= n + m) & (narrow | (9 * farther <= n + m))


def _hits(named: DataFrame) -> DataFrame:
    """key, doc_id, pivot (the smallest doc_id of the key) of keys that several documents have."""
    listed = named.select("doc_id", F.explode("keys").alias("key"))
    some = listed.where(F.pmod(F.xxhash64("doc_id"), F.lit(SPARSE)) == 0).groupBy("key").count().where(F.col("count") >= FREQUENT)
    hot = written(some.orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key", F.lit(True).alias("hot")))
    held = listed.join(F.broadcast(hot), "key", "left").groupBy(F.when(F.col("hot"), F.col("key")).alias("key")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    known = named.sparkSession.createDataFrame([x for x in held.collect() if x["key"] is not None], "key long, low long, high long")  # MOST_HOT rows at most
    # rows of a hot key know their pivot, so they needn't meet in one task
    dealt = listed.join(F.broadcast(known), "key", "left").withColumn("part", F.when(F.col("low").isNull(), 0).otherwise(F.xxhash64("doc_id")))
    own = Window.partitionBy("key", "part")
    pivot, last = F.coalesce("low", F.min("doc_id").over(own)), F.coalesce("high", F.max("doc_id").over(own))
    return dealt.select("key", "doc_id", pivot.alias("pivot"), last.alias("last")).where("pivot < last").select("key", "doc_id", "pivot")


def _mixed(hits: DataFrame, found: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Keys whose documents are in several components, and their documents.

    The keys: key, main (the largest component), pick (a document of it), other (any component), other_pick,
    held (documents), inside (those of main). Picks are the first by a hash that changes with ``turn``.
    The documents: key, doc_id, component; of other keys as well.
    """
    rows = written(hits.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")).distinct())
    order = F.pmod("key", F.lit(ORDERS)), F.lit(turn)
    counted = rows.groupBy("key", "component").agg(F.count("*").alias("held"), F.min(F.struct(F.xxhash64("doc_id", *order).alias("at"), "doc_id")).alias("first"))
    any_one = F.struct(F.xxhash64("component", *order).alias("at"), "component", F.col("first.doc_id").alias("pick"))
    keyed = counted.groupBy("key").agg(F.max(F.struct("held", "component", F.col("first.doc_id").alias("pick"))).alias("main"), F.min(any_one).alias("other"), F.sum("held").alias("held"), F.count("*").alias("n")).where("n > 1")
    return written(keyed.select("key", F.col("main.component").alias("main"), "main.pick", F.col("other.component").alias("other"), F.col("other.pick").alias("other_pick"), "held", F.col("main.held").alias("inside"))), rows


def _chosen(mixed: DataFrame, rows: DataFrame, stands: DataFrame) -> DataFrame:
    """Pairs (a, b) of a key's documents outside its main component with its two picks that pass the tests; for each a and component of b the closest."""
    r, k = rows.alias("r"), mixed.alias("k")
    outside = written(r.join(k, (F.col("r.key") == F.col("k.key")) & (F.col("r.component") != F.col("k.main"))).select("r.doc_id", "r.component", "k.main", "k.pick", "k.other", "k.other_pick"))
    told = [F.col("doc_id").alias("a"), F.col("component").alias("a_component")]
    pairs = outside.select(*told, F.col("pick").alias("b"), F.col("main").alias("b_component")).unionAll(outside.select(*told, F.col("other_pick").alias("b"), F.col("other").alias("b_component")))
    pairs = pairs.where("a_component <> b_component").drop("a_component").distinct()
    both = pairs.join(_side(stands, "a"), "a").join(_side(stands, "b"), "b").where(_close("a_", "b_"))
    near = both.groupBy("a", "b_component").agg(F.min(F.struct(F.expr(_apart("a_", "b_")).alias("apart"), "b")).alias("near"))
    found = written(near.select("a", F.col("near.b").alias("b")))
    removed(outside)
    return found


def _across(several: DataFrame) -> DataFrame:
    """Pairs (a, b) of a key's documents in different components that pass the tests.

    ``several``: key, doc_id, component, main (the key's largest component), blocks, n, sketch, wide.
    Of each such pair one document at least is outside the main component. A key's documents are
    in blocks, and each pair of blocks is a group of its own, so no group holds more than two blocks.
    """
    several = several.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    outside = several.where("component <> main").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    every = several.withColumn("mate", F.explode(F.expr("sequence(0, blocks - 1)")))
    told = ("doc_id", "component", "main", *TOLD)
    left = outside.select("key", F.col("block").alias("mate"), F.col("other").alias("block"), *(F.col(c).alias(f"a_{c}") for c in told))
    right = every.select("key", "mate", "block", *(F.col(c).alias(f"b_{c}") for c in told))
    met = (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("b_main")) | (F.col("a_doc_id") > F.col("b_doc_id")))
    close = left.join(right, ["key", "mate", "block"]).where(met & _close("a_", "b_"))
    close = close.select(F.greatest("a_doc_id", "b_doc_id").alias("a"), F.least("a_doc_id", "b_doc_id").alias("b"))
    return written(close.distinct())


def _side(stands: DataFrame, p: str) -> DataFrame:
    return stands.select(F.col("rep").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in TOLD))


def _grown(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components with more links."""
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, n_shingles, component_id for each row of ``docs``; and links (a, b).

    The links connect each component; a link that follows from others may be missing.
    """
    every = written(sets(docs))
    facts = written(every.drop("keys"))
    hits = written(_hits(every.where("doc_id is not null")))
    removed(every)
    named = facts.where("doc_id is not null and n > 0")
    classes = ["n", "one", "two"]
    stands = named.groupBy(*classes).agg(F.min(F.struct("doc_id", "sketch", "wide")).alias("s"))
    stands = written(stands.select(*classes, F.col("s.doc_id").alias("rep"), "s.sketch", "s.wide"))
    members = written(facts.select("doc_id", *classes).join(stands.select(*classes, "rep"), classes, "left").select("doc_id", "n", "rep"))
    hits = written(hits.join(stands.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    pairs = hits.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = written(pairs.join(_side(stands, "a"), "a").join(_side(stands, "b"), "b").where(_close("a_", "b_")).select("a", "b").distinct())
    # a doc_id that several texts have is one node, so it links their classes
    twice = members.where("doc_id is not null and rep is not null").select("doc_id", "rep").distinct()
    twice = twice.join(twice.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = _verified(pairs, docs).unionAll(twice)
    found = components(links)
    # keys whose documents are in several components still
    mixed, rows = _mixed(hits, found, 0)
    gained = []  # links of each round
    while len(gained) < ROUNDS and (not gained or FADED * gained[-1] > gained[0]):
        compared, held = mixed.agg(F.sum(F.col("held") * (F.col("held") - F.col("inside"))), F.sum("held")).first()
        if not held or compared <= PATIENCE * held:
            break
        more = _verified(_chosen(mixed, rows, stands), docs)
        gained.append(more.count())
        if not gained[-1]:
            break
        links, found = links.unionAll(more), _grown(found, more)
        removed(mixed), removed(rows)
        mixed, rows = _mixed(hits, found, len(gained))
    rows = rows.join(mixed.select("key", "main", F.ceil(F.col("held") / BLOCK).alias("blocks")), "key")
    more = _verified(_across(rows.join(stands.select(F.col("rep").alias("doc_id"), *TOLD), "doc_id")), docs)
    if more.head(1):
        links, found = links.unionAll(more), _grown(found, more)
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    return out, links.unionAll(copies).distinct()
