"""Approximate nearest neighbours by a forest of sorted hash strings.

Each tree hashes a vector to a string of 32 bits, the signs of random
projections of the centred vector, and keeps the strings of all vectors in a
sorted array. A query descends in every tree to the longest prefix that its
string shares with the array; then all trees ascend together, a prefix bit at a
time, until the matched ranges hold enough entries of other rows, and at least k
different candidates, or all there are. Exact distances rank the candidates.

The forest is an index table of shards: every vector is in one shard, which
holds its vectors and the sorted arrays of all trees. Queries come in blocks of a
fixed number, each sent to all shards; each shard returns its nearest, and the
ten best remain. The candidates of a shard are at least ``share`` of its vectors:
recall then doesn't fall as the table grows.

Cases: vectors that are null, empty, zero, or hold null or non-finite parts, or
whose length isn't the most frequent one (the smallest such, on a tie), take no
part; nor do null ids. A query's own row is no candidate; of rows that repeat an id
the smallest vector counts. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows;
empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

TREES = 64
BITS = 32
#: Vectors of a shard; queries of a block.
SHARD, BLOCK = 8192, 4096
#: Share of a shard's entries that the ascent gathers at least, over all trees, as a multiple of the shard's vectors.
SHARE = 0.65
SEED = 11


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TREES * BITS, dim))


def strings(x: np.ndarray, centre: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Hash strings as numbers, a row for each tree."""
    out = np.empty((TREES, len(x)), np.uint32)
    for at in range(0, len(x), 2048):
        signs = ((x[at : at + 2048] - centre) @ normals.T > 0).reshape(-1, TREES, BITS)
        out[:, at : at + 2048] = (np.packbits(signs, axis=2).view(">u4")[:, :, 0]).T
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where((F.size("vector") > 0) & F.coalesce(sound, F.lit(False)) & F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def build(vectors: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """The index table (shard, ids, vectors, sorted strings, their order), the dimension, and the centre."""
    v = usable(vectors)
    sizes = v.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None, 0, np.zeros(0)
    dim, n = sizes[0]["d"], sizes[0]["count"]
    v = v.where(F.size("vector") == dim)
    centre = np.array(v.agg(*(F.avg(F.col("vector")[i]) for i in range(dim))).first())
    shards = max(1, -(-n // SHARD))
    shared = vectors.sparkSession.sparkContext.broadcast((centre, planes(dim)))  # fixed by the dimension

    def pack(group: pa.Table) -> pa.Table:
        centre, normals = shared.value
        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids)
        x = np.concatenate([c.flatten().to_numpy() for c in group.column("vector").chunks]).reshape(len(ids), -1)[order]
        keys = strings(x, centre, normals)
        ranks = np.argsort(keys, axis=1, kind="stable").astype(np.uint16)
        keys = np.take_along_axis(keys, ranks.astype(np.int64), axis=1)
        return pa.table({"ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "strings": pa.array([keys.tobytes()], pa.binary()), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    dealt = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    # hashing deals shards of about SHARD vectors; ranks of 16 bits allow eight times as many
    return written(dealt.groupBy("shard").applyInArrow(pack, "ids binary, vectors binary, strings binary, ranks binary")), dim, centre


def search_shard(ids: np.ndarray, x: np.ndarray, keys: np.ndarray, ranks: np.ndarray, qid: np.ndarray, q: np.ndarray, hashed: np.ndarray, k: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and the ids and distances of its nearest candidates in the shard."""
    n = len(ids)
    wanted = max(4 * k, int(np.ceil(share * n)))
    # for every prefix length, where the range of each query's prefix begins and ends in each tree
    low = np.empty((BITS + 1, TREES, len(qid)), np.int32)
    high = np.empty_like(low)
    for t in range(TREES):
        for length in range(BITS + 1):
            cover = np.uint64((1 << (BITS - length)) - 1)
            first = hashed[t].astype(np.uint64) & ~cover
            low[length, t] = np.searchsorted(keys[t], first.astype(np.uint32), side="left")
            high[length, t] = np.searchsorted(keys[t], (first | cover).astype(np.uint32), side="right")
    # descend: the longest prefix with a match in some tree; ascend together until enough entries of other rows match
    own = np.isin(qid, ids)  # a query's own string is a match at every length
    found = (high - low).sum(axis=1) - TREES * own
    level = np.where(found[::-1] >= np.minimum(wanted, (n - own) * TREES), 1, 0).argmax(axis=0)
    level = BITS - level
    norms = (x * x).sum(axis=1)
    for i in range(len(qid)):
        at, length = np.zeros(0, np.int64), int(level[i])
        while True:
            a, b = low[length, :, i], high[length, :, i]
            seen = np.zeros(n, bool)
            for t in range(TREES):
                seen[ranks[t, a[t] : b[t]]] = True
            at = np.flatnonzero(seen)
            at = at[ids[at] != qid[i]]
            if len(at) >= min(k, n - own[i]) or not length:  # at length 0 all rows match
                break
            length -= 1
        if len(at) > 4 * k:  # a cheap form of the distance leaves few for the exact one
            rough = norms[at] - 2 * (x[at] @ q[i])
            cut = np.partition(rough, 2 * k)[2 * k]
            at = at[rough <= cut + 1e-9 * (1 + abs(cut) + norms[at].max() + (q[i] ** 2).sum())]
        exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[at], exact))[:k]
        yield int(qid[i]), ids[at][best], exact[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the nearest found of each row of ``queries``."""
    spark = vectors.sparkSession
    index, dim, centre = build(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    asked = written(usable(queries).where(F.size("vector") == dim))
    total = asked.count()
    blocks = max(1, -(-total // BLOCK))
    out = None
    for b in range(blocks):  # a block is sent to all shards: BLOCK vectors at most
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas().sort_values("vec_id")
        q = np.array(part["vector"].tolist(), dtype=np.float64).reshape(len(part), dim)
        shared = spark.sparkContext.broadcast((part["vec_id"].to_numpy(dtype=np.int64), q, strings(q, centre, planes(dim)) if len(q) else np.zeros((TREES, 0), np.uint32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, hashed = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], np.int64)
                    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                    keys = np.frombuffer(row["strings"], np.uint32).reshape(TREES, -1)
                    ranks = np.frombuffer(row["ranks"], np.uint16).reshape(TREES, -1)
                    for at in range(0, len(qid), 256):
                        rows = list(search_shard(ids, x, keys, ranks, qid[at : at + 256], q[at : at + 256], hashed[:, at : at + 256], k, share))
                        who = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(np.concatenate([r[1] for r in rows]), pa.int64()), pa.array(np.concatenate([r[2] for r in rows]), pa.float64())], names=["query_id", "vec_id", "score"])

        found = index.mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionAll(found)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
