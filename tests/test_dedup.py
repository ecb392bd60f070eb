"""MinHash pairs and exact pairs of near copies against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import dedup


def grams(text):
    return {text[i : i + 5] for i in range(len((text or "")) - 4)} if text else set()


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé😀f") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    out = ["", None, "abcd", "abcde", "line\nbreak line\nbreak"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 400]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 10))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return [x for i, x in enumerate(out) if x not in out[:i]]


def test_pairs(spark):
    rows = list(enumerate(texts()))
    want = {}
    for i, x in rows:
        for j, y in rows:
            a, b = grams(x), grams(y)
            if i < j and a and b and len(a & b) / len(a | b) >= 0.8:
                want[i, j] = len(a & b) / len(a | b)
    df = spark.createDataFrame(rows, "doc_id long, norm string")
    got = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(df, "doc_id", "norm").collect()}
    assert got == want and len(want) > 20
    sketched = {(r.a, r.b): r.similarity for r in dedup.minhash_pairs(df, "doc_id", "norm").collect()}
    assert sketched.items() <= want.items()
    assert {p for p, s in want.items() if s >= 0.95} <= set(sketched)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, norm string")
    assert not dedup.similar_pairs(df, "doc_id", "norm").collect() and not dedup.minhash_pairs(df, "doc_id", "norm").collect()


def test_contaminated_near(spark):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(12)]
    near = [x.replace(x.split()[3], "changed") for x in items[:6]]
    half = [" ".join(x.split()[:15] + ["other"] * 15) for x in items]
    rows = list(enumerate([*near, items[7].upper() + "!", *half, near[0], None, "", "abc"])) + [(None, near[1])]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    evaluation = spark.createDataFrame([(i, x) for i, x in enumerate([*items, None, "abc"])], "item_id long, text string")
    kept = lambda x: "".join(c for c in (x or "").lower() if c.isalnum() or c == " ")
    want = [d for d, x in rows if x is not None and any(kept(x) == kept(y) or grams(kept(x)) and grams(kept(y)) and len(grams(kept(x)) & grams(kept(y))) / len(grams(kept(x)) | grams(kept(y))) >= 0.8 for y in [*items, "abc"])]
    got = [r.doc_id for r in dedup.contaminated_near(train, evaluation, "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 10
    assert not dedup.contaminated_near(train, evaluation.limit(0), "text").count()


def shuffled(spark):
    return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_disk_of_pairs(spark):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)) for _ in range(300)]
    rows = list(enumerate([*texts, *texts[:50], *(x.replace(x.split()[7], "other") for x in texts[:40])]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(x) for _, x in rows)
    for pairs in (dedup.similar_pairs, dedup.minhash_pairs):
        before = shuffled(spark)
        assert len({frozenset((r.a, r.b)) for r in pairs(df, "doc_id", "text").collect()}) >= 40
        assert shuffled(spark) - before < 4 * size
    before = shuffled(spark)
    few = spark.createDataFrame([(i, x) for i, x in enumerate(texts[:20])], "item_id long, text string")
    assert dedup.contaminated_near(df, few, "text").count() == 60
    assert shuffled(spark) - before < 4 * size


def test_copies_meet_once(spark):
    rng = random.Random(12)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    near = base.replace(base.split()[5], "other")
    rows = [(i, base) for i in range(300)] + [(i, near.upper()) for i in range(300, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    firsts = spark.createDataFrame([(base, 7), (near, 301)], "x string, id long").selectExpr("xxhash64(x) AS node", "id")
    got = dedup.similar_pairs(df, "doc_id", "text", firsts=firsts, prepare=lambda x: F.lower(x)).collect()
    assert [(r.a, r.b) for r in got] == [(7, 301)]


def test_parts_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_CHARS", 3000)
    monkeypatch.setattr(dedup, "FLUSH_KEYS", 500)
    monkeypatch.setattr(dedup, "HITS", 50)
    test_pairs(spark)
    test_contaminated_near(spark)


def shared_keys(x, y):
    keys = lambda h: {(band, int(k)) for band, key, _ in dedup.cell_keys(h, 0.8) for k in key}
    return len(keys(x) & keys(y))


def test_large_sets_seldom_meet_by_chance():
    rng = np.random.default_rng(13)
    usual = rng.integers(0, 2**64, 900, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(usual, 600, False), rng.integers(0, 2**64, 1000, np.uint64)])) for _ in range(40)]
    met = [shared_keys(x, y) for i, x in enumerate(sets) for y in sets[:i]]
    assert sum(met) < 0.05 * len(met)


def test_similar_large_sets_share_keys():
    rng = np.random.default_rng(14)
    for n in (480, 512, 600, 900, 1023, 1024, 1100, 2047, 2048, 2500, 4095, 4096, 9000, 20000):
        for other in {n, n + n // 8, n + n // 4}:
            for _ in range(6):
                common = -(-4 * (n + other) // 9)  # the least that makes 0.8
                told = rng.integers(0, 2**64, n + other - common, np.uint64)
                x, y = np.sort(told[:n]), np.sort(np.concatenate([told[:common], told[n:]]))
                assert len(y) == other and common / len(told) >= 0.8
                assert shared_keys(x, y) >= dedup.MET
    for band in range(dedup.DEALT, 24):
        for threshold in (0.5, 0.8, 0.95):
            assert dedup.layout(band, threshold)[0] >= dedup.DEALS


def test_texts_of_a_group_are_carried_once(spark):
    rng = random.Random(15)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(6000)
        texts += [" ".join(base[:i] + words(1) + base[i + 1 :]) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled(spark)
    assert dedup.similar_pairs(df, "doc_id", "text").count() == 12 * 10 * 9 // 2
    assert shuffled(spark) - before < 4 * sum(map(len, texts))


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_PAIRS", 2)
    monkeypatch.setattr(dedup, "PLACES", 3)
    test_pairs(spark)
