"""Hot keys, repeated and null ids, empty tables, clashing columns, small tables; against plain versions written here."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import ann, bpe, components, decontamination, jaccard_join, language_id, licenses, quality, suffix_dedup, token_counts, toxicity
from quarry.llm.shingles import exact_set, similar


def stock_of(rng, n=400, letters="abcdefghijkl"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def smallest_reachable(rows):
    """Class of each row (id, text): the smallest id reachable by links or by a shared id."""
    sets = [exact_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][0] is not None and rows[i][0] == rows[j][0]) or (None not in (rows[i][0], rows[j][0]) and 4 * len(sets[i]) <= 5 * len(sets[j]) + 4 and similar(sets[i], sets[j])):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [None if d is None else least[root(i)] for i, (d, _) in enumerate(rows)]


def test_join_of_a_passage_that_hundreds_share(spark, monkeypatch):
    """One passage is most of each text, so its keys have all documents, in many components; blocks are small."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "SPARSE", 4)
    rng = random.Random(11)
    stock = stock_of(rng)
    passage = [rng.choice(stock) for _ in range(60)]
    rows = []
    for i in range(500):
        own = [rng.choice(stock) + str(i) for _ in range(14)]
        rows.append((i, " ".join([*own, *passage])))
        if i % 10 == 0:  # a near copy, and a copy
            rows.append((1000 + i, " ".join([*own[1:], *passage])))
            rows.append((2000 + i, " ".join([*own, *passage])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))[0].collect()}
    assert got == {d: c for (d, _), c in zip(rows, smallest_reachable(rows))}
    assert len(set(got.values())) > 400


def test_join_of_groups_whose_first_texts_link_with_few(spark, monkeypatch):
    """Two large groups share half of their words. The smallest ids of each link with few others, of which about half link: links are verified by the document, not by the pair."""
    asked, verified = [], jaccard_join._verified

    def counted(pairs, docs):
        asked.append(pairs.count())
        return verified(pairs, docs)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    rng = random.Random(15)
    stock = stock_of(rng, 3000)
    shared, *groups = ([rng.choice(stock) for _ in range(60)] for _ in range(3))
    rows = []
    for i in range(240):
        words = shared + groups[i % 2]
        n = 7 if i < 20 else rng.choice([1, 2, 3])  # replaced words in a row
        at = rng.randrange(len(words) - n)
        rows.append((i, " ".join([*words[:at], *(f"own{i}x{k}" for k in range(n)), *words[at + n :]])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))[0].collect()}
    assert got == {d: c for (d, _), c in zip(rows, smallest_reachable(rows))}
    assert sum(asked) < 6 * len(rows)


def test_join_of_long_texts(spark):
    rng = random.Random(12)
    stock = stock_of(rng, 3000)
    base = [rng.choice(stock) for _ in range(4000)]
    rows = []
    for i, share in enumerate((0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)):
        rows.append((i, " ".join(rng.choice(stock) + "x" if rng.random() < share else w for w in base)))
    rows += [(20 + i, " ".join([rng.choice(stock) for _ in range(3500)] + base[:500])) for i in range(4)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert got == {d: (len(exact_set(t)), c) for (d, t), c in zip(rows, smallest_reachable(rows))}


def test_join_of_repeated_and_null_ids(spark):
    rng = random.Random(13)
    stock = stock_of(rng)
    a, b, c = (" ".join(rng.choice(stock) for _ in range(40)) for _ in range(3))
    rows = [(5, a), (3, a), (3, b), (9, b), (9, b), (7, c), (None, a), (None, None), (1, None), (2, ""), (4, c.upper())]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, component long")
    classes, links = jaccard_join.join(frame)
    want = sorted(((d, len(exact_set(t)), k) for (d, t), k in zip(rows, smallest_reachable(rows))), key=str)
    assert sorted(map(tuple, classes.collect()), key=str) == want
    joined = {frozenset(r) for r in links.collect()}
    assert frozenset((3, 5)) in joined and frozenset((4, 7)) in joined


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(path).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    with pytest.raises(RuntimeError):
        components.components(path, rounds=1)


def test_work_folder_is_shared(monkeypatch):
    from quarry.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.work_dir(Session())


@pytest.mark.parametrize("n", [1, 2, 5, 11, 50, 98, 99])
def test_nearest_of_small_tables(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 8))
    v = spark.createDataFrame([(i, row.tolist(), "z") for i, row in enumerate(x)], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.search(v, v.where("vec_id % 25 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [i for i in range(0, n, 25) if n > 1]
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(n), d))[: min(10, n - 1)]
        assert sorted(found) == list(range(1, len(best) + 1))
        if n <= 11:
            assert [found[k + 1][0] for k in range(len(best))] == best.tolist()
        assert all(abs(s - d[i]) < 1e-12 for i, s in found.values())


def test_nearest_of_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [0.9, 0.5]), (1, [1.0, 0.5]), (2, [5.0, 5.0]), (3, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (4, [float("inf"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(v, v.where("vec_id = 0")).collect()]
    assert [(q, k, i) for q, k, i, _ in sorted(got)] == [(0, 1, 1), (0, 2, 2)]
    assert abs(dict((i, s) for _, _, i, s in got)[1] - np.hypot(0.1, 0.5)) < 1e-12


def test_token_counts_of_long_words():
    source = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    t, own = Tokenizer.from_str(source), token_counts.counter(source)
    rng = random.Random(3)
    cases = ["a" * 2000, "ab" * 1500 + " end", "x " + "abcabd" * 700, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)), "é" * 1500 + "a" * 700, "!" * 900 + "?" * 900, "in" * 600 + " " + "ing" * 600, "9" * 700]
    assert own.count(cases).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in cases]
    for x in cases:
        assert own.count([x]).tolist() == [len(t.encode(x, add_special_tokens=False).ids)]


def test_emissions_fit(monkeypatch):
    source = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    machine = token_counts.Counter(source).machine
    machine.states.append(((0, -1, 500),))
    with pytest.raises(ValueError, match="emits"):
        machine.columns_of(np.array([97]))
        machine.add(len(machine.states) - 1, 97)


def test_shorter_span_and_word_rule(spark):
    """A span of 200 bytes finds all repeats; the word rule leaves short ones; whole characters go, and input U+FFFD stays."""
    rng = random.Random(14)
    stock = stock_of(rng, letters="abcdé")
    long, short = (" ".join(rng.choice(stock) for _ in range(n)) for n in (70, 40))
    own = lambda: " ".join(rng.choice(stock) + rng.choice("xyz") for _ in range(60))
    texts = [own() + " " + long + " � " + own(), own() + "ü" + long + own(), own() + " " + short + " " + own(), own() + " " + short + own(), "é" * 150 + "a", "é" * 150 + "b", None, "", own()]
    frame = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    raws = [(t or "").encode() for t in texts]
    for words in (0, 50):
        got = {r["doc_id"]: r for r in suffix_dedup.dedup(frame, 200, ("source",), words).collect()}
        seen = {}
        for r in raws:
            for i in range(len(r) - 199):
                seen[r[i : i + 200]] = seen.get(r[i : i + 200], 0) + 1
        for d, r in enumerate(raws):
            cut = np.zeros(len(r), bool)
            for i in range(len(r) - 199):
                if seen[r[i : i + 200]] > 1:
                    cut[i : i + 200] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(int), [0]])))
            runs = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if not words or b - a >= 400 or len(r[a:b].split()) > words]
            left, at = [], 0
            for a, b in runs:
                left.append(r[at:a])
                at = b
            left.append(r[at:])
            assert (got[d]["kept"], got[d]["n_spans"], got[d]["carried"]["source"]) == (b"".join(left), len(runs), f"s{d}")
            assert got[d]["kept_text"] == (None if texts[d] is None else "".join(x.decode("utf-8", "ignore") for x in left))
        assert "�" in got[0]["kept_text"] and (got[2]["n_spans"] == 0) == bool(words)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, h string, score string, line int, gram string, key string, k1 long, hash long, row_key string"


def test_extra_columns_null_ids_and_repeats(spark):
    """Each operator over rows that repeat, have null ids or texts, and columns named like its own."""
    rng = random.Random(15)
    stock = stock_of(rng)
    text = " ".join(rng.choice(stock) for _ in range(120))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text), (3, None), (4, ""), (5, " "), (6, "Released under the MIT License."), (7, "x" * 30_000)]
    frame = spark.createDataFrame([(d, t, "en", "s", 1, "h", "1", 1, "g", "k", 1, 1, "r") for d, t in rows], CLASH)
    none = frame.limit(0)
    items = spark.createDataFrame([(1, " ".join(text.split()[20:60]), "x")], "item_id long, text string, doc_id string")
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (4, 1, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    byte, word = (bpe.read_text(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = sorted((d for d, _ in rows), key=str)
    for found in (lambda f: bpe.decode(bpe.encode(f, byte), byte), lambda f: token_counts.count_tokens(f, word), lambda f: suffix_dedup.dedup(f), lambda f: jaccard_join.join(f)[0],
                  lambda f: language_id.predict(f, language_id.fit(f)), lambda f: toxicity.score(f, toxicity.fit(f, toxicity.learning_labels(labels))), lambda f: quality.score(f, quality.fit(f, quality.learning_labels(labels)))):
        assert sorted((r["doc_id"] for r in found(frame).collect()), key=str) == ids
        assert found(none).count() == 0
    t = Tokenizer.from_str(byte)
    assert sorted((r["ids"], str(r["doc_id"])) for r in bpe.encode(frame, byte, block_bytes=300).collect()) == sorted((t.encode(x or "", add_special_tokens=False).ids, str(d)) for d, x in rows)
    assert {tuple(r) for r in decontamination.find(frame, items).collect()} == {(d, 1, *decontamination.contained(items.first()["text"], x)) for d, x in rows if d in (1, 2)}
    assert {(r["doc_id"], r["family"]) for r in licenses.scan(frame).collect()} == {(6, "mit")} and licenses.scan(none).count() == 0


def test_out_of_place_distance_by_hand(spark):
    """Scores against the plain definition: sum of rank differences, the profile's length for n-grams it lacks."""
    rng = random.Random(16)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, make("abc", 25), "aa") for i in range(10)] + [(20 + i, make("bcd", 25), "bb") for i in range(10)] + [(40, "ab cd dcba", None), (41, "zz", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.fit(frame, 50)
    for r in language_id.predict(frame, profiles, 50).collect():
        _, codes, counts, _ = language_id._grams([next(t for d, t, _ in rows if d == r["doc_id"])])
        ranked = [c for _, c in sorted(zip((-counts).tolist(), codes.tolist()))][:50]
        far = {}
        for lang, profile in profiles.items():
            place = {g: i for i, g in enumerate(profile)}
            far[lang] = sum(abs(place[c] - i) if c in place else 50 for i, c in enumerate(ranked)) / (len(ranked) * 50)
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - far[best])) < 1e-9


def test_licence_scores_by_hand(spark):
    """Probabilities of the native plan against the classifier's own, line by line; families it wasn't trained on the words of stay unknown."""
    model = licenses.train()
    lines = [t for x in licenses.TEMPLATES.values() for t in x] + [t for _, t in licenses.HELD] + licenses.OTHERWISE + ["licence", "Copyright 2020", "free software for all"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    for i, t in enumerate(lines):
        z = model.logits(t)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = model.families[int(z.argmax())] if p.max() >= licenses.LEAST else licenses.UNKNOWN
        if family != licenses.UNKNOWN or any(c in t.lower() for c in licenses.CUES):
            assert got[i]["family"] == family and abs(got[i]["probability"] - p.max()) < 1e-5
        else:
            assert i not in got
    told = [(f, got[len([t for x in licenses.TEMPLATES.values() for t in x]) + i]["family"]) for i, (f, _) in enumerate(licenses.HELD) if f != "unknown" and len([t for x in licenses.TEMPLATES.values() for t in x]) + i in got]
    assert sum(a == b for a, b in told) >= 0.8 * len([f for f, _ in licenses.HELD if f != "unknown"])


def test_pipeline_by_hand(spark, tmp_path):
    """run() against plain versions of the stages behind the first, over null and repeated ids, copies, passages and benchmark items."""
    import corpus_pipeline as p

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*p.COLUMNS).where("length(text) between 300 and 3000").orderBy("doc_id").limit(60).collect()
    texts = [r["text"] for r in base]
    passage = " ".join(texts[0].split()[:60])
    rows = [tuple(r) for r in base]
    rows[11] = (None, *rows[11][1:])
    rows += [(None, texts[5] + " " + passage, "en", "s", 1), (None, texts[6] + " " + passage, "en", "s", 1), (base[7]["doc_id"], texts[8] + " " + texts[9], "en", "s", 1), (10**6, texts[10], "en", "t", 1), (10**6, texts[10], "en", "t", 1)]
    item = " ".join(texts[20].split()[:30])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = sorted((tuple(r) for r in p.identify_language(spark, docs, str(tmp_path)).collect()), key=str)
    # near copies: one row of each class, the smallest id, null last
    alone = list(dict.fromkeys(kept))
    label = smallest_reachable([(i, r[1]) for i, r in enumerate(alone)])
    first = {}
    for r, c in zip(alone, label):
        first[c] = min(first.get(c, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    # repeats
    raws = [(r, r[1].encode()) for r in first.values()]
    seen = {}
    for _, raw in raws:
        for i in range(len(raw) - p.REPEAT_BYTES + 1):
            seen[raw[i : i + p.REPEAT_BYTES]] = seen.get(raw[i : i + p.REPEAT_BYTES], 0) + 1
    left = []
    for r, raw in raws:
        cut = np.zeros(len(raw), bool)
        for i in range(len(raw) - p.REPEAT_BYTES + 1):
            if seen[raw[i : i + p.REPEAT_BYTES]] > 1:
                cut[i : i + p.REPEAT_BYTES] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(int), [0]])))
        out, at = "", 0
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= 400 or len(raw[a:b].split()) > p.REPEAT_WORDS:
                out += raw[at:a].decode("utf-8", "ignore")
                at = b
        out += raw[at:].decode("utf-8", "ignore")
        if out.strip():
            left.append((r[0], out))
    # benchmark, tokens
    left = [(d, t) for d, t in left if 100 * decontamination.contained(item, t)[0] < 80 * decontamination.contained(item, t)[1]]
    t = Tokenizer.from_str(bpe.read_text(public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted((str(d), t.encode(x, add_special_tokens=False).ids) for d, x in left)
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want and all(r["decodes"] for r in got)
    assert "None" in {d for d, _ in want} and len(want) < len(kept)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0




@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_risk_and_gradient_by_hand(shift):
    """The non-negative risk by its definition, row by row, and its gradient by differences."""
    rng = np.random.default_rng(4)
    zp, zu, prior = rng.standard_normal(7) + shift, rng.standard_normal(9) - shift, 0.6
    loss = lambda z, y: float(np.log(1 + np.exp(-z if y else z)))

    def plain(p, u):
        negative = sum(loss(z, 0) for z in u) / len(u) - prior * sum(loss(z, 0) for z in p) / len(p)
        return -negative if negative < 0 else prior * sum(loss(z, 1) for z in p) / len(p) + negative

    value, gp, gu = toxicity.risk(zp, zu, prior)
    assert abs(value - plain(zp, zu)) < 1e-12
    for x, g, at in ((zp, gp, 0), (zu, gu, 1)):
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-6
            a, b = ((plain(x + s, zu) if at == 0 else plain(zp, x + s)) for s in (step, -step))
            assert abs((a - b) / 2e-6 - g[i]) < 1e-6


def test_trees_by_hand():
    """Flat arrays against a walk from node to node, and the first split against the best of all splits."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (300, 3)).astype(np.float32)
    y = ((x[:, 1] > 11) ^ (rng.random(300) < 0.1)).astype(float)
    trees = quality.boost(x, y, rounds=6, depth=3)
    for i in range(60):
        z = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            z += v[node]
        assert abs(trees.scores(x[i : i + 1])[0] - 1 / (1 + np.exp(-z))) < 1e-9
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2)
    best = max(((gain(x[:, j] > t) + gain(x[:, j] <= t), j, t) for j in range(3) for t in range(20) if 12 <= (x[:, j] > t).sum() <= 288))
    assert (trees.feature[0, 0], int(trees.threshold[0, 0])) == best[1:]
    assert quality.boost(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]
