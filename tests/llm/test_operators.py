"""The operators on small tables, against plain versions written here."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import ann, bpe, decontamination, jaccard_join, language_id, licenses, quality, suffix_dedup, token_counts, toxicity
from quarry.llm.shingles import exact_set, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, block string"


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    stock = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    passage = words(rng, 150, stock)
    out = [None, "", " \n ", "one two", "one two", "1 2 3 !", "ñandú Σοφία ΑΣ 中文 😀", "a <|endoftext|> b<|startoftext|>", "x" * 3000, "ab" * 900]
    out += [words(rng, rng.randrange(3, 400), stock) for _ in range(40)]
    out += [words(rng, 50, stock) + " " + passage + " " + words(rng, 50, stock) for _ in range(6)]
    base = words(rng, 200, stock).split()
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, out[12], out[12], words(rng, 30_000, stock)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 1, "b") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, texts, none):
    source = bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_str(source)
    coded = bpe.encode(docs, source, block_bytes=20_000)
    got = {r[0]: (r[1], r[2]) for r in bpe.decode(coded, source).collect()}
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == {k: t.decode(v, skip_special_tokens=False) for k, v in want.items()}
    assert bpe.encode(none, source).count() == 0


def test_token_counts(docs, texts, none):
    source = bpe.read_text(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_str(source)
    got = {r[0]: tuple(r[1:]) for r in token_counts.count_tokens(docs, source).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i] == (len((x or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(none, source).count() == 0


def test_transducer_on_random_strings():
    source = bpe.read_text(public_tokenizers.path("word_bpe_49k.json"))
    t, own = Tokenizer.from_str(source), token_counts.counter(source)
    rng = random.Random(1)
    alphabet = ["the", "'s", "'re", "'", "''", " ", "\n", "1", "ñ", "Σ", "İ", "<|endoftext|>", "中", "!", "?!", "é", "😀", "Ᲊ", "aaaa", "ing", *"abcdefghijklmnopqrstuvwxyz"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["a" * 5000, "x'" * 300]
    assert own.count(cases).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in cases]


def test_jaccard_join(docs, texts, none):
    sets = [exact_set(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(10):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if similar(a, b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join(docs)[0].collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert jaccard_join.join(none)[0].count() == 0


def test_join_keys_lose_no_pair():
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 100, 257, 600]:
        for _ in range(6):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            gone = int(rng.integers(0, n // 5 + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)])
            if 100 * (n - gone) < 80 * (n + len(b) - (n - gone)):
                continue
            who = np.repeat([0, 1], [len(a), len(b)])
            w, k = jaccard_join.keys(who, np.concatenate([a, b]), np.array([len(a), len(b)]), np.sort(a[: n // 2]))
            assert set(k[w == 0].tolist()) & set(k[w == 1].tolist())


@pytest.mark.parametrize("large", [20_000, 1])
def test_suffix_dedup(docs, texts, none, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    span = suffix_dedup.SPAN
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.dedup(docs).collect()}
    for i, r in enumerate(raws):
        cover = np.zeros(len(r) + 1, int)
        for j in range(len(r) - span + 1):
            if seen[r[j : j + span]] > 1:
                cover[j] += 1
                cover[j + span] -= 1
        cut = np.cumsum(cover)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        left = np.frombuffer(r, np.uint8)[~cut].tobytes()
        assert got[i] == (len(r), int(cut.sum()), runs, hashlib.sha256(left).hexdigest())
    assert suffix_dedup.dedup(none).count() == 0


def test_maximal_repeats(docs, texts):
    groups = {}
    for r in suffix_dedup.repeats(docs).collect():
        groups.setdefault((r["group"], r["length"]), []).append((r["doc_id"], r["start"]))
    assert groups
    for (name, length), places in groups.items():
        found = {texts[d].encode()[s : s + length] for d, s in places}
        assert len(found) == 1 and length >= suffix_dedup.SPAN and len(places) > 1
        assert hashlib.sha256(found.pop()).hexdigest() == name


def repeated_spans(raws, span):
    """Places of each string of ``span`` bytes that stands twice at least."""
    places = {}
    for d, r in enumerate(raws):
        for i in range(len(r) - span + 1):
            places.setdefault(r[i : i + span], []).append((d, i))
    return {k: v for k, v in places.items() if len(v) > 1}


@pytest.mark.parametrize("large", [20_000, 0])
def test_no_repeat_is_missing(spark, docs, texts, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng = random.Random(4)
    alone = ["".join(rng.choice("klmno pqrst") for _ in range(1500)) for _ in range(3)]
    copies = [alone[0]] * 3 + [alone[1]] * 2 + ["x" + alone[2], "x" + alone[2], "y" + alone[2] + "z"]
    raws = [(t or "").encode() for t in [*texts, *copies]]
    more = spark.createDataFrame([(len(texts) + i, t) for i, t in enumerate(copies)], "doc_id long, text string")
    groups = {}
    for r in suffix_dedup.repeats(docs.select("doc_id", "text").unionByName(more)).collect():
        groups.setdefault((r["group"], r["length"]), []).append((r["doc_id"], r["start"]))
    span = suffix_dedup.SPAN
    found = {}  # a string of ``span`` bytes and all places at which one group has it
    for (_, length), places in groups.items():
        assert len(places) == len(set(places)) > 1
        d, s = places[0]
        for i in range(length - span + 1):
            found.setdefault(raws[d][s + i : s + i + span], set()).add(tuple(sorted((d, s + i) for d, s in places)))
    want = repeated_spans(raws, span)
    assert set(found) == set(want)
    assert all(tuple(sorted(v)) in found[k] for k, v in want.items())


def test_spans_come_from_maximal_repeats(monkeypatch):
    rows = [f"{c}{'0123456789' * 5}" for c in "abc"]
    data = [x.encode() for x in rows]
    table = pa.table({"anchor": [1] * 3, "region": [1, 2, 3], "lead": pa.array([0] * 3, pa.int32()), "reach": pa.array([1] * 3, pa.int32()), "n": [1] * 3, "bytes": data})
    monkeypatch.setattr(suffix_dedup, "SPAN", 50)
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (50,))
    monkeypatch.setattr(suffix_dedup._trees, "__defaults__", (50,))
    assert suffix_dedup._mark(table).select(["first", "last"]).to_pylist() == [{"first": 1, "last": 1}] * 3
    monkeypatch.setattr(suffix_dedup, "intervals", lambda *_: ([0, 1, 2], []))
    assert not suffix_dedup._mark(table).num_rows


def test_decontamination(spark, docs, texts, none):
    items = [(1, " ".join(texts[50].split()[60:120]).upper()), (2, texts[20]), (3, "nowhere to be found in any of these"), (4, None), (5, "One, two!"), (6, ""), (None, "one two")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, item in items:
        for d, t in enumerate(texts):
            a, n = decontamination.contained(item, t)
            if i is not None and n and 100 * a >= 80 * n:
                want.add((d, i, a, n))
    assert want and {tuple(r) for r in decontamination.find(docs, frame).collect()} == want
    assert decontamination.find(none, frame).count() == 0
    assert decontamination.find(docs, frame.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 24))
    x[10] = x[20] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 24), (1200, [float("nan")] * 24), (1300, [None] * 24), (1400, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(v, v.where("vec_id % 100 = 0")).collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == list(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(found) & set(np.lexsort((np.arange(900), d))[:10].tolist()))
    assert got[0][:2] == [10, 20] and hits >= 81
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(0)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make("abcde" if i % 2 else "vwxyz", 30), "aa" if i % 2 else "zz") for i in range(60)] + [(60, None, "aa"), (61, "123 !", "aa"), (62, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.fit(frame)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(frame, profiles).collect()}
    assert all(got[i][0] == ("aa" if i % 2 else "zz") for i in range(60))
    assert got[60] == got[61] == got[62] == ("und", 0.0)
    assert language_id.predict(frame, {}).where("lang_pred <> 'und'").count() == 0


def test_quality_and_toxicity(spark):
    rng = random.Random(0)
    stock = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(400):
        t = words(rng, 40, stock)
        bad, rude = i % 4 == 0, i % 5 == 0
        rows.append((i, (t.upper() + " !!" * 30 if bad else t) + (" idiot moron" if rude else "")))
        labels.append((i, int(not bad), int(rude)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (902, None, None)], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r["predicted"] for r in quality.score(d, quality.fit(d, quality.learning_labels(lab))).collect()}
    assert sum(q[i] == (i % 4 != 0) for i in range(400)) >= 390 and len(q) == 402
    t = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, toxicity.fit(d, toxicity.learning_labels(lab))).collect()}
    assert sum(t[i] == (i % 5 == 0) for i in range(400)) >= 390 and t[900] == 0
    assert toxicity.score(d, toxicity.fit(d, lab.limit(0))).where("score > 0").count() == 0
    assert quality.score(d, quality.fit(d, lab.limit(0))).where("score <> 0.5").count() == 0


def test_licenses(spark, none):
    rows = [(1, "Intro.\nReleased under the MIT License.\nEnd"), (2, "The fishing licence costs ten pounds."), (3, "licensed under the Apache License, Version 2.0"), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["line"]): (r["family"], r["confirmed"]) for r in licenses.scan(frame).collect()}
    assert found == {(1, 2): ("mit", True), (2, 1): ("unknown", False), (3, 1): ("apache", True)}
    model = licenses.train()
    for family, templates in licenses.TEMPLATES.items():
        for x in templates:
            assert any(c in x.lower() for c in licenses.CUES)
            assert model.families[int(model.logits(x).argmax())] == family
    assert licenses.scan(none).count() == 0


def test_wrapped_and_uncued_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software, to deal in the Software\nwithout restriction."
    mpl = "This Source Code Form is subject to the\n  terms of the Mozilla Public\nLicense, v. 2.0."
    rows = [(1, f"A title\n\n \t\n{mit}\n\nThe end"), (2, "\n" + mpl), (3, "CC0 1.0 Universal"), (4, "Creative Commons BY-SA 4.0"), (5, "The cat sat\non the mat.")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add((r["line"], r["lines"], r["family"], r["confirmed"]))
    assert (4, 3, "mit", True) in got[1] and (2, 3, "mpl", True) in got[2]
    assert {x[2] for x in got[3]} == {"cc0"} and {x[2] for x in got[4]} == {"cc-by-sa"} and 5 not in got


def test_prefilter_drops_unknown_only():
    model, rng = licenses.train(), random.Random(6)
    told = set(licenses.telling(model))
    rest = [f for f in model.features if " " not in f and f not in told] + licenses.COMMON
    at = model.families.index(licenses.UNKNOWN)
    inside = [f for f in model.features if set(f.split()) <= set(rest)]
    above = np.delete(np.maximum(model.weights - model.weights[:, [at]], 0), at, axis=1)
    most = above[[model.number[f] for f in inside]].sum(axis=0) + np.delete(model.bias - model.bias[at], at)
    assert rest and (most <= 1e-9).all()
    for _ in range(300):
        assert model.logits(" ".join(rng.choices(rest, k=rng.randrange(1, 30)))).argmax() == at


def test_language_stage_rejects_foreign_texts(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    clean = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*p.COLUMNS).where("doc_id is not null and text is not null")
    short = [(10**6 + i, r["text"][:60], r["lang"], "s", 60) for i, r in enumerate(clean.where("length(text) > 200").orderBy("doc_id").limit(60).collect())]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
    code = "for i in range(len(xs)):\n    if xs[i] != ys[j]:\n        buf.append(np.zeros((n, k)))\n    kwargs['fn'] = lambda q: q.idx\n" * 4
    bad = [polish, turkish, code, *("".join(rng.choice(a) for _ in range(500)) for a in ("abcdefghijklmnopqrstuvwxyz ", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))]
    rows = short + [(2 * 10**6 + i, t, "en", "s", len(t)) for i, t in enumerate(bad)]
    docs = clean.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r["doc_id"] for r in p.identify_language(spark, docs, "").select("doc_id").collect()}
    lettered = {r["doc_id"] for r in clean.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert lettered <= kept and {r[0] for r in short} <= kept
    assert not {x for x in kept if x >= 2 * 10**6}


def test_pipeline(spark, tmp_path, texts):
    import corpus_pipeline as p

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[20])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in p.run(spark, str(tmp_path)).collect()}
    assert 20 not in got and 0 not in got and 5 not in got and len(got) > 20
