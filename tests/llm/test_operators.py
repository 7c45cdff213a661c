"""The corpus operators against brute force, and their defined results for odd inputs."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fillwatch.llm import chat, common, decontam, embeddings, licenses, linededup, mixing, nearcopies, quality, simhash, substrings, toxicity
from fillwatch.llm.queries import ORACLES, QUERIES
from tests.sql_compare import assert_same, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
have_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't there")


def docs(spark, texts, ids=None, sources=None, extra=True):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", (sources[k] if sources else f"src{k % 4}"), len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"fp": F.lit("x"), "g": F.lit(1), "h": F.lit(2), "words": F.lit("w"), "key": F.lit(3), "component": F.lit(4)}) if extra else df


WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@have_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], duck(SF))


ODD = ["", None, " \n\t ", "a", "word " * 30_000, "ab" * 20_000, "same text here", "same text here"]


@pytest.mark.parametrize("op", ["leaks", "scan", "near", "lines", "mix", "cut", "tox", "qual"])
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_inputs(spark, op, kind):
    df = docs(spark, ODD)
    nulls = df.withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    df = df.union(df.where("doc_id < 6")).union(nulls).coalesce(2) if kind == "odd" else df.where("false")
    bench = spark.createDataFrame([(1, "word " * 20), (2, None), (None, "a b c d e f g"), (3, "")], "item_id long, text string")
    model = toxicity.Model(b" base text ", b" insult base text ", (-3.0, 1.0, 0.0, 0.0))
    out = {
        "leaks": lambda: decontam.leaks(df, bench), "scan": lambda: licenses.scan(df), "near": lambda: simhash.near_duplicates(df), "lines": lambda: linededup.line_dedup(df, 2), "mix": lambda: mixing.mix(df),
        "cut": lambda: substrings.remove_repeats(df), "tox": lambda: toxicity.classify(df, model), "qual": lambda: quality.classify(df, np.zeros((1 << quality.BITS) + 1)),
    }[op]().collect()
    n = df.count()
    if op == "leaks":
        assert {r.doc_id for r in out} == ({4} if kind == "odd" else set())
    elif op == "mix":
        assert len(out) <= n
    else:
        assert len(out) == n


# 1: decontamination
def test_masks_miss_no_window():
    for bad in itertools.combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.NEEDED):
        assert any(not any(p + o in bad for o in m) for m in decontam.MASKS for p in range(decontam.WINDOW - m[-1])), bad


def plain_leaks(texts, items):
    """{(doc, item): [windows, best, first word]}"""
    want, words = {}, lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = {j: words(t) for j, t in items.items()}
    items = {j: it for j, it in items.items() if len(it) >= decontam.SHORTEST}
    for i, t in texts.items():
        w = words(t)
        where = {}
        for p, x in enumerate(w):
            where.setdefault(x, []).append(p)
        for j, it in items.items():
            span = min(len(it), decontam.WINDOW)
            need = decontam.NEEDED if len(it) >= decontam.WINDOW else len(it)
            for shift in {p - k for k, x in enumerate(it) for p in where.get(x, ())}:
                same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(it)]
                for s in range(len(it) - span + 1):
                    if (n := sum(same[s : s + span])) >= need:
                        a = want.setdefault((i, j), [0, 0, 10**9])
                        want[i, j] = [a[0] + 1, max(a[1], n), min(a[2], max(0, shift + s))]
    return want


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = [prose(rng, n) for n in (15, 30, 57, 7, 4)]
    texts = []
    for _ in range(60):
        w = prose(rng, 60).split()
        it = rng.choice(items).split()
        for _ in range(rng.randrange(6)):
            it[rng.randrange(len(it))] = "changed"
        k = rng.randrange(50)
        w[k : k + len(it)] = it
        texts.append(" ".join(x.upper() + "," if rng.random() < 0.2 else x for x in w))
    want = plain_leaks(dict(enumerate(texts)), dict(enumerate(items)))
    got = {(r.doc_id, r.item_id): [r.n_windows, r.best, r.first_word] for r in decontam.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert want and got == want


def test_repeated_rows_leak_once(spark):
    item = prose(random.Random(3), 20)
    rows, bench = docs(spark, [item, item, item + " more", item], [5, 5, 5, 6]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(tuple(r) for r in decontam.leaks(rows, bench).collect()) == [(i, 1, 6, 15, 0) for i in (5, 6)]


# 2: quality
def plain_ngrams(text):
    """Buckets of a text, by the definition and with Python's integers."""
    full, a, b = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    mixed = lambda h: (h := ((h ^ (h >> 31)) * a) & full) ^ (h >> 29)
    kind = lambda c: 3 if c > 127 else 1 if chr(c).isdigit() else 2 if chr(c).isupper() else 3 if chr(c).islower() else 16 + c if c > 32 else 5
    words, shapes, out = [], [], []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text):
        word = mixed(sum(mixed(((c + 32 if 64 < c < 91 else c) + 1) * b + k * a & full) for k, c in enumerate(w)) & full)
        runs = [k for k, _ in itertools.groupby(map(kind, w))]
        shape = sum(mixed(k * b + min(i, 6) * a & full) for i, k in enumerate(runs)) + (b if words and words[-1] == word else 0)
        words.append(word)
        shapes.append(mixed(shape & full))
    for i, (w, s) in enumerate(zip(words, shapes, strict=True)):
        w1, s1, s2 = (words[i - 1] if i else 1), (shapes[i - 1] if i else 1), (shapes[i - 2] if i > 1 else 2)
        kinds = [w, w * a + w1, s * b, (s * b + s1) * a, ((s * a + s1) * b + s2) * a]
        out += [mixed((v + k) & full) >> (64 - quality.BITS) for k, v in enumerate(kinds)]
    return out


def plain_ftrl(rows, z, n):
    """FTRL-Proximal over (text, label) rows, from a state of two dicts; returns the new state."""
    z, n = dict(z), dict(n)
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for text, y in rows:
        grams = plain_ngrams(text)
        x = {i: grams.count(i) * quality.SCALE / len(grams) for i in set(grams)} | {1 << quality.BITS: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g, was = (p - y) * v, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / quality.ALPHA * w[i]
            n[i] = was + g * g
    return z, n


def test_ngrams_by_definition():
    rng = random.Random(2)
    texts = ["One two  two", "", "x", "A1b2--C3 !!?? éà É", " lead\ttab", *("".join(rng.choices("aB3 .-é\n", k=rng.randrange(40))) for _ in range(40))]
    h, n = quality.ngrams([t.encode() for t in texts])
    assert [list(p) for p in np.split(h, np.cumsum(n)[:-1])] == [plain_ngrams(t.encode()) for t in texts]


def test_quality_fit_by_definition(spark):
    """Shards, epochs and averages of the whole fit, and the scores, against a plain version."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 12)) + (" GOOD!" if i % 3 else " bad 7") for i in range(40)] + [None, ""]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id = 3"))  # repeated rows count once
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(41)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(df, labels, "quality", quality.MOST).select(F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS)).alias("s"), F.xxhash64("doc_id", F.lit(1)).alias("o"), "text", "y", "doc_id").collect()
    assert sorted(r.doc_id for r in rows) == [i for i in range(41) if zlib.crc32(str(i).encode()) % 5]
    z, n = {}, {}
    for epoch in range(quality.EPOCHS):
        got = []
        for s in range(quality.SHARDS):
            part = sorted((r for r in rows if r.s == s), key=lambda r: r.o, reverse=epoch % 2 == 1)
            if part:
                got.append(plain_ftrl([(r.text.encode(), r.y) for r in part], z, n))
        z, n = ({i: sum(state[k].get(i, 0.0) for state in got) / quality.SHARDS for i in {i for state in got for i in state[k]}} for k in (0, 1))
    weights = quality.fit(df, labels)
    want = {i: -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2) for i in z if abs(z[i]) > quality.L1}
    assert set(np.flatnonzero(weights)) == set(want) and all(math.isclose(weights[i], v, rel_tol=1e-9) for i, v in want.items())
    for r in quality.classify(df, weights).collect():
        grams = plain_ngrams((texts[r.doc_id] or "").encode())
        v = sum(want.get(i, 0.0) for i in grams) * quality.SCALE / max(1, len(grams)) + want.get(1 << quality.BITS, 0.0)
        assert math.isclose(r.score, 1 / (1 + math.exp(-v)), rel_tol=1e-9) and r.predicted == (r.score >= 0.3)


@have_data
@pytest.mark.parametrize(("name", "column"), [("op2_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    """The mean of the shares of each label that are told right; predicting one of them always gives 0.5."""
    d = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, d)
    assert [r.held_out for r in out.orderBy("doc_id").limit(50).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]
    got = out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "predicted", column).collect()
    right = lambda y: np.mean([r.predicted == y for r in got if r[column] == y])
    assert all(0 <= r.score <= 1 for r in got) and (right(1) + right(0)) / 2 >= 0.7


# 3: embeddings
def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1])], int(i % 3)) for i in range(150)]
    rows += [(150 + i, rows[0][1], 0) for i in range(30)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (204, [1.0, None], 0), (205, [], 0), (206, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    near, link = {r[0]: {r[0]} for r in rows if r[0] is not None}, {}
    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            u, v = (np.array(x[1], np.float32).astype(float) for x in (a, b))
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                link[a[0]], link[b[0]] = link.get(a[0], 0) + 1, link.get(b[0], 0) + 1
                s = near[a[0]] | near[b[0]]
                for x in s:
                    near[x] = s
    want = {i: (link.get(i, 0), min(s), min(s) == i) for i, s in near.items()}
    for tile, kind in ((16, "int"), (4, "string")):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df.withColumn("label", F.col("label").cast(kind)), tile=tile).collect()}
        assert got.pop(None) == (0, None, False)
        assert got == want
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_far_out_numbers_and_labels(spark):
    x = [1.0, 2.0, 2.0]
    rows = [(i, [v * s for v in x], "a/b") for i, s in enumerate((1e200, 1e-300, 1.0, 8e307))] + [(9, x, "a"), (10, [1.0, -1.0, 0.0], "a/b")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {i: (3, 0) for i in range(4)} | {9: (0, 9), 10: (0, 10)}
    big = spark.createDataFrame([(1, x, 1 << 40), (2, x, 1 << 40), (3, x, 1)], "vec_id long, embedding array<double>, label long")
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicates(big).collect()} == {1: 1, 2: 1, 3: 3}


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(x)
    rough = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(rough - x @ x.T) <= e[:, None] + (1 + e)[:, None] * e[None, :] + 1e-12).all()


# 4: repeated substrings
@pytest.mark.parametrize("seed", range(2))
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcé \n", k=rng.choice([49, 50, 51, 120, 400]))) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(pool), "".join(rng.choices("abcdé", k=30))]) for _ in range(rng.randrange(1, 8))) for _ in range(30)] + ["xy" * 300, "xy" * 80, "xyz" * 90, None, ""]
    ids = rng.sample(range(100), len(texts))
    first = {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = {}
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs(spark, texts, ids).repartition(3)).collect()}
    assert got == want


def test_hot_anchors_and_colliding_hashes_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    part = lambda k: "".join(rng.choices("abcdefgh", k=k))
    p = part(90)
    rows = docs(spark, [f"{part(60)}{p}{part(rng.randrange(60))}" for _ in range(60)], rng.sample(range(100), 60)).repartition(5)
    want = sorted(map(tuple, substrings.remove_repeats(rows).collect()))
    assert sum(r[2] for r in want) >= 59 * 90
    for hot in (0, 3):
        numbered = substrings._numbered(rows, "doc_id", "text")
        runs = {r.key: sorted(r.runs) for r in substrings.repeated(numbered, hot).collect()}
        got = {r.key: substrings.cut(bytes(r.t), np.array(runs.get(r.key, []), np.int64)) for r in numbered.collect()}
        assert sorted((k, hashlib.sha256(t).hexdigest(), n) for k, (t, n) in got.items()) == [(r[0], r[4], r[3]) for r in want]
    buf = np.frombuffer((p[:60] + p[:60] + p[30:]).encode(), np.uint8)
    at, doc = np.r_[np.arange(11), np.arange(60, 71), np.arange(120, 131)], np.r_[np.full(11, 5), np.full(11, 3), np.full(11, 1)]
    want = substrings.first_docs(buf, at, doc)
    assert list(want[:11]) == [3] * 11 and list(want[11:22]) == [3] * 11 and list(want[22:]) == [1] * 11
    monkeypatch.setattr(substrings.Hashes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    assert list(substrings.first_docs(buf, at, doc)) == list(want)


def test_passage_twice_in_one_document_meets_another_document(spark):
    rng = random.Random(8)
    part = lambda k: "".join(rng.choices("abcdefgh", k=k))
    texts, want = [], {}
    for k in range(0, 48, 2):  # one task: an anchor of p has three strings, two of them in one document
        p, first = part(60), (k // 2) % 2
        a, b = f"{part(70)}<{p}>{part(70)}({p}){part(70)}", f"{part(70)}[{p}]{part(70)}"
        texts += [a, b][:: 1 if first else -1]
        want[k], want[k + 1] = 0, 60 if first else 120
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs(spark, texts).coalesce(1)).collect()}
    assert got == want


def test_long_texts_are_cut_without_losing_windows(spark, monkeypatch):
    rng = random.Random(5)
    a = "".join(rng.choices("abcdefgh", k=5000))
    got = {}
    for size in (1 << 20, 300):
        monkeypatch.setattr(substrings, "BATCH_BYTES", size)
        rows = []
        for doc, t in enumerate([a, "x" * 200 + a[1000:3000] + "y" * 200]):
            rows += [substrings.sample([p[0]], np.array([doc]), np.array([0]), np.array([p[3]]))[0] for p in substrings._pieces(doc, 0, t.encode())]
        x = substrings.join(rows)
        got[size] = sorted((d, p + k) for d, p, r in zip(x.doc, x.pos, x.run, strict=True) for k in range(r))
    assert got[300] == got[1 << 20] and len(got[300]) == 5000 - 49 + 2400 - 49


def test_log_index_levels_grow_geometrically():
    index, rng = substrings.LogIndex(), np.random.default_rng(1)
    for d in range(40):
        t = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
        index.add(*substrings.sample([t], np.array([d]), np.array([0])))
        sizes = [len(k) for k, _ in index.levels]
        assert all(a > 2 * b for a, b in itertools.pairwise(sizes)) and all((k[1:] > k[:-1]).all() for k, _ in index.levels)
    assert len(index.levels) <= 8


# 5: licences
def test_license_places(spark):
    t = ["Licensed CC-BY 4.0, cc by cc by", "GNU General\nPublic license. All rights  reserved; all rights", "cc x by", None]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs(spark, t)).collect()}
    assert got == {0: (9, 3, 1, 7, "cc-by"), 1: (9, 2, 1, 4, "gpl,reserved"), 2: (3, 0, None, None, ""), 3: (0, 0, None, None, "")}


def test_notices_are_scored_by_relative_position(spark):
    notice = licenses.MORE["mit"][0]
    words = notice.split()
    t = [notice, f"x {notice} y {notice}", " ".join(reversed(words)), f"Permission is hereby granted, free of charge, {' '.join(words[:6])}", notice.replace("person", "robot"), "charge", None, "permission is hereby granted free"]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs(spark, t)).collect()}
    assert got[0] == got[1] == ("mit", 1.0) and got[4][0] == "mit" and 0.8 < got[4][1] < 1 and got[3][0] == "mit" and got[3][1] < got[4][1]
    assert got[2][0] == got[5][0] == got[6][0] == got[7][0] == "" and got[2][1] < 0.2 and got[6][1] == 0


# 6: SimHash
def plain_fingerprint(text):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, 300) for _ in range(20)] + ["", None, "one", "one two", "", "A b\x0bC d"]
    for t in texts[:10]:
        w = t.split()
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    fps = [plain_fingerprint(t or "") for t in texts]
    comp = {i: {i} for i in range(len(texts))}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            s = comp[i] | comp[j]
            for x in s:
                comp[x] = s
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", min(comp[i])) for i in comp}


def test_ball_links_are_complete(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(120):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(4)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted({f - (1 << 64) * (f >> 63) for f in fps})
    comp = {f: {f} for f in fps}
    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            s = comp[a] | comp[b]
            for x in s:
                comp[x] = s
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {f: min(s) for f, s in comp.items() if len(s) > 1}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7: toxicity
def test_windows_cover_the_whole_text():
    rng = random.Random(0)
    for t in [b"", b" ", b"x" * 500, prose(rng, 500).encode(), "é".encode() * 200]:
        assert b"".join(toxicity.windows(t)) == b" ".join(t.lower().split()) and all(len(w) <= toxicity.WINDOW + 1 for w in toxicity.windows(t))


def test_toxic_dictionaries_by_definition(spark):
    """Telling strings and pieces against plain counts, scores against plain compression, on texts with a planted word."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(30, 90)) + (" zqxblarg you " if i % 4 == 0 else " ") + prose(rng, 20) for i in range(160)] + [None, "", "zqxblarg"]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id in (0, 4)"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(df, labels, "toxic", {1: 20, 0: 60})
    have = [(r.text, r.y) for r in rows.collect()]
    assert sorted(y for _, y in have) == [0] * 60 + [1] * 20
    grams = lambda t: {b[k : k + 8] for b in [" ".join(t.lower().split()).encode()] for k in range(len(b) - 7)}
    count = lambda y: Counter(g for t, k in have if k == y for g in grams(t))
    t, o = count(1), count(0)
    want = {g for g, k in t.items() if k >= toxicity.LEAST and (k + 0.5) / 20 >= toxicity.LIFT * (o[g] + 0.5) / 60}
    known = toxicity.telling(rows)
    assert want and {int(x).to_bytes(8, "little", signed=True) for x in known} == want
    pieces = {p for text, k in have if k for p in toxicity.toxic_pieces(text.encode(), known)}
    assert pieces and all(b"zqxblarg" in p for p in pieces)
    model = toxicity.fit(df, labels)
    assert b"zqxblarg" in model.toxic and b"zqxblarg" not in model.ordinary and model.toxic.endswith(model.ordinary)
    out = {r.doc_id: r for r in toxicity.classify(df, model).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].predicted == (i % 4 == 0) for i in held) and {out[i].predicted for i in held} == {0, 1}
    assert (out[160].predicted, out[161].predicted) == (0, 0)
    size = lambda d, w: len(toxicity._compressor(d).compress(w))
    for i in [*held[:6], 160, 162]:
        d = sorted((size(model.ordinary, w) - size(model.toxic, w) for w in toxicity.windows((texts[i] or "").encode())), reverse=True)
        f = [1.0, d[0], sum(d[:3]), math.log(len(d))] if d else [1.0, 0.0, 0.0, 0.0]
        assert math.isclose(out[i].score, 1 / (1 + math.exp(-max(-30, min(30, np.dot(f, model.weights))))), rel_tol=1e-9)


def test_no_labels_scores_low(spark):
    df = docs(spark, ["some text", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.classify(df, toxicity.fit(df, none)).collect())
    assert len(quality.classify(df, quality.fit(df, none)).collect()) == 2


# 8: chat
def test_escaping_round_trip():
    for t in ["", "<|im_end|>", "\\", "<\\|", "<", "\\n", "a\nb", "<|im_start|>user\n", "\\\\<|", "<<|"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape(chat.escape(t, True)) == t
        assert chat.parse(chat.segment(t, t)[0] + chat.segment("assistant", t)[0]) == [(t, t), ("assistant", t)]


def test_read_back_of_odd_texts(spark):
    odd = ["", "<|im_end|>", "\\", "<\\|", "<", "\\n", "a\nb", "<|im_start|>user\n", "\\\\<|", "<<|", "\\\\n", "é\\|\U0001f600"]
    rows = [(k, i, r, t) for k, (r, u) in enumerate(itertools.product([*odd, "assistant"], [odd])) for i, t in enumerate(u)]
    turns, packed = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.read_back(chat.attention(turns, packed)).collect():
        role = rows[r.conv_id * len(odd)][2]
        loss = "".join(odd) if role == "assistant" else ""
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(odd), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for t in odd).encode()).hexdigest()


def test_long_conversations_with_shared_beginnings(spark):
    """Depth-first order over many partitions, and tables that grow with the turns, not their square."""
    rng = random.Random(6)
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t}" + (f" of {c % 9}" if t >= (c % 5) * 20 else "")) for c in range(40) for t in range(rng.choice([3, 60, 200]))]
    turns, packed = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert turns.agg(F.sum(F.length("path"))).first()[0] == 16 * len(rows)
    nodes, end, open_ = {r.node: r for r in packed.collect()}, 0, []
    assert set(nodes) == {r.node for r in turns.select("node").collect()} and sum(r.n_convs for r in nodes.values()) == len(rows)
    check_attention(chat.attention(turns, packed).collect(), nodes)
    for r in sorted(nodes.values(), key=lambda r: r.start):  # a node follows its parent or a finished subtree of it
        assert r.start == end
        del open_[r.depth :]
        assert (open_[-1] if open_ else "") == r.parent and len(open_) == r.depth
        open_.append(r.node)
        end += r.n_tokens


def check_attention(chats, nodes):
    """Intervals and position ids of each chain against a walk from the leaf up to the root of the emitted tree."""
    by_start = {r.start: r for r in nodes.values()}
    for r in chats:
        seen, node = set(), by_start[r.spans[-1].start]
        while node:
            seen |= set(range(node.start, node.start + node.n_tokens))
            node = nodes.get(node.parent)
        assert seen == {p for x in r.intervals for p in range(x.start, x.start + x.length)}
        assert all(a.start + a.length < b.start for a, b in itertools.pairwise(r.intervals))
        assert [s.position for s in r.spans] == list(itertools.accumulate((s.n_tokens for s in r.spans[:-1]), initial=0))


def test_no_conversations(spark):
    turns, packed = chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert packed.count() == 0 and chat.read_back(chat.attention(turns, packed)).count() == 0


def test_prefix_tree(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "x"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (None, 0, None, None), (4, 1, "b", "t"), (4, 1, "a", "t"), (4, None, "z", "")]
    turns, packed = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)))
    nodes = {r.node: r for r in packed.collect()}
    assert len(nodes) == 8 and sum(r.n_convs for r in nodes.values()) == len(rows)
    end = 0
    for r in sorted(nodes.values(), key=lambda r: r.start):  # no gaps, each after its parent
        assert r.start == end and (not r.parent or nodes[r.parent].start < r.start)
        assert r.position == (nodes[r.parent].position + nodes[r.parent].n_tokens if r.parent else 0)
        end += r.n_tokens
    spans = {r.conv_id: r for r in chat.attention(turns, packed).collect()}
    assert [s.seg for s in spans[4].spans] == [chat.segment(r, t)[0] for r, t in (("z", ""), ("a", "t"), ("b", "t"))]
    back = {r.conv_id: r for r in chat.read_back(chat.attention(turns, packed)).collect()}
    assert (back[2].n_turns, back[2].loss_chars, back[2].turns_sha256) == (3, 2, hashlib.sha256(b"user\nhi\nassistant\nno\nuser\nx\n").hexdigest())
    check_attention(chat.attention(turns, packed).collect(), nodes)


# 9: lines
def test_sketch_band_and_exact_counts(spark):
    rows = [f"common\nline {i}\n  common  \n\nrare" if i < 9 else f"line {i}\nother" for i in range(30)]
    df = docs(spark, rows, sources=[f"s{i}" for i in range(30)])
    out = {r.doc_id: r for r in linededup.line_dedup(df, 10).collect()}
    assert out[5].n_removed == 0 and out[20].kept == "line 20" and out[9].kept == "line 9\nother"
    out = {r.doc_id: r for r in linededup.line_dedup(df, 9).collect()}
    assert out[5].kept == "line 5\n" and out[0].n_removed == 0


def test_lines_without_ids_stay_if_no_other_has_them(spark):
    rows = ["all\nnone"] * 3 + ["all"] * 2
    out = linededup.line_dedup(docs(spark, rows, [None, None, None, 4, 5], [f"s{i}" for i in range(5)]), 3).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in out) == [(0, "none")] * 3 + [(4, "all"), (5, "")]


# 10: mixing
def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "src0", 10), ("web", "en", "src4", 1000), ("books", "en", "src1", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 0.5, 1).collect()}
    total = 1005
    assert got["src0"] == 10 and got["src0"] + got["src4"] == round(total * 4 / 7) and abs(sum(got.values()) - total) <= 1


def plain_lines(rows, least):
    """Texts by id without the lines of many sites, for rows (id, text, site) with ids."""
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if key := line.strip(" "):
                sites.setdefault(key, set()).add(s)
                first[key] = min(i, first.get(key, i))
    gone = {k for k, v in sites.items() if len(v - {None}) >= least}
    return {i: "\n".join(x for x in (t or "").split("\n") if not (x.strip(" ") in gone and i > first[x.strip(" ")])) for i, t, _ in rows}


def test_weight_zero_gets_nothing(spark):
    rows = [("p", "a", 10.0, 1.0, 100.0), ("p", "b", 500.0, 0.0, 100.0), ("p", "c", 500.0, 3.0, 100.0), ("q", "d", 5.0, 0.0, 9.0), ("r", "e", 5.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "parent string, child string, cap double, weight double, budget double")
    assert {r.child: r.got for r in mixing.fill(df, ["parent"], ["child"]).collect()} == {"a": 10.0, "b": 0.0, "c": 90.0, "d": 0.0, "e": 5.0}


@have_data
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pipeline_stages_equal_brute_force(spark, sf, tmp_path):
    """All rows of each stage against plain Python (mixing: SQL) on the stage's own input."""
    import corpus_pipeline as P

    sf_dir = f"/root/testdata/{sf}"
    docs_in, stages = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS), dict(P.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    step = lambda name, d: common.materialise(stages[name](spark, d, sf_dir), name)
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    kept = step("toxicity", docs_in)
    scorer = toxicity.Scorer(toxicity.fit(docs_in, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert kept.columns == P.COLUMNS and texts(kept) == {i: t for i, t in texts(docs_in).items() if scorer.score((t or "").encode()) < 0.5}
    lines = step("line_dedup", kept)
    assert lines.columns == P.COLUMNS and texts(lines) == plain_lines([(r.doc_id, r.text, r.source) for r in kept.collect()], linededup.MIN_SITES)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = step("near_duplicates", lines)
    assert near.columns == P.COLUMNS and set(texts(near)) == plain_near_copies(texts(lines))
    clean = step("decontamination", near)
    bad = {i for i, _ in plain_leaks(texts(near), {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()})}
    assert clean.columns == P.COLUMNS and set(texts(clean)) == set(texts(near)) - bad
    clean.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(stages["mixing"](spark, clean, sf_dir), mixing.ORACLE, duck(str(tmp_path)))


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated ids, empty and long texts, clashing columns; and all tables empty."""
    import corpus_pipeline as P

    rng = random.Random(4)
    item, copy = prose(rng, 40), prose(rng, 60)
    rows = [(None, None, None, None, None), (None, item, "en", "src1", 1), (1, None, "en", "src1", 0), (2, "", "en", None, 0), (3, copy, "en", "src2", 5), (4, copy + " more", None, "src3", 5), (5, item + " tail", "en", "src1", 1), (5, "other " + prose(rng, 30), "en", "src1", 1), (6, "word " * 20_000, "en", "src1", 1), (7, prose(rng, 30), "de", "src2", 1), (7, prose(rng, 30), "de", "src2", 1), (8, prose(rng, 90) + " " + prose(random.Random(9), 20), "de", "src2", 1)]
    bench = [(1, item), (None, prose(random.Random(9), 20)), (3, None), (4, "")]
    for name, df in {
        "documents": spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("row", "_key", "_t", "toxicity", "words", "fp")}), "benchmark": spark.createDataFrame(bench, "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int"),
    }.items():
        df.write.parquet(f"{tmp_path}/odd/{name}.parquet")
        df.where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
    d = spark.read.parquet(f"{tmp_path}/odd/documents.parquet").select(*P.COLUMNS)
    for name, f in P.STAGES[:-1]:
        d = common.materialise(f(spark, d, f"{tmp_path}/odd"), name)
    assert sorted((r.doc_id or 0) for r in d.collect()) == [0, 1, 2, 3, 5, 6, 7, 7] and not any(item in r.text for r in d.collect())
    assert {r.doc_id for r in P.run(spark, f"{tmp_path}/odd").collect()} <= {None, 1, 2, 3, 5, 6, 7}


def plain_near_copies(texts):
    """Ids that stay, of a dict id: text."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: {i} for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * len(sets[i] | sets[j]):
            s = comp[i] | comp[j]
            for x in s:
                comp[x] = s
    return {min(s) for s in comp.values()}


def test_overlaps_of_sets():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40))) for _ in range(30)]
    got = nearcopies.overlaps(sets[:12], sets[12:], width=7)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]).all()


@pytest.mark.parametrize("tile", [128, 5])
def test_near_copies_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([30, 80, 300])) for _ in range(25)] + ["", None, " \n", "one two", "One  TWO", "one"]
    for t in texts[:25] * 3:  # around the bound: a changed word takes up to five shingles
        w = t.split()
        for k in rng.sample(range(len(w)), rng.randrange(max(2, len(w) // 30))):
            w[k] = "changed"
        texts.append(" ".join(w))
    start = prose(rng, 60)
    texts += [f"{start} {prose(rng, 8)}" for _ in range(12)]  # not a clique: ends differ
    ids = rng.sample(range(500), len(texts))
    want = plain_near_copies(dict(zip(ids, texts, strict=True)))
    assert len(want) < len(texts) - 20
    rows = docs(spark, [*texts, texts[0], "no id", texts[1]], [*ids, None, None, ids[1]], sources=["s"] * (len(texts) + 3)).repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in nearcopies.drop_near_copies(rows).collect())
    assert [x for x in got if x[0]] == [(True, 0, "no id")]
    assert sorted(x[1] for x in got if not x[0]) == sorted([*want, *({ids[1]} & want)])
    assert nearcopies.drop_near_copies(rows.where("false")).count() == 0


def test_index_with_colliding_hashes():
    """All anchors and strings have one hash: none is settled by another's occurrence, and what isn't settled is handed on."""
    ruler = b"-" * substrings.ORDERED
    pool = [b"x" * 50, b"x" * 51, b"x" * 50 + b"\0", b"x" * 49 + b"\0", *[bytes([97 + k]) * (60 + k) for k in range(6)], *[ruler + bytes([97 + k]) * 90 for k in range(5)]]
    size = np.array([len(x) for x in pool])
    buf, at = np.frombuffer(b"".join(pool), np.uint8), np.cumsum(size) - size
    rng, index, rows, settled = np.random.default_rng(2), substrings.LogIndex(), [], []
    for _ in range(12):
        n = 60
        k, none = rng.integers(0, len(pool), n), np.zeros(n, np.uint64)
        batch = substrings.Suffixes(none, none, rng.integers(0, 30, n), k, rng.integers(0, 1000, n), size[k] - 49)  # the text number tells the string
        rows += list(zip(*(c.tolist() for c in batch), strict=True))
        settled += list(zip(*(c.tolist() for c in index.add(batch, substrings.strings_of(buf, at[k], size[k], none))), strict=True))
        for key, _ in index.levels:
            assert (key[1:] > key[:-1]).all()
    kept = list(zip(*(c.tolist() for c in index.flush()), strict=True))
    assert Counter(rows) == Counter(settled) + Counter(kept) and len({r[3] for r in settled}) > 10
    least = {}
    for _, _, doc, k, *_ in rows:
        least[k] = min(doc, least.get(k, doc))
    assert all(doc > least[k] for _, _, doc, k, *_ in settled) and {k for _, _, doc, k, *_ in kept if doc == least[k]} == set(least)


def test_one_anchor_in_many_strings():
    """Strings around one anchor are told apart by all 64 bits of their hash, however many they are."""
    n = 1 << 17
    buf = np.zeros(n * 50, np.uint8)
    buf.reshape(n, 50)[:, :4] = np.arange(n, dtype=">u4").view(np.uint8).reshape(-1, 4)
    at = np.arange(0, n * 50, 50)
    assert len(np.unique(substrings.Hashes(buf).of(at, at + 50))) == n


def test_levels_are_in_the_order_of_bytes():
    rng, index = np.random.default_rng(3), substrings.LogIndex()
    text = bytes(rng.integers(97, 100, 6000, dtype=np.uint8))
    index.add(*substrings.sample([text], np.array([1]), np.array([0])))
    (key, rows), = index.levels
    got = [text[p : p + r + 49] for p, r in zip(rows.pos, rows.run, strict=True)]
    assert got == sorted(got) and len(got) > 300


def test_anchor_with_many_bytes(spark, monkeypatch):
    """Strings around one anchor beyond the bound in bytes go window by window, with the same result."""
    texts = ["-" * n + chr(97 + k) + "=" * (200 + 7 * k) for k, n in enumerate((70, 90, 400, 1000, 5000, 60))] * 2
    want = sorted(tuple(r) for r in substrings.remove_repeats(docs(spark, texts)).collect())
    monkeypatch.setattr(substrings, "HOT_BYTES", 100)
    assert sorted(tuple(r) for r in substrings.remove_repeats(docs(spark, texts)).collect()) == want
    assert sum(r[2] for r in want) > 6000
