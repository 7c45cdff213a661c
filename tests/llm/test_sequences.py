"""Token files, repair of conversations and periodic runs against the library, brute force and odd inputs."""

import glob
import hashlib
import itertools
import random
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwatch.llm import periods, tokenfiles, turns
from fillwatch.llm.queries import QUERIES
from tests.llm.test_operators import SF, docs, have_data, prose

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORDS_FILE, BYTES_FILE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")

HARD = ["", None, " \n ", "Don't STOP, it's 12,345.67!", "naïve ÉCOLE Σίσυφος ΑΣ é ̈́x", "a b c\u0085d\x1ce\x0bf", "<|endoftext|> x<|startoftext|>y <|END", "End. end.. (END), e-. dogs'. it's. é. 3. <|x. 9!? ...", "日本語 テスト 한국어 🙂🙂 ‍", "x" * 5000, "la " * 40_000, "#!\"$ 2 ## ̀ ́"]


# 11: token files
library = lru_cache(tokenizers.Tokenizer.from_file)


def as_the_library(text, path, end_id=2):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, end_id]


def plain_index(rows, path):
    """(doc_id, start, n_tokens, crc) in ascending order of ids."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = as_the_library(t, path)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize(("path", "by_word"), [(WORDS_FILE, True), (WORDS_FILE, False), (BYTES_FILE, False)])
def test_token_files_equal_the_library(spark, tmp_path, path, by_word):
    ids = random.Random(1).sample(range(-50, 1000), len(HARD))
    manifest = tokenfiles.write_token_files(docs(spark, HARD, ids).repartition(3), path, f"file://{tmp_path}", length=64, by_word=by_word, shards=3)
    assert sorted(tuple(r) for r in tokenfiles.read_documents(manifest).collect()) == plain_index(zip(ids, HARD, strict=True), path)


def test_token_files_at_random(spark, tmp_path):
    """Documents and sequences at any place are those of the whole stream; masks tell ids, ends and filling; nothing is copied."""
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 40, 700])) for _ in range(300)]
    manifest = tokenfiles.write_token_files(docs(spark, texts), WORDS_FILE, f"file://{tmp_path}", length=128, shards=2).orderBy("shard").collect()
    assert sum(r.n_docs for r in manifest) == 300 and len(manifest) == 2
    seen = 0
    for r in manifest:
        f = tokenfiles.TokenFile(r.ids_path, r.docs_path)
        stream = [x for i in range(r.n_docs) for x in as_the_library(texts[seen + i], WORDS_FILE)]
        assert len(stream) == r.n_tokens and r.n_sequences == -(-r.n_tokens // 128)
        for i in rng.sample(range(r.n_docs), 20):
            doc_id, ids = f.document(i)
            assert doc_id == seen + i and ids.tolist() == as_the_library(texts[seen + i], WORDS_FILE)
        for i in {0, r.n_sequences - 1, *rng.sample(range(r.n_sequences), 5)}:
            ids, mask, ends = f.sequence(i)
            part = stream[i * 128 : (i + 1) * 128]
            assert ids.tolist() == part + [0] * (128 - len(part)) and tokenfiles.bits(mask).tolist() == [1] * len(part) + [0] * (128 - len(part))
            assert not any(x.flags.owndata for x in (ids, mask, ends))
        ends = np.concatenate([tokenfiles.bits(f.sequence(i)[2]) for i in range(r.n_sequences)])
        sizes = [len(as_the_library(texts[seen + i], WORDS_FILE)) for i in range(r.n_docs)]
        assert (np.flatnonzero(ends) + 1).tolist() == list(itertools.accumulate(sizes))
        seen += r.n_docs


def test_token_files_odd_rows(spark, tmp_path):
    """Repeated and null ids, an empty table, and an attempt whose files no manifest names."""
    df = docs(spark, ["b", "a", None, "a", "c"], [5, 5, None, 5, None])
    folder = f"file://{tmp_path}/x"
    tokenfiles.write_token_files(df, WORDS_FILE, folder, shards=2)
    rows = tokenfiles.read_documents(tokenfiles.write_token_files(df, WORDS_FILE, folder, shards=2)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 5, 5, 5] and [r.n_tokens for r in rows] == sorted([1, 2], key=lambda n: rows[0].n_tokens != n) + [2, 2, 2]
    assert [r.start for r in rows] == list(itertools.accumulate([0, *[r.n_tokens for r in rows][:-1]])) and len(glob.glob(f"{tmp_path}/x/*.ids.arrow")) > 2
    assert tokenfiles.read_documents(tokenfiles.write_token_files(df.where("false"), WORDS_FILE, f"{folder}/none")).collect() == []


def test_token_files_that_disagree(spark, tmp_path):
    """An index that doesn't fit the sequences is an error."""
    a, b = (tokenfiles.write_token_files(docs(spark, t), WORDS_FILE, f"file://{tmp_path}", shards=1) for t in (["one two", "three"], ["one", "two three"]))
    mixed = a.crossJoin(b.select(F.col("docs_path").alias("other"))).withColumn("docs_path", F.col("other"))
    with pytest.raises(Exception, match="doesn't fit its sequences"):
        tokenfiles.read_documents(mixed).collect()


@have_data
def test_token_query_equals_the_library(spark):
    got = sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, SF).collect())
    assert got == plain_index([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], WORDS_FILE)


# 12: repair of conversations
def plain_align(codes):
    """Least (cost, audit) over all edit scripts, state by state."""

    @lru_cache(None)
    def rest(i, state, room):  # state: 0 start, 1 behind a system turn, 2 assistant due, 3 user due
        every = [(0, "")] if i == len(codes) and state in (0, 3) else []
        put = lambda price, edit, tail: every.extend([(tail[0] + price, edit + tail[1])] if tail else [])
        after = 3 if state == 2 else 2
        if room:
            put(3, "I", rest(i, after, room - 1))
        if i < len(codes):
            c = codes[i]
            put(4, "D", rest(i + 1, state, room))
            if c != "d":
                late = 3 * c.isupper()
                put(3 + late, "R", rest(i + 1, after, room))
                if c in "sS" and state == 0:
                    put(late, "K", rest(i + 1, 1, room))
                if c.lower() == ("a" if state == 2 else "u"):
                    put(late, "K", rest(i + 1, after, room))
        return min(every, default=None)

    return rest(0, 0, len(codes) + 2)


def test_alignment_equals_brute_force():
    rng = random.Random(4)
    cases = ["".join(c) for n in range(4) for c in itertools.product("suaoSUAOd", repeat=n)]
    cases += ["".join(rng.choices("suaUAdo", k=rng.randrange(4, 25))) for _ in range(400)]
    cases += [("ua" * 30)[: rng.randrange(60)] + "".join(rng.choices("uaAd", k=10)) + "ua" * rng.randrange(20) for _ in range(40)]
    cases += ["u" * 40, "a" * 41, "U" * 40, "d" * 30 + "s" + "d" * 5 + "ua", "uaua" + "A" * 12 + "sua" * 6]
    for c in cases:
        assert turns.align(c) == plain_align(c), c


def test_alignment_of_long_conversations():
    """Rows that are computed again while the audit is read back agree with the first pass."""
    rng = random.Random(5)
    codes = "s" + "".join(rng.choices("uaUAds", weights=[40, 40, 5, 5, 8, 2], k=3000))
    cost, audit = turns.align(codes)
    kept = "".join({"K": c.lower(), "R": "?", "I": "?", "D": ""}[e] for e, c in zip(audit.replace("I", ""), codes, strict=True))
    assert len(audit.replace("I", "")) == len(codes) and len(kept) > 1000
    assert cost == sum({"K": 3 * c.isupper(), "R": 3 + 3 * c.isupper(), "D": 4}[e] for e, c in zip(audit.replace("I", ""), codes, strict=True)) + 3 * audit.count("I")
    import sys

    sys.setrecursionlimit(100_000)
    assert turns.align(codes[:400]) == plain_align(codes[:400])


CHAT = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """By conversation: counts, cost, audit and the repaired turns."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = sorted([(t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
        seen, faults = set(), []
        for _, _, r, x in mine:
            body = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        codes = "".join("d" if f in ("blank", "duplicate") else (k.upper() if f else k) for f, (_, _, r, _) in zip(faults, mine, strict=True) for k in [r[:1] if r[:1] in tuple("sua") else "o"])
        cost, audit = plain_align(codes)
        numbers = [t for some, t, _, _ in mine if some]
        odd, done, k = len(audit.replace("D", "")) % 2, [], 0
        for e in audit:
            due = ("user", "assistant")[(len(done) - odd) % 2]
            done += [("I", due, "")] if e == "I" else [] if e == "D" else [(e, mine[k][2] if e == "K" else due, mine[k][3])]
            k += e != "I"
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = [max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, done]
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(6)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Why?", "It goes on", " \n", "", None, "A dot. then", "Ends.\t\r\n", "Ünï…", "Yes. "]
    rows = [(c if c else None, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 10))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(50) if t % 7]
    df = spark.createDataFrame(rows, CHAT).withColumns({"k": F.lit("x"), "codes": F.lit(1), "place": F.lit(2)}).repartition(5)
    each, repaired = turns.repair(df)
    each = {r.conv_id: [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] for r in each.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    want = plain_repair(rows)
    assert {c: [*each[c], lines.get(c, [])] for c in each} == want


def test_repair_of_nothing(spark):
    """An empty table, a conversation of which nothing is present, and one that loses all its turns."""
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "system", "Rules."), (3, 0, None, None)], CHAT)
    each, repaired = turns.repair(rows, F.col("conv_id") != 1)
    assert sorted(tuple(r) for r in each.collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 4, "D"), (3, 0, 1, 0, 0, 0, 4, "D")]
    assert repaired.collect() == []
    each, repaired = turns.repair(rows.where("false"))
    assert each.collect() == [] and repaired.collect() == []


# 13: periodic runs
def plain_runs(w):
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and (i, j - i + q) not in {(a, n) for a, n, _ in out}:
                out.add((i, j - i + q, q))  # smaller periods came first
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng):
    texts = [None, "", " ", "x", "x " * 23, "x " * 24, "a b " * 12, "a b " * 11 + "a", "x " * 30_000, ("a b " * 13 + "c ") * 5, "a a a b " * 9]
    for _ in range(150):
        words = [rng.choice("abcde" if rng.random() < 0.5 else [f"w{i}" for i in range(90)]) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(4)):
            k, q = rng.randrange(len(words)), rng.randrange(1, 25)
            words[k:k] = (words[k : k + q] * 9)[: rng.randrange(3, 7) * q + rng.randrange(q)]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return texts


def test_runs_equal_brute_force(spark):
    texts = periodic_texts(random.Random(7))
    got = {r.doc_id: r for r in periods.periodic_runs(docs(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    n = 0
    for i, t in enumerate(texts):
        w = (t or "").split()
        want = [(0, 30_000, 1)] if len(w) == 30_000 else plain_runs(w)
        n += len(want)
        assert [tuple(r) for r in got[i].runs] == want, t
        drop = {k for s, m, q in want for k in range(s + q, s + m)}
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in drop)
    assert n > 100


def test_runs_in_long_sequences(monkeypatch):
    """Above what three numbers fit in one long, and over many texts at once."""
    texts = [(t or "").encode().split() for t in periodic_texts(random.Random(8))]
    small = [x.tolist() for x in periods.runs_of_texts(texts)]
    assert small == [x.tolist() for t in texts for x in periods.runs_of_texts([t])]
    way = periods._sorted

    def wide(high, low, at, n):
        order, new = way(high, low, at, 1 << 20)
        a, b = way(high, low, at, n)
        assert order.tolist() == a.tolist() and new.tolist() == b.tolist()
        return order, new

    monkeypatch.setattr(periods, "_sorted", wide)
    assert small == [x.tolist() for x in periods.runs_of_texts(texts)]


def test_best_run_and_odd_rows(spark, tmp_path):
    """Ties of the exponent go to the smallest start; null ids, repeated rows and an empty table have results."""
    path = str(tmp_path)
    tie = " ".join(["a b"] * 13 + ["c"] + ["d e"] * 13)
    rows = [(i, t) for i in (3, 3, None) for t in (tie, None, "p q r " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, path).collect()
    assert len(got) == 9 and [r.start for r in got if r.n_runs == 2] == [0] * sum(r.n_runs == 2 for r in got)
    assert all(Fraction(1000 * r.length, r.period) // 1 == r.exponent_milli for r in got if r.n_runs)
    assert {r.runs_sha256 for r in got if not r.n_runs} == {hashlib.sha256(b"").hexdigest()}
    assert periods.periodic_runs(docs(spark, ["x"]).where("false")).collect() == []

