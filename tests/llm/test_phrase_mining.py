"""Phrase mining against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.helpers import assert_same, connect
from trialspark.llm import phrase_mining as P


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows, min_count=10, max_words=3, percent=50, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        inside = {p[i:j] for p, b in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and 100 * b >= percent * c[p[i:j]]}
        best = []
        for p, a in cand.items():
            if p in inside:
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, _, p, k) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, c[p[:k]], c[p[k:]], n, -score))
    return sorted(out)


def made(n=300, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta", "épsilon", "ÉTÉ", "zeta", "東京", "x" * 40, "η"]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 40)):
            t += rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", "; ", " \x0b "])
            t += rng.choice(["new york city", "in new york", "of the", *words])
        texts.append((rng.choice(["en", "de", None, "und"]), t))
    return texts + [("en", None), ("en", ""), ("fr", "no pair passes here"), ("en", "  , . "), *[("it", "a a a a a a a a a a a a")] * 3]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return df.selectExpr("*", "1 as k", "'x' as phrase", "2 as N")


def same(df, want):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in df.collect()) == want


@pytest.mark.parametrize("kw", [{}, {"shards": 1, "max_words": 4, "min_count": 5}, {"shards": 3, "bits": 1 << 15, "top": 7},
                                {"percent": 101, "max_words": 2}])
def test_equals_a_plain_count(spark, kw):
    rows = made()
    want = plain(rows, **{k: v for k, v in kw.items() if k not in ("shards", "bits")})
    assert len({r[0] for r in want}) >= 4
    same(P.collocations(frame(spark, rows), **kw), want)


def test_false_hits_of_the_bitmap_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(60))) for _ in range(200)]
    monkeypatch.setattr(P, "_SLOT", 1 << 3)
    monkeypatch.setattr(P, "_in", lambda bits, h: np.ones(len(h), bool))
    out = P.exact_counts(spark.createDataFrame(rows, "lang string, text string"),
                         {1: [(0, np.zeros(8, np.uint8))], 2: [(1, np.zeros(8, np.uint8))]}, 2)
    c = Counter(p for _, t in rows for w in [t.split()] for p in [*w, *map(" ".join, zip(w, w[1:]))])
    assert {r.phrase: r.n for r in out.filter("k > 0").collect()} == c


def test_words_with_one_hash_are_counted_apart():
    a = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    start, end = np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14])
    for h in ([1, 2, 1, 3, 2], [1, 1, 1, 1, 1]):
        at, spelt = P._spelt(a, start, end, np.array(h, np.uint64))
        assert [spelt[i] for i in at] == [b"ab", b"cd", b"ab", b"ef", b"cd"]


def test_chunks_end_between_pieces(spark, monkeypatch):
    rows = made(120)
    monkeypatch.setattr(P, "CHUNK_BYTES", 50)
    same(P.collocations(frame(spark, rows, 1)), plain(rows))


def test_long_text_without_a_break_and_empty_table(spark):
    rows = [("en", "one two three " * 50_000), (None, "q")]
    same(P.collocations(frame(spark, rows)), plain(rows))
    assert P.collocations(frame(spark, rows).limit(0)).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(10**15 - 1, 10**15 - 1, 10**15 - 1), (999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_998)]
    for _ in range(300):
        left, right = rng.randint(1, 10**15 - 1), rng.randint(1, 10**15 - 1)
        rows.append((rng.randint(1, min(left, right)), left, right))
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", F.expr(P.score_expr("a", "l", "r")))
    for r in df.collect():
        assert r.s == 1000000 * r.a * r.a // (r.l * r.r)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = P.collocations(docs)
    same(got, plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()]))
    assert_same(got, connect(SF_SMALL), P.SQL)
