"""Fingerprints against a plain one-permutation MinHash, and likeness against exact Jaccard."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tests.conftest import SF_SMALL
from trialspark.llm import document_fingerprints as D

M = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & M
    return h ^ (h >> 31)


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, k=D.SHINGLE):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(text):
    """One shingle and one bin at a time, in Python integers."""
    least = {}
    for s in shingles(text):
        h = None
        for w in s:
            x = xxhash.xxh64_intdigest(w, D.SEED)
            h = x if h is None else (mix(h) + x) & M
        h = mix(h)
        b = h >> 56
        least[b] = min(least.get(b, h), h)
    if not least:
        return ""
    out = []
    for b in range(D.BINS):
        order = sorted(range(D.BINS), key=lambda j: mix(b * D.BINS + j + D.SEED + 1))
        out.append(least[b] if b in least else least[next(j for j in order if j in least)])
    return "".join(f"{v & 15:x}" for v in out)


TEXTS = [None, "", " \t\n", "one", "One", "a b c d", "a b c d e", "a b c d e f", "naïve ÉTÉ été " * 9, "🙂" * 50,
         "the quick brown fox jumps over the lazy dog " * 3, "w" * 100_000]


@pytest.mark.parametrize("text", TEXTS + [" ".join(str(i * i) for i in range(n)) for n in (40, 700)])
def test_equals_a_plain_minhash(text):
    assert D.Fingerprinter()(text) == plain(text)


def test_likeness_is_near_the_jaccard_of_the_shingles():
    rng, make = random.Random(1), D.Fingerprinter()
    for n in (60, 400, 3000):  # sparse bins are densified, full ones are not
        off = []
        for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
            for _ in range(25):
                a = [str(rng.random()) for _ in range(n)]
                cut = int(n * share)
                b = a[:cut] + [str(rng.random()) for _ in range(n - cut)]
                x, y = " ".join(a), " ".join(b)
                j = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
                off.append(D.likeness(make(x), make(y)) - j)
        assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06 and max(map(abs, off)) < 0.25


def digest(rows):
    """rows in order: (id, text) -> the contract's columns, from plain fingerprints."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[:n - n // 2] + following[:n // 2]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited),
                    D.likeness(plain(t), plain(edited)), D.likeness(plain(t), plain(following))))
    return out


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_digest_equals_a_plain_version(spark, parts):
    rows = [(7 * k - 20, t) for k, t in enumerate(TEXTS)] + [(None, "no id here at all"), (900, "same row"), (900, "same row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as part", "'y' as Fingerprint", "1 as doc")
    out = D.neighbour_digest(df.repartition(4), num_partitions=parts)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    want = digest([rows[-3], *rows[:-3], *rows[-2:]])
    assert rows_of(out) == sorted(want, key=str)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(1, "a lone document of some words")], "doc_id long, text string")
    assert rows_of(D.neighbour_digest(df)) == digest([(1, "a lone document of some words")])
    assert D.neighbour_digest(df.limit(0)).count() == 0


def test_equal_ids_are_ordered_by_text(spark):
    rows = [(1, f"text number {k} of one id") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (rows_of(D.neighbour_digest(df.repartition(n), num_partitions=n)) for n in (1, 5))
    assert a == b and len(a) == 20


def test_given_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(D.neighbour_digest(docs)) == sorted(digest(rows), key=str)
    marked = D.with_fingerprint(docs.selectExpr("*", "1 as FINGERPRINT"))
    assert {r.doc_id: r.fingerprint for r in marked.collect()} == {i: plain(t) for i, t in rows}
    both = D.with_likeness(marked.selectExpr("fingerprint as a", "fingerprint as b"), "a", "b")
    assert {r.likeness for r in both.collect()} == {1.0}
