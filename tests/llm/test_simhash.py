"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash

from trialspark.llm import simhash_dedup as S
from trialspark.llm.common import table
from trialspark.llm.components import connected_components
from tests.conftest import SF_SMALL


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    """fps: list of unsigned ints -> index of the smallest member of each one's component."""
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "Éa B c d\x0be", "a b c a b c a b c",
                                  "word " * 1000, "x" * 5000 + " y z w", " lead and trail ", "ß ﬀ \x85 q r"])
def test_fingerprint_equals_the_definition(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_groups_equal_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = {r.doc_id: r for r in S.near_duplicate_groups(docs).collect()}
    src = sorted((r.doc_id, slow_fingerprint(r.text)) for r in docs.collect())
    comp = slow_components([f for _, f in src], 2)
    assert len(rows) == len(src)
    for (i, f), c in zip(src, comp):
        assert rows[i].fingerprint == f"{f:016x}"
        assert rows[i].component_id == src[c][0]


@pytest.mark.parametrize("dense", [3, 10**6])
@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_find_every_component(spark, dense, radius):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    fps = set(base)
    for b in base[:4]:  # thick clouds around four centres
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [S._signed(f) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = S.links(df, radius=radius, dense=dense)
    for r in found.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= radius
    roots = {r.node: r.root for r in connected_components(found, "a", "b").collect()}
    got = {}
    for f, s in zip(fps, signed):
        got.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for f, c in zip(fps, slow_components(fps, radius)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(chain + star + [(5000, 5000), (None, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_edge_rows(spark):
    rows = [(3, None), (1, ""), (None, " \n"), (7, "some words in a row here"), (7, "some words in a row here"),
            (None, "another text of several words"), (9, "SOME words\nin a  row here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id)
                 for r in S.near_duplicate_groups(df).collect())
    assert [g[3] for g in got] == [1, 1, 7, 7, 7, 1, -1] or [g[3] for g in got] == [1, 1, 7, 7, 7, -1, 1]
    kept = S.drop_near_duplicates(df.selectExpr("*", "1 as k1", "2 as fp", "3 as id")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 7), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "k1", "fp", "id"}
    assert S.near_duplicate_groups(df.limit(0)).count() == 0
    assert S.drop_near_duplicates(df.limit(0)).count() == 0
