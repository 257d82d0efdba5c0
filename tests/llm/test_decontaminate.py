"""Decontamination against brute force, with planted passages."""

import re
from collections import Counter

import numpy as np

from trialspark.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = words(s)
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            best = None
            for a in range(max(1, len(w) - len(v) + 1)):
                x, y = bag(w[a:a + len(v)], k), bag(v, k)
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= least and (best is None or sim > best[0]):
                    best = sim, a
            if best:
                out[d, i] = best
    return out


def make():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: [vocab[i] for i in rng.integers(0, len(vocab), n)]
    items = [(i, " ".join(say(int(n)))) for i, n in enumerate([60, 40, 18, 7, 5, 4, 1])] + [(50, ""), (51, None), (52, "aa " * 30)]
    docs = []
    for i in range(6):
        docs.append((i, " ".join(say(100) + items[i % 5][1].upper().split() + say(100)).replace(" ", " ** ")))
    v = items[0][1].split()
    docs += [(10, " ".join(say(30) + v[:30] + ["changed"] + v[31:] + say(30))),     # one word of 60 replaced
             (11, " ".join(say(30) + v[:55])), (12, " ".join(v[3:])), (13, " ".join(v[:30])),
             (14, " ".join(say(400))), (15, ""), (16, None), (17, "aa " * 50), (18, "aa aa aa"),
             (19, " ".join(items[1][1].split() * 2)), (None, items[1][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = make()
    want = brute(docs, items)
    assert {(10, 0), (11, 0), (12, 0), (17, 52), (0, 0), (4, 4), (None, 1)} <= set(want) and (13, 0) not in want
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").selectExpr("*", "1 as k1", "2 as fp", "'x' as item_id")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").selectExpr("*", "9 as doc_id")
    rows = D.contaminated_pairs(df, bench).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in rows} == {
        k: (round(s, 9), a) for k, (s, a) in want.items()}
    assert len(rows) == len(want)
    clean = D.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    gone = {d for d, _ in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in docs + docs[:3] if d not in gone)


def test_empty_tables(spark):
    docs, items = make()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated_pairs(df.limit(0), bench).count() == 0
    assert D.contaminated_pairs(df, bench.limit(0)).count() == 0
    assert D.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_simhash_equals_the_definition_in_both_widths(spark):
    rng = np.random.default_rng(0)
    rows = [[int(x) for x in rng.integers(-2**63, 2**63 - 1, n)] for n in (1, 2, 3, 40, 301)]
    df = spark.createDataFrame([(r,) for r in rows], "h array<long>")
    got = df.select("h", D.simhash(df["h"], 40).alias("a"), D.simhash(df["h"], 1 << 20).alias("b")).collect()
    for r in got:
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert r.a & (1 << 64) - 1 == r.b & (1 << 64) - 1 == want


def test_repeated_phrases_and_short_documents_are_all_found(spark):
    """Bags of 4, 4 and 1 that differ in the last shingle, and documents one shingle shorter than the item."""
    items, docs = [], []
    for i in range(60):
        items += [(i, f"a{i} b{i} " * 6 + f"x{i}"), (100 + i, " ".join(f"c{i}w{j}" for j in range(9)))]
        docs += [(i, f"a{i} b{i} " * 6 + f"y{i}"), (100 + i, " ".join(f"c{i}w{j}" for j in range(8)))]
    want = brute(docs, items)
    assert len(want) == 120
    rows = D.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in rows} == {
        k: (round(s, 9), a) for k, (s, a) in want.items()}


def test_pairs_at_the_borderline_are_found(spark):
    """45 shingles, of which 40 stay: similarity exactly 0.8; 39 stay: under it."""
    rng = np.random.default_rng(7)
    say = lambda n: [f"v{i}" for i in rng.integers(0, 5000, n)]
    items = [say(49) for _ in range(400)]
    docs = [(i, " ".join([*say(20), *w[:44], *(f"x{i}n{j}" for j in range(5)), *say(20)])) for i, w in enumerate(items)]
    docs += [(1000 + i, " ".join([*w[:43], *(f"x{i}n{j}" for j in range(6))])) for i, w in enumerate(items)]
    rows = D.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id and abs(r.similarity - 0.8) < 1e-12 and r.start_word == 15 for r in rows)
    assert len(rows) >= 398  # SimHash may lose 0.00025 of them


def test_long_items(spark):
    rng = np.random.default_rng(9)
    item = [f"v{i}" for i in rng.integers(0, 5000, 600)]
    docs = [(1, " ".join(["a", "b", *item, "c"])), (2, " ".join(item[50:])), (3, " ".join(item[:300])), (4, " ".join(item[:560] * 2))]
    rows = D.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    got = {r.doc_id: (round(r.similarity, 9), r.start_word) for r in rows}
    assert got.keys() == {1, 2, 4} and got[1] == (1.0, 2) and got[2] == (round(546 / 596, 9), 0)
    assert got[4][1] == 0
