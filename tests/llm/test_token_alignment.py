"""Token alignment against a plain version over every byte."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest

from tests.conftest import SF_SMALL
from trialspark.llm import token_alignment as A

TEXTS = [(1, "The quick brown fox, naïve café 東京タワー 🙂🙂 done."), (2, "The quick brown fox"), (3, None), (4, ""),
         (5, "x" * 300 + "=" * 200 + "\n\n\t  spaces   here "), (6, "<|endoftext|> </s> <s> <0x41>"),
         (7, "a▁b is not given back"), (2, "The quick brown fox"), (None, "The fox"),
         (9, " ‍́é\u0000﻿"), (10, "ಕನ್ನಡ தமிழ் עברית " * 40), (11, "one two three " * 3000), (12, " "),
         (13, "ﬁ ﬂ ½ Å")]


def test_ranks_and_merges_give_the_same_ids(spark):
    """Whole texts, and random strings of vocabulary entries, whose merges compete."""
    tool = tools()[0]
    assert tool._ranks is not None
    rng = random.Random(4)
    letters = [p.decode() for p in tool.pieces if p.isascii() and p.strip().isalpha() and len(p) < 9]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += ["".join(rng.choice("abeinost \n'.1é") for _ in range(80)) for _ in range(5_000)]
    texts += [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect() if r.text]
    for t in texts:
        want = tool._tok.encode(" " + t, add_special_tokens=False).ids
        assert tool.encode([t])[0].tolist() == want, t


def tools():
    return [f(open(f"{A.TOKENIZERS}/{n}", "rb").read()) for f, n in ((A.ByteBpe, A.BYTE_BPE), (A.Pieces, A.PIECES))]


def tokens(tool, text):
    """(id, start, end) per token, or none if the bytes are not those of space and text."""
    ids = tool.encode([text])[0].tolist()
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(tool.pieces[i])))
        at = out[-1][2]
    return out if b"".join(tool.pieces[i] for i in ids) == (" " + text).encode() else []


def plain(rows):
    ta, tb = tools()
    docs = []
    for i, text in rows:
        a = tokens(ta, text) if text else []
        b = tokens(tb, text) if text else []
        if not a or not b:
            a = b = []
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            for t in (a, b)[side]:
                groups[bisect_left(cuts, t[2])][side].append(t[0])
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    held = Counter(p for d in docs for p in d[4])
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(i, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
             sum(n * held[p] for p, n in links.items()), sha) for i, na, nb, ng, links, sha in docs]


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("max_pairs", [A.MAX_BROADCAST_PAIRS, 0])
def test_digest_equals_a_plain_version(spark, max_pairs):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as pair", "'x' as N_A")
    out = A.link_digest(df.repartition(3), max_pairs=max_pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(out) == sorted(plain(TEXTS), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert rows_of(A.link_digest(docs)) == sorted(plain([tuple(r) for r in docs.collect()]), key=str)


def test_spans_and_overlaps(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "0 as Groups")
    ta, tb = tools()
    for chunk in (1, 1 << 20):
        out = A.align_documents(df, chunk_bytes=chunk)
        assert out.columns == ["doc_id", "text", "groups", "overlaps"]
        for r in out.collect():
            a, b = (tokens(t, r.text) if r.text else [] for t in (ta, tb))
            if not a or not b:
                a = b = []
            assert [i for g in r.groups for i in g.a] == [t[0] for t in a]
            assert [i for g in r.groups for i in g.b] == [t[0] for t in b]
            whole = (" " + (r.text or "")).encode()
            for g in r.groups:
                for ids, tool in ((g.a, ta), (g.b, tb)):
                    assert b"".join(tool.pieces[i] for i in ids) == whole[g.start:g.end]
            if len(a) < 600:
                want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
                assert [(o.a, o.b) for o in r.overlaps] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.link_digest(df).count() == A.align_documents(df).count() == 0
