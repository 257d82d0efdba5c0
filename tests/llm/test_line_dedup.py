"""Line dedup against a plain loop."""

import hashlib

from trialspark.llm import line_dedup as L


def plain(rows, min_chars=20, min_docs=3):
    """rows: (id, text) -> per row (n_lines, n_dropped, kept text)."""
    def key(x):
        x = x.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)

    at = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                at.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(at.get(key(x), ())) < min_docs
                or i == max((d for d in at[key(x)] if d is not None), default=None)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


A, B = "A line that many documents share", "Ünother LINE of twenty and more"
ROWS = [(1, f"{A}\nown one\n{A}"), (2, f"  {A.lower()}\t\n\n{B}"), (3, f"x\n{A}\n{A}\r\n{B}\n"), (4, f"{B}\n{B.upper()}"),
        (5, None), (6, ""), (7, "\n\n"), (None, f"{A}\n{B}"), (None, A), (8, "short line\n" * 3), (9, "short line"),
        (10, "short line"), (11, "exactly twenty chars"), (12, "exactly twenty chars "), (13, "Exactly twenty chars"),
        (14, "just nineteen chars"), (15, "just nineteen chars"), (16, "just nineteen chars"),
        (2, f"  {A.lower()}\t\n\n{B}"), (17, "long " * 20000 + "\n" + A)]


def same(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as k1", "'z' as N_LINES")
    out = L.drop_shared_lines(df, **kw)
    assert out.columns == ["doc_id", "text", "k1", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted(plain(rows, **kw), key=str)


def test_equals_a_plain_loop(spark):
    same(spark, ROWS)
    same(spark, ROWS, min_chars=5, min_docs=2)


def test_digest_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = sorted((str(i), n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(ROWS))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in L.line_digest(df).collect()) == want
    assert L.line_digest(df.limit(0)).count() == 0
