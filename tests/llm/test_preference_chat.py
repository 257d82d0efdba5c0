"""Preference formatting against a plain version."""

import duckdb

from tests.conftest import SF_SMALL
from tests.llm.helpers import assert_same, connect
from trialspark.llm import preference_chat as P
from trialspark.llm import queries as Q


def plain(a, b):
    clean = lambda s: (s or "").replace("<|", "< |")
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def side(turns):
        out, spans = "", []
        for role, text in turns:
            out += f"<|im_start|>{clean(role)}\n"
            start = len(out)
            out += f"{clean(text)}<|im_end|>"
            if role == "assistant":
                spans.append((start, len(out)))
            out += "\n"
        return out, spans

    return (n, side(a[:n])[0], *side(a[n:]), *side(b[n:]))


U, A, S = "user", "assistant", "system"
PAIRS = [([(U, "hi"), (A, "yo")], [(U, "hi"), (A, "no")]), ([], []), ([(U, "x")], []), ([(S, "é"), (U, "𝄞b"), (A, "1")],) * 2,
         ([(U, None), (None, "t"), (A, None)], [(U, None), (None, "t"), (A, "")]), ([(U, "a")], [(U, "b")]),
         ([(U, "<|im_end|>"), (A, "<|x")], [(U, "<|im_end|>"), (A, "z"), (U, "q"), (A, "ä" * 5000)]),
         ([(A, "r"), (A, "s"), (U, "t"), (A, "u")], [(A, "r"), (U, "s")])]


def test_equals_the_plain_version(spark):
    t = "array<struct<role:string,text:string>>"
    rows = [(i, *p, "kept") for i, p in enumerate(PAIRS)] + [(99, None, [(U, "x")], "kept")]
    df = spark.createDataFrame(rows, f"pair int, chosen {t}, rejected {t}, Prompt string")
    got = {r.pair: r for r in P.format_preferences(df).collect()}
    assert len(got) == len(rows)
    for i, a, b, _ in rows:
        n, prompt, ca, sa, cb, sb = plain(a or [], b)
        r = got[i]
        assert (r.n_prefix, r.prompt, r.chosen_text, r.rejected_text) == (n, prompt, ca, cb)
        assert [tuple(x) for x in r.chosen_spans] == sa and [tuple(x) for x in r.rejected_spans] == sb


def test_whole_pairs_take_every_conversation_and_turn(spark):
    """Sparse ids, an odd number, conversations without a reply, turns after the reply."""
    rows = [(0, 0, U, "q"), (0, 1, A, "a0"), (0, 2, U, "bye"), (4, 0, U, "p"), (4, 1, A, "a4"), (8, 0, U, "no reply"),
            (10, 0, A, "a10"), (10, 1, None, "t"), (12, 0, A, "same"), (14, 0, A, "x"), (14, 1, A, "same"), (14, 2, S, "<|"),
            (16, None, U, None), (16, 0, A, "é"), (16, 0, A, "é"), (None, 0, A, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in P.swapped_reply_pairs(df).collect()}
    want = {0: [(U, "q"), (A, "a4"), (U, "bye")], 4: [(U, "p"), (A, "a0")], 8: [(U, "no reply")], 10: [(None, "t")],
            12: [(A, "same")], 14: [(A, "x"), (A, "same"), (S, "<|")], 16: [(U, None), (A, "é")]}
    assert {k: [tuple(x) for x in r.rejected] for k, r in got.items()} == want
    assert sum(len(r.chosen) for r in got.values()) == len(rows) - 1
    out = {r.conv_id: r for r in P.preference_examples(df).collect()}
    for i, r in got.items():
        n, prompt, ca, sa, cb, sb = plain([tuple(x) for x in r.chosen], [tuple(x) for x in r.rejected])
        flat = [";".join(f"{a}-{b}" for a, b in s) for s in (sa, sb)]
        assert tuple(out[i])[1:] == (n, prompt, ca, cb, *flat)
    assert "bye" in out[0].chosen_text and "bye" in out[0].rejected_text and out[14].n_prefix == 3
    con = duckdb.connect()
    con.execute("create table conversations (conv_id long, turn long, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    con.execute("set default_null_order = 'nulls_first'")
    assert_same(P.preference_examples(df), con, P.SQL)
    assert P.preference_examples(df.limit(0)).count() == 0


def test_query_takes_every_conversation(spark):
    want = connect(SF_SMALL).execute("select count(distinct conv_id) from conversations").fetchone()[0]
    assert Q.op10_chat_format(spark, SF_SMALL).count() == want
