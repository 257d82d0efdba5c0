"""Language ID: held-out accuracy, rejection, leakage, edge rows."""

import zlib

import numpy as np

from trialspark.llm import language_id as L
from trialspark.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.predict_languages(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() >= 0.99 * len(rows)


def test_sample_learns_from_no_held_out_row(spark):
    docs = table(spark, SF, "documents")
    held = {r.text for r in docs.filter(L.held_out(docs["doc_id"])).collect()}
    open_ = {r.text for r in docs.filter(~L.held_out(docs["doc_id"])).collect()}
    sample = L.training_sample(docs, size=200)
    assert 150 <= len(sample) <= 400 and {y for _, y in sample} == {"en", "de", "fr", "es"}
    assert all(t in open_ for t, _ in sample) and len(held) > 0


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    text = "Häuser und Straßen, 12 x\n" * 300
    whole = L.subword_counts(text)
    monkeypatch.setattr(L, "_CHUNK", 64)
    assert (L.subword_counts(text) == whole).all()


def test_edge_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog ran " * 5, "en"), (3, "der Hund und die Katze sind nicht im Haus " * 5, "de"),
            (4, "the dog and the cat were in that house " * 5, "en"), (5, "die Katze ist auf dem Dach und schläft " * 5, "de"),
            (6, None, "en"), (7, "", "de"), (8, "123 ... !!", "en"), (None, "the house", "en"), (9, "the dog", None),
            (9, "the dog", None), (10, "x" * 300_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as SCORE")
    out = L.identify(df, L.train([(t, y) for _, t, y in rows if t and y]))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows)
    for r in got:
        no_letter = not r["text"] or r["text"] == "123 ... !!"
        assert (r["lang_pred"] == "und") == no_letter and r["rejected"] >= no_letter
        assert r["lang_pred"] in ("en", "de", "und")
    assert next(r for r in got if r["doc_id"] == 3)["lang_pred"] == "de"
    assert [r.lang_pred for r in L.predict_languages(df.filter("lang is null")).collect()] == ["und", "und"]
    assert L.predict_languages(df.limit(0)).count() == 0


def test_a_language_of_long_documents_only_is_learned(spark):
    short = [(i, " ".join(f"the {w} of and" for w in ("house", "river", f"stone{i}")), "en") for i in range(40)]
    long = [(100 + i, f"dél{i} " + "équeè çuren ñorté " * 1500, "xx") for i in range(40)]
    df = spark.createDataFrame(short + long, "doc_id long, text string, lang string")
    sample = L.training_sample(df, passages=True)
    assert {y for _, y in sample} == {"en", "xx"}
    assert max(len(t.encode()) for t, _ in sample) <= L.SAMPLE_BYTES
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(df).collect()}
    assert all(got[i] == "xx" for i, _, _ in long) and all(got[i] == "en" for i, _, _ in short)


def plain_subwords(text):
    """Byte 2- to 4-grams of the lower-cased words with a blank on both sides, one at a time."""
    counts = np.zeros(L.BUCKETS, dtype=np.int64)
    raw = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).encode()
    for word in raw.split(b" "):
        w = b" " + word + b" "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1) if word else ():
                h = w[i]
                for x in w[i + 1:i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (x * 0x9E3779B1 & 0xFFFFFFFF)
                counts[((h * 0x85EBCA6B + n) & 0xFFFFFFFF) >> 18] += 1
    return counts


def test_subwords_equal_a_plain_version():
    for text in ("The cat, 12 Häuser x", "", "a", "ab\ncd  é", "漢字 かな"):
        assert (L.subword_counts(text) == plain_subwords(text)).all(), text


def test_text_of_no_learned_language_is_rejected(spark):
    docs = table(spark, SF, "documents")
    rows = L.training_sample(docs, passages=True)
    model = L.train(rows)
    assert 1e-2 < model.temperature < 1e2 and 0.25 < model.threshold < 0.999
    for text in ("これは日本語の文章で、どの言語でも学習されていません", "это русский текст, которого модель не видела",
                 "xq zzkw vvv pqr wkzj qqx", "Ελληνικό κείμενο για τη δοκιμή του μοντέλου"):
        assert model.predict(text)[2], (text, model.predict(text), model.threshold)
    rng = np.random.default_rng(9)
    foreign = [model.predict(f)[2] for t, _ in rows[:60] for f in L._foreign(L._snippet(t, rng, 13, 50), rng)]
    own = [model.predict(L._snippet(t, rng, 13, 50))[2] for t, _ in rows]
    assert np.mean(foreign) > 0.75 and np.mean(own) < 0.01


def test_every_language_is_learned_however_many(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(230 * 3)]
    rows = [(9 * i + j, " ".join(words[3 * i + k] for k in (0, 1, 2, j % 3)), f"l{i:03}") for i in range(230) for j in range(9)]
    sample = L.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({y for _, y in sample}) == 230
