"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are the byte 2- to 4-grams of its lower-cased words with
their boundaries, hashed into ``BUCKETS`` rows of an embedding table; their
average goes through a linear softmax.  Embeddings and weights are trained
together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows (``SAMPLE`` texts of at most ``SAMPLE_BYTES`` bytes, equally
many of each language where there are enough); whole texts are predicted.
Every fifth sample row is held back to calibrate, whole and in snippets of
several lengths, against text of no learned language: the same words with
their letters shuffled, random letters, and letters of other scripts.  The
temperature makes the softmax a probability, right on the one and even on the
other (least log loss, smoothed by one answer more of each kind).  Texts below
the threshold are rejected; it lies where 95 % of the foreign text is under
it, unless that would turn away more than a share ``alpha`` of right answers.

The model is a table of BUCKETS x languages numbers, sent to the tasks once;
prediction is one vectorised pass over the bytes of each text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, without

BUCKETS = 1 << 14
DIM = 16
SAMPLE = 3000
SAMPLE_BYTES = 20_000
EPOCHS, BATCH, RATE = 8, 32, 4.0
MIN_STEPS = 800  # of gradient descent; a small sample is gone through more often
LENGTHS = ((2, 4), (5, 12), (13, 50))  # words in the snippets that calibrate
FOREIGN = 0.95                         # of the foreign text to be rejected, where right answers allow it
#: First and last letters of scripts to draw foreign text from: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, kana, Han, Hangul.
SCRIPTS = (("a", "z"), ("α", "ω"), ("а", "я"), ("א", "ת"), ("ا", "ي"), ("अ", "ह"), ("ぁ", "ん"), ("一", "鿿"), ("가", "힣"))
OUT = ("lang_pred", "score", "rejected")
UNKNOWN = "und"
_CHUNK = 1 << 20
_SPACED = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the text's subwords (length BUCKETS)."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" "
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, len(raw), _CHUNK):
        b = np.frombuffer(raw[i:i + _CHUNK + 3], dtype=np.uint8).astype(np.uint32)
        letter = b != 32
        last = min(len(b), _CHUNK)  # grams that start in this chunk
        h, inner = b.copy(), None
        for n in (2, 3, 4):
            if len(b) < n:
                break
            h = h[:len(b) - n + 1] * np.uint32(0x01000193) ^ b[n - 1:] * np.uint32(0x9E3779B1)
            if n == 2:
                ok = letter[:-1] | letter[1:]
            else:  # inner bytes are letters
                inner = letter[1:-1].copy() if n == 3 else inner[:-1] & letter[2:-1]
                ok = inner
            idx = (h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - 14)
            counts += np.bincount(idx[:last][ok[:last]], minlength=BUCKETS)
    return counts


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray      # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum()
        return (counts @ self.weights) / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected); ``und``, 0 and rejected if there is no letter."""
        if not text or not self.langs or not _has_letter(text):
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(subword_counts(text))[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def _has_letter(text: str) -> bool:
    import regex

    return regex.search(r"\p{L}", text) is not None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _snippet(text: str, rng: np.random.Generator, least: int = 2, most: int = 12) -> str:
    """A few consecutive words, so that short texts are learned too."""
    words = text.split()
    n = int(rng.integers(least, most + 1))
    a = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[a:a + n])


def train(rows: list[tuple[str, str]], alpha: float = 0.002, seed: int = 42) -> Model:
    """Fit and calibrate on (text, language) rows; texts without a letter teach nothing."""
    rng = np.random.default_rng(seed)
    rows = [(t, y) for t, y in rows if t and _has_letter(t)]
    langs = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    fit = [r for i, r in enumerate(rows) if i % 5] or rows
    held = rows[::5]
    of = {y: i for i, y in enumerate(langs)}
    data = []
    for t, y in fit:
        for s in (t, _snippet(t, rng)):
            c = subword_counts(s)
            idx = np.flatnonzero(c)
            if len(idx):
                data.append((idx, (c[idx] / c.sum()).astype(np.float32), of[y]))
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    each = -(-len(data) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // max(each, 1)))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            rows_now = [data[i] for i in order[a:a + BATCH]]
            used = np.unique(np.concatenate([idx for idx, _, _ in rows_now]))
            x = np.zeros((len(rows_now), len(used)), np.float32)
            for k, (idx, f, _) in enumerate(rows_now):
                x[k, np.searchsorted(used, idx)] = f
            hidden = x @ e[used]
            g = _softmax(hidden @ w + bias)
            g[np.arange(len(rows_now)), [y for _, _, y in rows_now]] -= 1
            rate = RATE * (1 - done / steps)
            g *= rate / len(rows_now)
            back = g @ w.T
            w -= hidden.T @ g
            bias -= g.sum(0)
            e[used] -= (x.T @ back) * BUCKETS ** 0.25
            done += 1
    model = Model(langs, (e @ w).astype(np.float64), bias.astype(np.float64))
    _calibrate(model, [(t, of[y]) for t, y in held], alpha, rng)
    return model


def _foreign(text: str, rng: np.random.Generator) -> list[str]:
    """Text of no language as long as ``text``: its letters shuffled, and words of random letters of some script."""
    letters = np.array(list(text))
    word = letters != " "
    letters[word] = rng.permutation(letters[word])
    first, last = SCRIPTS[int(rng.integers(len(SCRIPTS)))]
    drawn = [" ".join("".join(chr(c) for c in rng.integers(ord(x), ord(y) + 1, max(len(w), 1))) for w in text.split())
             for x, y in (SCRIPTS[0], (first, last))]
    return ["".join(letters), *drawn]


def _calibrate(model: Model, held: list[tuple[str, int]], alpha: float, rng: np.random.Generator) -> None:
    """Set temperature and threshold from held-back (text, language) rows and foreign text of the same lengths."""
    z, y, away = [], [], []
    for t, lang in held:
        for s in (t, *(_snippet(t, rng, *words) for words in LENGTHS)):
            c = subword_counts(s)
            if c.sum():
                z.append(model.logits(c))
                y.append(lang)
            if s is not t:
                away += [model.logits(c) for c in map(subword_counts, _foreign(s, rng)) if c.sum()]
    if not z:
        return
    z, y, away, k = np.array(z), np.array(y), np.array(away).reshape(-1, len(model.langs)), len(model.langs)
    want = np.full((len(z), k), 1 / (len(z) + k))  # as if every language had been right once more
    want[np.arange(len(z)), y] += len(z) / (len(z) + k)

    def loss(t: float) -> float:
        parts = [-(want * _log_softmax(z / t)).sum(1).mean()]
        if len(away) and k > 1:
            parts.append(-_log_softmax(away / t).mean())
        return sum(parts)

    heat = np.geomspace(1e-3, 1e3, 121)
    for _ in range(3):  # the best of a grid, then finer around it
        best = int(np.argmin([loss(t) for t in heat]))
        heat = np.geomspace(heat[max(best - 1, 0)], heat[min(best + 1, len(heat) - 1)], 21)
    model.temperature = float(heat[int(np.argmin([loss(t) for t in heat]))])
    p = _softmax(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    if len(right) and len(away) and k > 1:
        strangers = np.sort(_softmax(away / model.temperature).max(1))
        model.threshold = float(min(right[int(alpha * len(right))], strangers[int(FOREIGN * (len(strangers) - 1))]))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    size: int = SAMPLE, passages: bool = False) -> list[tuple[str, str]]:
    """About ``size`` (text, language) rows, at most twice as many, of rows that are not held out.

    Equally many per language by a hash of the id; distinct texts of 1 to
    SAMPLE_BYTES bytes.  The driver holds one count per language, and the
    model BUCKETS numbers.  With ``passages`` longer texts teach too, by SAMPLE_BYTES / 4 characters from a
    place by another hash of the id.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("y"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    share = rows.groupBy("y").count().collect()
    if not share:
        return []
    each = size / len(share)
    cut = F.element_at(F.create_map(*[F.lit(x) for r in share for x in (r["y"], min(1.0, each / r["count"]))]), F.col("y"))
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    long = SAMPLE_BYTES // 4  # characters, of four bytes at most
    start = F.pmod(F.xxhash64("id", F.lit("passage")), (F.char_length("t") - long + 1).cast("long")).cast("int") + 1
    passage = F.when(F.octet_length("t") > SAMPLE_BYTES, F.substring("t", start, F.lit(long))).otherwise(F.col("t"))
    fits = F.octet_length("t") > 0 if passages else F.octet_length("t").between(1, SAMPLE_BYTES)
    found = (rows.filter(spot < cut).filter(fits).select(passage.alias("t"), "y")
             .distinct().limit(2 * size).collect())
    return sorted(((r["t"], r["y"]) for r in found), key=lambda r: (zlib.crc32(r[0].encode("utf-8", "replace")), r))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score and rejected.

    Null texts and texts without a letter are ``und`` with score 0 and
    rejected.  Texts of any length are read whole, and equal texts, repeated
    rows too, get equal predictions; of tied languages the first by name wins.
    Columns with the names of added ones are replaced; an empty table gives no
    rows.
    """
    # BUCKETS x languages numbers
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.langs, model.weights, model.bias, model.temperature, model.threshold))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = Model(*sent.value)
        for s in batches:
            yield pd.DataFrame([here.predict(t) for t in s], columns=list(OUT))

    docs = without(docs, OUT)
    found, = fresh(docs, "found")
    return docs.withColumn(found, predict(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{found}.{c}") for c in OUT])


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document, from the labels of those not held out.

    Null texts, repeated rows, long texts, ties and an empty table as in ``identify``; other columns are not read.
    """
    model = train(training_sample(docs, passages=True))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns, whatever their names.

    Repeated rows stay or go together; null texts and texts without a letter go; an empty table stays empty.
    """
    model = train(training_sample(docs, passages=True))
    inner = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input is replaced
    kept = identify(docs.toDF(*inner), model, inner[docs.columns.index(text)]).filter(~F.col("rejected"))
    return kept.select(*inner).toDF(*docs.columns)
