"""Phrase collocations by dynamic itemset counting.

The documents form shards that are scanned in a cycle.  All words start
counting at the first scan; a longer phrase becomes active after the scan in
which both its subphrases (all words but the last, all but the first) reached
the threshold, and counts for one full cycle from there.  So lengths
interleave: while the last shards still count words, the first pairs already
count, and triples follow as their pairs pass.

Counting is by 64-bit phrase hashes: a task cuts its texts into words and
hashes them in numpy, sums each chunk, and Spark adds the (length, hash,
count) rows, partially before the shuffle.  Which phrases reached the
threshold travels back as one bitmap for each length and scan, of at most
``BITMAP_BITS`` bits whatever the vocabulary's size.  Hashes and bitmaps can only let a
phrase in that need not be counted (colliding counts add up), never keep one
out, and each phrase that is in counts one cycle.  A last scan counts the
phrases that passed by their words themselves, so all counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

SHARDS = 2
MIN_COUNT = 10
MAX_WORDS = 3
BITMAP_BITS = 1 << 28   # 32 MB at most; beyond some ten million passing phrases it prunes less, the result is the same
CHUNK_BYTES = 2 << 20   # text cut at a time, at a piece's end
_SLOT = 1 << 15         # bits of one bitmap row

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)               # 0: part of a word
_KIND[[0x20, 0x09]] = 1                       # between words
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2   # between pieces
_BASE = 0x9E3779B97F4A7C15                    # odd, so it has an inverse modulo 2^64
_NEVER = 1 << 20
_STARTS = 16            # phrases are shorter


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunks:
    """Cuts texts of one language into chunks of whole pieces and those into words."""

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            self._up, self._down = (
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64)
                for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    @staticmethod
    def of(texts: list[bytes]) -> Iterator[np.ndarray]:
        """Lower-cased bytes, texts parted by a line break, in chunks that end between pieces."""
        held, size = [], 0
        for t in texts:
            held += [t, b"\n"]
            size += len(t) + 1
            if size >= CHUNK_BYTES:
                yield from Chunks._parts(b"".join(held))
                held, size = [], 0
        if held:
            yield from Chunks._parts(b"".join(held))

    @staticmethod
    def _parts(data: bytes) -> Iterator[np.ndarray]:
        a = _LOWER[np.frombuffer(data, np.uint8)]
        begin = 0
        while len(a) - begin > 2 * CHUNK_BYTES:
            end = begin + CHUNK_BYTES
            while end < len(a):  # the next end of a piece
                found = np.flatnonzero(_KIND[a[end:end + CHUNK_BYTES]] == 2)
                if len(found):
                    end += int(found[0]) + 1
                    break
                end = min(end + CHUNK_BYTES, len(a))
            yield a[begin:end]
            begin = end
        yield a[begin:]

    def words(self, a: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last + 1 byte of each word, whether the next word is in its piece, and its hash."""
        kind = _KIND[a]
        inside = np.concatenate(([False], kind == 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        joined = np.concatenate((piece[1:] == piece[:-1], [False])) if len(start) else np.zeros(0, bool)
        self._powers(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self._up[:len(a)], out=sums[1:])
        h = (sums[end] - sums[start]) * self._down[start]  # the bytes' polynomial, wherever the word stands
        return start, end, joined, _mix(h + np.uint64(seed) + (end - start).astype(np.uint64))


def _seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the phrases one word longer."""
    return _mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _reached(maps: list[tuple[int, np.ndarray]], h: np.ndarray) -> np.ndarray:
    """The scan after which each phrase is known to have reached the threshold, ``_NEVER`` if none."""
    out = np.full(len(h), _NEVER, np.int64)
    for scan, bits in sorted(maps, key=lambda m: -m[0]):
        out[_in(bits, h)] = scan
    return out


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
        if text:
            out.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
    return out


def _scan(docs: DataFrame, scan: int, shards: int, max_words: int, maps) -> DataFrame:
    """(k, h, n): what the phrases active in this scan count in its shard; k is length + 16 * scan they began in."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = Chunks(), maps.value
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for a in cut.of(texts):
                    _, _, joined, word = cut.words(a, _seed(lang))
                    for k, start, h in _active(word, joined, scan, shards, max_words, known):
                        values, n = np.unique(h, return_counts=True)
                        code = np.full(len(values), k + _STARTS * start, np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(code), pa.array(values.view(np.int64)), pa.array(n)], ["k", "h", "n"])

    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == scan % shards)
    return part.mapInArrow(count, "k int, h bigint, n bigint")


def _active(word, joined, scan, shards, max_words, known):
    """(length, scan they began in, hashes of the occurrences that count in this scan)."""
    if scan < shards:
        yield 1, 0, word
    at, h = np.arange(len(word)), word  # first words and hashes of the phrases one word shorter that passed
    for k in range(2, max_words + 1):
        if not known.get(k - 1):
            return
        passed = _reached(known[k - 1], h)
        next_one = np.searchsorted(at, at + 1)  # the phrase that begins one word later
        next_one[next_one == len(at)] = 0
        both = joined[at + k - 2] & (at[next_one] == at + 1) if len(at) else np.zeros(0, bool)
        start = 1 + np.maximum(passed, passed[next_one]) if len(at) else passed
        both &= start < _NEVER
        at, start = at[both], start[both]
        h = _longer(h[both], word[at + k - 1])
        for began in range(max(scan - shards + 1, 0), scan + 1):
            yield k, began, h[start == began]


def _bitmaps(counts: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """Per length the bits of the given hashes: 32 bits or more a hash, at most ``bits`` in all."""
    sizes = {}
    for r in counts.groupBy("k").count().collect():  # a row per length
        sizes[r["k"]] = max(_SLOT, min(bits, 1 << (32 * r["count"] - 1).bit_length()))
    if not sizes:
        return {}
    mask = F.element_at(F.create_map(*[F.lit(x) for k, size in sizes.items() for x in (k, size - 1)]), F.col("k"))
    slot = F.col("h").bitwiseAND(mask.cast("long"))
    rows = (counts.select("k", F.shiftright(slot, 15).alias("row"), slot.bitwiseAND(F.lit(_SLOT - 1)).alias("bit"))
            .groupBy("k", "row").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect())  # bounded by ``bits``
    out = {k: np.zeros(size // 8, np.uint8) for k, size in sizes.items()}
    for r in rows:
        out[r["k"]][r["row"] * (_SLOT // 8):(r["row"] + 1) * (_SLOT // 8)] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def passing_phrases(docs: DataFrame, min_count: int, max_words: int, shards: int,
                    bits: int = BITMAP_BITS) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Dynamic itemset counting: per length the (scan, bitmap) pairs of the phrases that reached ``min_count``.

    A scan's sums are written; what has not passed yet and still counts is carried to the next.
    """
    sc = docs.sparkSession.sparkContext
    maps: dict[int, list[tuple[int, np.ndarray]]] = {}
    last = {1: shards - 1}  # the scan in which each length's last phrases complete their cycle
    scan, carried = 0, None
    while scan <= max(last.values()):
        shared = sc.broadcast(maps)
        rows = _scan(docs, scan, shards, max_words, shared)
        if carried is not None:
            rows = rows.unionByName(carried)
        going = F.col("k") >= _STARTS * (scan - shards + 2)  # began late enough to count in the next scan too
        counts = rows.groupBy("k", "h").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | going)
        counts = materialize(counts, "phrase_counts")
        shared.destroy()
        passed = counts.filter(F.col("n") >= min_count).select((F.col("k") % _STARTS).alias("k"), "h")
        for k, found in _bitmaps(passed, bits).items():
            maps.setdefault(k, []).append((scan, found))
            if k < max_words:
                last[k + 1] = scan + shards
        carried = counts.filter((F.col("n") < min_count) & going)
        scan += 1
    return maps


def _same(a: np.ndarray, start: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray) -> bool:
    """Whether word ``one[i]`` is spelt as word ``other[i]`` for all i."""
    if (size[one] != size[other]).any():
        return False
    n = size[one]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return bool((a[step + np.repeat(start[one], n)] == a[step + np.repeat(start[other], n)]).all())


def _spelt(a, start, end, h) -> tuple[np.ndarray, list[bytes]]:
    """Each word's place in a list of distinct spellings; equal hashes are compared byte by byte."""
    values, first, at = np.unique(h, return_index=True, return_inverse=True)
    if _same(a, start, end - start, np.arange(len(h)), first[at]):
        data = a.tobytes()
        return at, [data[x:y] for x, y in zip(start[first].tolist(), end[first].tolist())]
    data, known = a.tobytes(), {}
    at = np.array([known.setdefault(data[x:y], len(known)) for x, y in zip(start.tolist(), end.tolist())], np.int64)
    return at, list(known)


def exact_counts(docs: DataFrame, maps: dict, max_words: int) -> DataFrame:
    """(lang, k, phrase, n) of the phrases whose bits are set, counted by their words; k = 0: all words.  Written."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = Chunks(), shared.value
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for a in cut.of(texts):
                    start, end, joined, word = cut.words(a, _seed(lang))
                    if not len(word):
                        continue
                    ids, spelt = _spelt(a, start, end, word)
                    phrase, k, n = [b""], [0], [len(word)]
                    at, h, key, words = np.arange(len(word)), word, ids, [ids]
                    for length in range(1, max_words + 1):
                        if length not in known:
                            break
                        if length > 1:
                            # a phrase counts only if the one it extends did, so ``at`` thins out
                            here = joined[at + length - 2]
                            at, key = at[here], key[here]
                            h = _longer(h[here], word[at + length - 1])
                        here = _reached(known[length], h) < _NEVER
                        at, h, key = at[here], h[here], key[here]
                        if length > 1:
                            # phrases of one length get new numbers, so that the next key fits into 64 bits
                            key = key * len(spelt) + ids[at + length - 1]
                        values, first, key, times = np.unique(key, return_index=True, return_inverse=True,
                                                              return_counts=True)
                        parts = [ids[at[first] + j].tolist() for j in range(length)]
                        phrase += [b" ".join([spelt[i] for i in p]) for p in zip(*parts)]
                        k += [length] * len(values)
                        n += times.tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(k, pa.int32()),
                         pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                        ["lang", "k", "phrase", "n"])

    rows = docs.mapInArrow(count, "lang string, k int, phrase string, n bigint")
    counts = materialize(rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")), "phrases")
    shared.destroy()
    return counts


def score_expr(a: str, left: str, right: str) -> str:
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact for counts under 10^15."""
    dec = lambda c: f"cast({c} as decimal(15,0))"
    return f"(cast(1000000 as decimal(7,0)) * {dec(a)} * {dec(a)}) div ({dec(left)} * {dec(right)})"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, percent: int = 50, top: int = 2000, shards: int = SHARDS,
                 bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``max_words`` words.

    a counts the phrase, n all words of the language; the cut into two parts
    (counts l and r) with the lowest score floor(10^6 a a / (l r)) counts,
    of ties the one after the fewest words.  A phrase whose words lie in a
    longer one with a count of at least ``percent`` % of its own is dropped.
    Ties in score are ordered by a descending, then by the phrase's bytes.
    A null language is ``und``, null and empty texts have no words; texts of
    any length are read whole and repeated rows count each time.  Only the
    two named columns are read, so others may have any name; an empty table
    gives none.
    """
    if bits < _SLOT or bits & (bits - 1):
        raise ValueError(f"bits must be a power of two from {_SLOT}")
    if not 2 <= max_words < _STARTS:
        raise ValueError(f"a phrase has from 2 to {_STARTS - 1} words")
    docs = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    counts = exact_counts(docs, passing_phrases(docs, min_count, max_words, shards, bits), max_words)
    found = counts.filter((F.col("k") > 0) & (F.col("n") >= min_count)).select("lang", "k", "phrase", "n")
    phrases = found.filter("k > 1").withColumnRenamed("n", "a")
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    words = phrases.withColumn("w", F.split("phrase", " "))
    cuts = words.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "w")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"),
                       part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = join_by_size(cuts, found.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)),
                            ["lang", side], measured=counts)
    best = (cuts.withColumn("score", F.expr(score_expr("a", "l", "r")))
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")))
    longer = words.filter("k > 2").select(
        "lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"),
        F.col("a").alias("longer"))
    # a phrase in one that is several words longer is also in the one between, which counts no less
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = (best.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))))
    order = F.desc("b.score"), F.desc("a"), "phrase"
    # the first of each of 32 parts of a language, then the first of these: no task ranks all of a language's phrases
    share = F.pmod(F.xxhash64("phrase"), F.lit(32))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).filter(
        F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    totals = counts.filter("k = 0").select("lang", F.col("n"))
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return join_by_size(ranked, totals, "lang", measured=counts).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", F.col("b.score").alias("score"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (VALUES (1), (2), (3)) AS v(k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cut AS (
  SELECT c.lang, c.phrase, a, i, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') AND x.k = i
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1:], ' ') AND y.k = c.k - i),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3)
  GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
       b.phrase, b.a, b.l, b.r, total.n, b.score::BIGINT AS score
FROM best AS b JOIN total USING (lang) LEFT JOIN longer AS q ON q.lang = b.lang AND q.phrase = b.phrase
WHERE q.a IS NULL OR 100 * q.a < 50 * b.a
QUALIFY rank <= 2000
"""
