"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE``
words (an item with fewer words is one shingle).  A document is compared with
an item window by window, each window as long as the item:

1. *Windows.*  The documents' shingles are met with the benchmark's.  An
   item-sized window with too few shingles that any item of its size has
   cannot be similar enough to one of them, whichever it is, and is not
   formed; that is exact.  Every other window gets a 64-bit SimHash of all its
   shingles, as does every item.
2. *Multi-index blocks.*  The fingerprint is cut into ``radius + 1`` blocks;
   fingerprints within ``radius`` bits agree in at least one.  Blocks this
   narrow alone select nothing, so windows and items of a size meet where they
   agree in a block and share a shingle among their smallest: bags of the
   similarity share one of so many, whichever they are.  No pair of both kinds
   is lost.  Pairs stay if they differ in at most ``radius`` bits.
3. *Verification.*  The weighted Jaccard similarity of the two shingle bags
   is computed exactly; ``min_similarity`` or more is a hit.

At similarity 0.8 about 9.7 of 64 bits differ, with a deviation of 2.9; the
default radius of 20 is more than three deviations beyond.  Only column
expressions, joins and aggregates run: the benchmark's tables are written,
measured and broadcast only under a bound, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, row_key
from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

SHINGLE = 5
RADIUS = 20
MIN_SIMILARITY = 0.8
BITS = 64
SHORT = 16  # shingles; bags under it vary too much in SimHash


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def shingle_hashes(word_hashes: Column, k: int) -> Column:
    """One 64-bit hash for every run of ``k`` words, in order; none if there are fewer."""
    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    return once(word_hashes, runs)


def simhash(hashes: Column, longest: int) -> Column:
    """Bit b is one if more than half of the hashes have it.

    Several counters share a long: four of 16 bits while no window is over
    32,767 shingles (``longest``), else two of 32 bits.
    """
    width = 16 if longest < 1 << 15 else 32
    lanes = BITS // width
    mask = sum(1 << (width * j) for j in range(lanes))
    zero = F.lit(0).cast("long")

    def added(k: int) -> Callable[[Column, Column], Column]:
        return lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask))

    sums = [F.aggregate(hashes, zero, added(k)) for k in range(width)]
    return once(F.struct(F.array(*sums).alias("s"), F.size(hashes).alias("n")),
                lambda x: _majority(x["s"], x["n"], width, lanes))


def _majority(sums: Column, n: Column, width: int, lanes: int) -> Column:
    def bit(b: int) -> Column:
        count = F.shiftrightunsigned(sums[b % width], width * (b // width)).bitwiseAND(F.lit((1 << width) - 1))
        return F.shiftleft((count * 2 > n).cast("int").cast("long"), b)

    out = bit(0)
    for b in range(1, BITS):
        out = out.bitwiseOR(bit(b))
    return out


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks of nearly equal width."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def _block_values(fp: Column, radius: int) -> Column:
    """One number per block, different from those of other blocks."""
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(m)).bitwiseOR(F.shiftleft(F.lit(i).cast("long"), 56))
                     if m < 1 << 56 else F.xxhash64(F.shiftrightunsigned(fp, a), F.lit(i))
                     for i, (a, m) in enumerate(_blocks(radius))])


def counted(hashes: Column) -> Column:
    """The bag as a set: every hash with the number of equal ones before it, hashed again."""
    return once(F.sort_array(hashes), lambda s: F.transform(
        s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x).cast("int"))))


def shared_weight(window: Column, distinct: Column, bag: Column) -> Column:
    """Shingles that a window shares with an item, repeats counted; the item's distinct ones and ``counted`` bag.

    A window without repeats has one of each, so there the distinct ones are enough.
    """
    return F.size(F.when(F.size(F.array_distinct(window)) == F.size(window), F.array_intersect(window, distinct))
                  .otherwise(F.array_intersect(counted(window), bag)))


def _prefix(hashes: Column, min_similarity: float) -> Column:
    """So many of the smallest hashes, repeats counted, that bags of the similarity share one of them."""
    n = F.ceil(F.size(hashes) * (1 - min_similarity) + 1e-6).cast("int") + 1
    return F.array_distinct(F.slice(F.sort_array(hashes), F.lit(1), n))


def _items(benchmark: DataFrame, item_id: str, text: str, radius: int) -> DataFrame:
    """(item, n_words, k, len, all, distinct, bag, key): one row per item with a word; ``all`` are its shingles in order."""
    items = (benchmark.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{text}`")).alias("w")).distinct()
             .withColumn("n_words", F.size("w")).filter("n_words > 0")
             .withColumn("k", F.least(F.lit(SHINGLE), F.col("n_words")))
             .withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))))
    hashes = F.lit(None).cast("array<long>")
    for k in range(1, SHINGLE + 1):
        hashes = F.when(F.col("k") == k, shingle_hashes(F.col("wh"), k)).otherwise(hashes)
    items = items.withColumn("all", hashes).select("item", "n_words", "k", "all", F.size("all").alias("len"))
    return materialize(items.withColumns({"distinct": F.array_distinct("all"), "bag": counted(F.col("all")),
                                          "key": F.xxhash64("item", "all")}), "benchmark_items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS,
                       min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """One row per contaminated document row key and item, with the best window.

    Columns: k1, k2 (hashes of id and text; rows that share both are one),
    doc_id, item_id, similarity, start_word (from 0), n_words of the window,
    bits (Hamming distance).  The best window is the most similar, then the
    first.  A document shorter than the item is one window.  Null and empty
    texts contaminate nothing and are never contaminated; repeated items count
    once; items without a word are left out; empty tables give no rows.
    """
    items = _items(benchmark, item_id, item_text, radius)
    longest, sizes = items.agg(F.max("len"), F.collect_set("k")).first()
    h1, h2 = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), h1.alias("k1"), h2.alias("k2"), F.col(f"`{text}`").alias("text"))
    found = None
    for k in sorted(sizes or []):
        part = _hits_of_length(base, items.filter(F.col("k") == k), k, longest, radius, min_similarity)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], _schema(docs, benchmark, doc_id, item_id))
    best = found.groupBy("k1", "k2", "doc_id", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("first"), "n_words", "bits")).alias("b"))
    return best.select("k1", "k2", "doc_id", F.col("item").alias("item_id"), "b.similarity",
                       (-F.col("b.first")).alias("start_word"), "b.n_words", "b.bits")


def _schema(docs: DataFrame, benchmark: DataFrame, doc_id: str, item_id: str) -> str:
    a, b = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    return (f"k1 long, k2 long, doc_id {a}, item_id {b}, similarity double, start_word int, n_words int, bits int")


def _hits_of_length(base: DataFrame, items: DataFrame, k: int, longest: int, radius: int,
                    min_similarity: float) -> DataFrame:
    """Verified windows against the items whose shingles have ``k`` words."""
    marks = materialize(items.select(F.explode("all").alias("h"), "len").distinct(), "benchmark_shingles")

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("sh", shingle_hashes(F.transform(words(F.col("text")), lambda x: F.xxhash64(x)), k)).drop("text")

    # the size is a column of its own below the explode, so that no exploded row carries the array
    flat = (hashed(base).withColumn("m", F.size("sh"))
            .select("k1", "k2", "m", F.posexplode("sh").alias("pos", "h")))
    touched = join_by_size(flat, marks, "h").select("k1", "k2", "m", "pos", "len").distinct()
    # every start of a window of len shingles that holds the shared one; a short document is one window
    last = F.greatest(F.col("m") - F.col("len"), F.lit(0))
    size = F.least(F.col("len"), F.col("m"))
    # both / (len + size - both) >= s needs both >= s * (len + size) / (1 + s)
    starts = (touched.select("k1", "k2", "len", size.alias("size"), F.explode(F.sequence(
        F.least(F.greatest(F.col("pos") - F.col("len") + 1, F.lit(0)), last),
        F.least(F.col("pos"), last))).alias("start"))
        .groupBy("k1", "k2", "len", "size", "start").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") * (1 + min_similarity) + 1e-6 >= min_similarity * (F.col("len") + F.col("size"))))
    per_doc = materialize(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("len", "start")).alias("at")),
                          "touched_windows")
    held = hashed(join_by_size(base, per_doc, ["k1", "k2"]))  # only documents with a window are hashed again
    windows = (held.select("doc_id", "k1", "k2", F.explode(F.transform("at", lambda w: F.struct(
        w["len"].alias("len"), w["start"].alias("start"),
        F.slice("sh", w["start"] + 1, w["len"]).alias("win")))).alias("w"))
        .select("doc_id", "k1", "k2", "w.len", "w.start", "w.win")
        .withColumn("fp", simhash(F.col("win"), longest))
        .withColumn("exact", (F.size("win") < F.greatest(F.col("len"), F.lit(SHORT)))
                    | (F.size(F.array_distinct("win")) < F.size("win"))))
    windows = materialize(windows, "item_windows")
    near = _candidates(windows, items, longest, radius, min_similarity)
    apart = F.col("fp").bitwiseXOR(F.col("ifp"))
    both = shared_weight(F.col("win"), F.col("distinct"), F.col("bag"))
    sim = near.select("doc_id", "k1", "k2", "item", "start", (F.size("win") + k - 1).alias("n_words"),
                      F.bit_count(apart).cast("int").alias("bits"), "len", F.size("win").alias("size"),
                      both.alias("both"))
    return (sim.withColumn("similarity", F.col("both") / (F.col("len") + F.col("size") - F.col("both")))
            .filter(F.col("similarity") >= min_similarity)
            .select("k1", "k2", "doc_id", "item", "similarity", "start", "n_words", "bits"))


def _candidates(windows: DataFrame, items: DataFrame, longest: int, radius: int, min_similarity: float) -> DataFrame:
    """Windows with the items of their size that share a prefix shingle and, unless ``exact``, are within ``radius``."""
    at = ["k1", "k2", "len", "start"]
    said = materialize(items.withColumn("ifp", simhash(F.col("all"), longest)).select("key", "item", "len", "ifp", "distinct", "bag", "all"),
                       "benchmark_fingerprints")
    index = materialize(said.select("len", "key", "ifp", _block_values(F.col("ifp"), radius).alias("iblocks"),
                                    F.explode(_prefix(F.col("all"), min_similarity)).alias("h")), "benchmark_prefixes")
    probes = windows.select(*at, "exact", "fp", _block_values(F.col("fp"), radius).alias("blocks"),
                            F.explode(_prefix(F.col("win"), min_similarity)).alias("h"))
    within = F.arrays_overlap("blocks", "iblocks") & (F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    met = join_by_size(probes, index, ["len", "h"]).filter(F.col("exact") | within)
    met = materialize(met.select(*at, "key").distinct(), "window_pairs")
    return join_by_size(join_by_size(windows, met, at), said.drop("len", "all"), "key", measured=said)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns and other rows are kept."""
    k1, k2 = fresh(docs, "k1", "k2")
    h1, h2 = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    found = find_contamination(docs, benchmark, doc_id, text)
    gone = materialize(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "contaminated")
    return join_by_size(docs.withColumns({k1: h1, k2: h2}), gone, [k1, k2], "left_anti").drop(k1, k2)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: each document that holds an item, with the best window."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start_word")).alias("first"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.first")).alias("start_word"), "b.n_words")


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS l
  FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (
  SELECT item_id, k, l, sh, count(*) AS c
  FROM (SELECT item_id, k, l, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS sh FROM b, unnest(range(1, l + 1)) AS r(i)) GROUP BY ALL),
ds AS (
  SELECT doc_id, s.k, len(w) - s.k + 1 AS m, i - 1 AS pos, list_aggregate(w[i:i + s.k - 1], 'string_agg', ' ') AS sh
  FROM d, (SELECT DISTINCT k FROM b) s, unnest(range(1, len(w) - s.k + 2)) AS r(i)),
hit AS (SELECT doc_id, item_id, bs.k, l, m, pos, ds.sh, c FROM ds JOIN bs ON ds.sh = bs.sh AND ds.k = bs.k),
win AS (
  SELECT DISTINCT doc_id, item_id, k, l, least(l, m) AS size, unnest(range(least(greatest(pos - l + 1, 0), greatest(m - l, 0)),
         least(pos, greatest(m - l, 0)) + 1)) AS start
  FROM hit),
cnt AS (
  SELECT win.doc_id, win.item_id, win.k, win.l, size, start, sh, least(count(*), c) AS x
  FROM win JOIN hit ON hit.doc_id = win.doc_id AND hit.item_id = win.item_id AND pos >= start AND pos < start + size
  GROUP BY win.doc_id, win.item_id, win.k, win.l, size, start, sh, c),
sim AS (
  SELECT doc_id, item_id, start, size + k - 1 AS n_words, sum(x) / (l + size - sum(x)) AS similarity
  FROM cnt GROUP BY doc_id, item_id, k, l, size, start),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity::DOUBLE AS similarity, start::INT AS start_word, n_words::INT AS n_words FROM best WHERE r = 1
"""
