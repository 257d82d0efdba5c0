"""SimHash near-dedup with a pivot distance table.

Each text gets a 64-bit SimHash fingerprint; two texts are linked when their
fingerprints differ in at most ``radius`` bits, and the connected components
of the links are the groups of near copies.

Finding the links:

1. Equal fingerprints are one class from the start, so a class of copies of
   any size is one row in everything below.
2. *Pivot table.*  The 64 bits form bands, and each band has ``REFS``
   reference fingerprints.  For every class the Hamming distance to each
   reference, on the bits of the reference's band, is computed once and
   packed into one long per band: 32 distances for 4 bands.
3. *Candidates.*  A pair within ``radius`` bits leaves at least
   ``bands - radius`` bands untouched, and there every distance is equal.
   Classes meet on the distance coordinates of each choice of that many
   bands; no pair within the radius is missed.
4. *Discard.*  By the triangle inequality the distances of a pair to any one
   reference differ by at most its Hamming distance: pairs whose largest
   coordinate difference is over ``radius`` go.
5. *Verify* the survivors on the fingerprints themselves.

A bucket of more than ``DENSE`` classes (a large group of near copies) is not
paired off.  There each class names itself and every fingerprint one flipped
bit away on the bucket's free bits; two classes within two bits share such a
centre and are linked to its smallest class.  That needs one row per class
and free bit and finds the same components.  (Only at a radius of exactly 2,
the contract's, do centres and links agree; other radii are paired.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, row_key, without
from trialspark.llm.components import connected_components
from trialspark.session import materialize

BITS = 64
REFS = 8          # references per band
COORD_BITS = 5    # packed width of one distance (a band has at most 31 bits)
DENSE = 256       # classes in a bucket beyond which centres replace pairs
SEED = 42
_CHUNK = 1 << 16  # shingles hashed at a time
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set: eight 8-bit counters per word, emptied every 255 rows."""
    starts = np.arange(0, len(h), 255)
    out = np.empty((8, 8), dtype=np.int64)  # [bit in byte, byte]
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        out[k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.T.reshape(64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    shingle is ``shingle`` words joined by spaces, counted as often as it
    occurs; fewer words are one shingle; no word (or null) gives zero.  A bit
    is one if it is set in more than half of the shingles' XXH64 (seed 42).
    """
    import xxhash

    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    n = len(words) - k + 1
    a, b = starts[:n].tolist(), ends[k - 1:].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[x:y], SEED) for x, y in zip(a[i:i + _CHUNK], b[i:i + _CHUNK])])
        counts += _bit_counts(np.frombuffer(raw, ">u8").astype(np.uint64))
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """Add ``out`` (long): the SimHash of ``text``."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")

    return without(docs, [out]).withColumn(out, simhash(F.col(f"`{text}`")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(n: int) -> list[int]:
    """Bit masks of ``n`` bands of nearly equal width."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _references(mask: int, band: int) -> list[int]:
    """Seeded random fingerprints, kept to the band's bits."""
    rng = np.random.default_rng([SEED, band])
    return [int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2)) & mask for _ in range(REFS)]


def pivot_table(classes: DataFrame, fp: str, n_bands: int) -> DataFrame:
    """Add d0..d{n_bands-1}: per band, the packed distances to its references."""
    cols = []
    for j, mask in enumerate(_bands(n_bands)):
        packed = F.lit(0).cast("long")
        for i, ref in enumerate(_references(mask, j)):
            dist = F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(ref))).bitwiseAND(F.lit(_signed(mask))))
            packed = packed.bitwiseOR(F.shiftleft(dist.cast("long"), i * COORD_BITS))
        cols.append(packed.alias(f"d{j}"))
    return classes.select(fp, *cols)


def _largest_difference(n_bands: int):
    def coord(side: str, j: int, i: int):
        return F.shiftright(F.col(f"{side}.d{j}"), i * COORD_BITS).bitwiseAND(F.lit((1 << COORD_BITS) - 1))

    return F.greatest(*[F.abs(coord("x", j, i) - coord("y", j, i)) for j in range(n_bands) for i in range(REFS)])


def links(classes: DataFrame, fp: str = "fp", radius: int = 2, dense: int = DENSE) -> DataFrame:
    """(a, b): links between distinct fingerprints at ``radius`` or fewer bits.

    Every pair of sparse buckets; in dense ones enough of the links to keep
    each component whole.
    """
    if not 0 <= radius <= 15:
        raise ValueError("radius must be 0 to 15")
    n_bands = max(4, radius + 2)
    masks = _bands(n_bands)
    combos = list(combinations(range(n_bands), n_bands - radius))
    d = [f"d{j}" for j in range(n_bands)]
    keyed = pivot_table(classes, fp, n_bands).select(
        F.col(fp).alias("fp"), *d,
        F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), F.array(*[d[j] for j in c]).alias("key"))
                            for i, c in enumerate(combos)])).alias("at")).select("fp", *d, "at.combo", "at.key")
    shared = materialize(keyed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
                         "simhash_buckets")
    members = materialize(keyed.join(shared, ["combo", "key"]), "simhash_members")
    few = members if radius != 2 else members.filter(F.col("n") <= dense)
    pairs = (few.alias("x").join(few.alias("y"), ["combo", "key"])
             .filter(F.col("x.fp") < F.col("y.fp"))
             .filter(_largest_difference(n_bands) <= radius)
             .filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    if radius == 2:
        flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)
                                                          if not any(masks[j] >> b & 1 for j in c)]) for c in combos])
        centres = (members.filter(F.col("n") > dense)
                   .select("combo", "key", "fp", F.explode(F.get(flips, F.col("combo"))).alias("flip"))
                   .select("combo", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")))
        # a centre has at most one class per free bit and itself
        w = Window.partitionBy("combo", "key", "centre")
        near = centres.withColumn("a", F.min("fp").over(w)).filter("a <> fp")
        pairs = pairs.union(near.select("a", F.col("fp").alias("b")))
    return pairs.distinct()


def _classes(prints: DataFrame, best, radius: int) -> DataFrame:
    """(fp, best): each distinct fingerprint with the smallest ``best`` of its component."""
    classes = materialize(prints.groupBy("fp").agg(F.min(best).alias("best")), "simhash_classes")
    comps = materialize(connected_components(links(classes, radius=radius), "a", "b", "simhash_links"),
                        "simhash_components")
    rooted = classes.join(comps.select(F.col("node").alias("fp"), "root"), "fp", "left") \
                    .withColumn("root", F.coalesce("root", "fp"))
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("best").alias("best")), "root")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                          radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest non-null id of the row's group, itself
    included; it is null only if every id of the group is null.  Null and
    empty texts have fingerprint zero and are linked like any other; repeated
    rows give repeated rows; an empty table gives none.
    """
    prints = materialize(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")),
                                          "t", "fp", shingle).select("id", "fp"), "simhash_prints")
    comps = _classes(prints, "id", radius)
    return (prints.join(comps.select("fp", "best"), "fp", "left")
            .select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("best").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                         radius: int = 2) -> DataFrame:
    """The rows of ``docs`` with one row of each group: the smallest id, nulls last; ties by a hash of the text.

    Rows that share id and text are one row.  All columns are kept.
    """
    k1, k2 = fresh(docs, "k1", "k2")
    h1, h2 = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    keyed = docs.withColumns({k1: h1, k2: h2})
    prints = materialize(with_fingerprint(
        keyed.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"),
                     F.col(k1).alias("k1"), F.col(k2).alias("k2")), "t", "fp", shingle).drop("t"), "simhash_prints")
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("k1"), F.col("k2"))
    kept = _classes(prints, best, radius).select(F.col("best.k1").alias(k1), F.col("best.k2").alias(k2)).distinct()
    return keyed.dropDuplicates([k1, k2]).join(kept, [k1, k2], "left_semi").drop(k1, k2)
