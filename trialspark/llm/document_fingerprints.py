"""Document fingerprints by one-permutation MinHash with optimal densification.

A text's word shingles are hashed once.  The high bits of a hash name one of
``BINS`` bins and each bin keeps its smallest hash.  An empty bin borrows the
value of a full one: each bin has its own fixed random order of the bins and
takes the first full one in it, so two texts with the same full bins borrow
alike and every full bin is as likely a donor as any other.  Of each bin the
lowest ``BITS`` bits are stored, packed and written as hex digits.

Two fingerprints agree in a bin if the smallest shingles are the same, with
the likeness J, or by chance in 1 of 2^BITS cases otherwise.  ``likeness``
removes that bias: (agreeing share - 2^-BITS) / (1 - 2^-BITS), not under 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import without
from trialspark.session import materialize

BINS = 256     # a power of two
BITS = 4       # kept per bin: 4 bits are one hex digit
SHINGLE = 5    # words
SEED = 12
_WORDS = 1 << 17  # word hashes remembered per task
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Fingerprinter:
    """Fingerprints of texts; holds the bins' donor orders and the hashes of recent words."""

    def __init__(self, bins: int = BINS, shingle: int = SHINGLE, seed: int = SEED):
        if bins & (bins - 1) or bins < 2:
            raise ValueError("bins must be a power of two")
        self.bins, self.shingle, self.seed = bins, shingle, seed
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        pairs = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
        self.donors = np.argsort(_mix(pairs + np.uint64(seed + 1)), axis=1, kind="stable")
        self._known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the shingles: words are runs of anything but ASCII white space, A-Z lower-cased.

        Fewer words than a shingle has are one shingle; no word (or null) gives none.
        """
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known, digest, seed = self._known, xxhash.xxh64_intdigest, self.seed
        if len(known) > _WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w, seed)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.shingle, len(words))
        n = len(words) - k + 1
        out = h[:n].copy()
        for j in range(1, k):
            out = _mix(out) + h[j:j + n]
        return _mix(out)

    def minima(self, text: str | None) -> np.ndarray | None:
        """The smallest hash of each bin, empty bins filled; None without a shingle."""
        h = self.shingles(text)
        if not len(h):
            return None
        least = np.full(self.bins, _NONE)
        np.minimum.at(least, (h >> self.shift).astype(np.int64), h)
        empty = np.flatnonzero(least == _NONE)
        if len(empty):
            full = least != _NONE
            if not full.any():  # the one hash that means empty: its bin is the last
                full[-1] = True
            order = self.donors[empty]
            least[empty] = least[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
        return least

    def __call__(self, text: str | None) -> str:
        """Hex digits, one per bin; the empty string for a text without a word."""
        least = self.minima(text)
        if least is None:
            return ""
        low = (least & np.uint64(15)).astype(np.uint8)
        return ((low[0::2] << 4) | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness (0 to 1) of two fingerprints; two empty ones are alike, one is like nothing."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
    chance = 2.0 ** -BITS
    return max(0.0, (float((x == y).mean()) - chance) / (1 - chance))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", bins: int = BINS,
                     shingle: int = SHINGLE) -> DataFrame:
    """Add ``out``: the fingerprint of ``text`` (null or without a word: the empty string).

    Equal texts have equal fingerprints, so repeated rows do too; texts of any
    length are read whole.  A column named ``out`` is replaced; an empty table
    gives none.
    """
    @F.pandas_udf("string")
    def minhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Fingerprinter(bins, shingle)
        for s in batches:
            yield pd.Series([make(t) for t in s], dtype=object)

    return without(docs, [out]).withColumn(out, minhash(F.col(f"`{text}`")))


def with_likeness(pairs: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """Add ``out``: the likeness of the fingerprints in columns ``a`` and ``b`` (null if one is null)."""
    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y)], dtype="float64")

    return without(pairs, [out]).withColumn(out, compare(F.col(f"`{a}`"), F.col(f"`{b}`")))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _digest(make: Fingerprinter, text: str, mine: str, following: str, its: str) -> tuple:
    other = _edited(text, following)
    theirs = make(other) if other != text else mine
    return (len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), mine, theirs,
            likeness(mine, theirs), likeness(mine, its))


_DIGEST = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
           T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
_INNER, _FIRST, _LAST = 0, 1, 2


def _columns(rows: Sequence[tuple], fields: Sequence[T.StructField]) -> list[pa.Array]:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(),
             T.IntegerType(): pa.int32()}
    return [pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows) if rows else [()] * len(fields), fields)]


def neighbour_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     num_partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document's, in ascending id order;
    after the last document comes the first.  Returns the id, n_chars (code
    points), edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next.  Null texts are empty; without an id a document comes before
    all others; equal ids are ordered by their texts, and repeated rows follow
    each other.  Only the two named columns are read, so others may have any
    name; an empty table gives none.

    The texts are range-partitioned and sorted by id once; a task walks its
    rows with the row before in hand.  What a partition's last document needs
    from the next partition's first is joined afterwards from the written
    rows, two texts per partition.
    """
    spark = docs.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(f"`{doc_id}`").alias("doc"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), F.col("text"))})
    order = ["doc", "h1", "h2"]
    lined = base.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc", "text")
    fields = [T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()),
              T.StructField("text", T.StringType()), *_DIGEST]
    schema = T.StructType([T.StructField("doc", base.schema["doc"].dataType), *fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, make = TaskContext.get().partitionId(), Fingerprinter()
        before = None  # (id, text, fingerprint) of the row before
        for batch in batches:
            ids, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = make(t) if before is None or t != before[1] else before[2]
                if before is None:
                    ids.append(batch.column(0).slice(k, 1))
                    rows.append((part, _FIRST, t, None, None, own, None, None, None))
                else:
                    ids.append(before[0])
                    rows.append((part, _INNER, None, *_digest(make, before[1], before[2], t, own)))
                before = (batch.column(0).slice(k, 1), t, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *_columns(rows, fields)], schema.names)
        if before is not None:
            last = (part, _LAST, before[1], None, None, before[2], None, None, None)
            yield pa.RecordBatch.from_arrays([before[0], *_columns([last], fields)], schema.names)

    written = materialize(lined.mapInArrow(walk, schema), "fingerprints")
    first = written.filter(F.col("kind") == _FIRST)
    # one row per range partition: the next one that has rows, after the last the first
    parts = first.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"),
                         F.min("part").over(Window.orderBy("part")).alias("least"))
    ends = (written.filter(F.col("kind") == _LAST).select("doc", "part", "text", "fingerprint")
            .join(parts.select("part", F.coalesce("after", "least").alias("after")), "part")
            .join(first.select(F.col("part").alias("after"), F.col("text").alias("following"),
                               F.col("fingerprint").alias("its")), "after")
            .select("doc", "text", "fingerprint", "following", "its"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter()
        for batch in batches:
            rows = [_digest(make, *x) for x in zip(*[c.to_pylist() for c in batch.columns[1:]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, _DIGEST)], ["doc", *names])

    names = [f.name for f in _DIGEST]
    out = written.filter(F.col("kind") == _INNER).select("doc", *names).unionByName(
        ends.mapInArrow(close, T.StructType([schema["doc"], *_DIGEST])))
    return out.withColumnRenamed("doc", doc_id)
