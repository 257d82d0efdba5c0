"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VNODES`` points on a ring of 64-bit hashes; a row's key
hash belongs to the next point clockwise.  A shard takes rows only up to its
capacity; rows over it continue clockwise to the next point whose shard has
room.  Capacities add up to the number of rows and differ by at most one, so
balance is guaranteed, and only the overflow leaves its home shard.

Within one arc of the ring rows are taken in hash order, so a whole arc is
described by a few rank intervals.  The driver sees one count per arc (as
many as the ring has points, whatever the data) and plans the intervals; the
rows meet them in one join with that plan.  Ranks come from a range-
partitioned, written order, not from a window over an arc, so a key that
holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, without
from trialspark.operators.ordering import with_row_index

VNODES = 256
OUT = ("shard", "slot", "hops")


def ring(n_shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(points, owners): the sorted signed 64-bit positions of all virtual nodes, and their shards."""
    import xxhash

    at = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}", 42), s) for s in range(n_shards) for v in range(vnodes))
    points = np.array([p for p, _ in at], dtype=np.uint64) ^ np.uint64(1 << 63)
    return points.astype(np.uint64).view(np.int64), np.array([s for _, s in at])


def capacities(n_rows: int, n_shards: int) -> list[int]:
    """As equal as can be: the first n_rows mod n_shards shards take one more."""
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def place(counts: list[int], owners: list[int], free: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot, hops) for rows counted per arc; ``free`` has room for all.

    All overflow moves one point clockwise at a time, and a point serves what
    reaches it in ring order.
    """
    free, used, out = list(free), [0] * len(free), []
    waiting = [(a, a, 0, n) for a, n in enumerate(counts) if n]  # where, home arc, first rank, end rank
    hops = 0
    while waiting:
        over = []
        for at, arc, lo, hi in sorted(waiting):
            s = owners[at]
            take = min(hi - lo, free[s])
            if take:
                out.append((arc, lo, lo + take, s, used[s], hops))
                free[s] -= take
                used[s] += take
            if lo + take < hi:
                over.append(((at + 1) % len(owners), arc, lo + take, hi))
        waiting, hops = over, hops + 1
    return out


def assign_shards(rows: DataFrame, n_shards: int = 24, key: str = "doc_id", vnodes: int = VNODES) -> DataFrame:
    """``rows`` plus shard (0 to n_shards - 1), slot (gapless from 0 in each shard) and hops (0: the key's home).

    Shard sizes differ by at most one row.  Null keys share one position on
    the ring, as equal keys do; ties are ordered by a hash of all columns, so
    the result depends on the rows alone (rows equal in every column may swap
    places).  Columns with the names of added ones are replaced; an empty
    table gives none.
    """
    if n_shards < 1 or vnodes < 1:
        raise ValueError("a ring needs shards and virtual nodes")
    rows = without(rows, OUT)
    pos, arc, tie, copy, idx = fresh(rows, "ring_pos", "ring_arc", "ring_tie", "ring_copy", "ring_idx")
    points, owners = ring(n_shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.searchsorted(points, s.to_numpy(np.int64)) % len(points), dtype="int32")

    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map" not in f.dataType.simpleString()]
    placed = rows.withColumn(pos, F.xxhash64(F.col(f"`{key}`"))).withColumns(
        {arc: arc_of(F.col(pos)), tie: F.xxhash64(*plain), copy: F.monotonically_increasing_id()})
    indexed = with_row_index(placed, [arc, pos, tie, copy], idx)
    per_arc = {r[0]: r[1] for r in indexed.groupBy(arc).count().collect()}  # one row per virtual node at most
    counts = [per_arc.get(a, 0) for a in range(len(points))]
    first = np.concatenate(([0], np.cumsum(counts)))
    plan = [(a, int(first[a]) + lo, int(first[a]) + hi, s, slot, hops) for a, lo, hi, s, slot, hops in
            place(counts, owners.tolist(), capacities(sum(counts), n_shards))]
    spark = rows.sparkSession
    cuts = spark.createDataFrame(pd.DataFrame(plan, columns=["a", "lo", "hi", "shard", "slot0", "hops"]).astype("int64"),
                                 "a long, lo long, hi long, shard long, slot0 long, hops long")
    # rows of the plan: a few per virtual node, independent of the data
    return (indexed.join(F.broadcast(cuts), (F.col(arc) == cuts["a"]) & (F.col(idx) >= cuts["lo"])
                         & (F.col(idx) < cuts["hi"]))
            .select(*[indexed[f"`{c}`"] for c in rows.columns], cuts["shard"].cast("int").alias("shard"),
                    (F.col(idx) - cuts["lo"] + cuts["slot0"]).alias("slot"), cuts["hops"].cast("int").alias("hops")))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null under this law), hops."""
    utf8 = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    narrow = docs.select("doc_id", (F.octet_length(utf8) + 8).cast("long").alias("size"),
                         F.crc32(utf8).alias("text_crc32"))
    out = assign_shards(narrow, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hops")
