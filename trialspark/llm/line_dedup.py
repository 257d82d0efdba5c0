"""Line dedup: drop lines that many documents share, keeping each once.

The texts are exploded into lines; a line's key is the line stripped of ASCII
white space with A-Z lower-cased, and travels as a 128-bit hash.  Distinct
(key, document) rows are counted per key, partially before the shuffle, so a
line that a third of all documents hold is a few rows per map task.  Keys
over the threshold are written and met with the lines again (broadcast only
under a checked size).  Each document then gets the positions it loses, and
its remaining lines are joined in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import ascii_lower, fresh, row_key, without
from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

SPACE = " \t\n\x0b\x0c\r"


def _without_lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, drops in batches:
        out = []
        for t, drop in zip(texts, drops):
            if drop is None:
                out.append(None)
                continue
            lines = t.split("\n")
            keep = np.ones(len(lines), bool)
            keep[np.asarray(drop)] = False
            out.append("\n".join([x for x, k in zip(lines, keep) if k]))
        yield pd.Series(out, dtype=object)


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20,
                      min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` less the shared lines, plus n_lines (before) and n_dropped.

    A key of ``min_chars`` or more code points found in ``min_docs`` or more
    documents loses all its lines except those in the largest id that holds
    it.  Null and empty texts are one empty line.  Rows with the same id are
    one document; rows without an id are together one document, below every
    other.  Repeated rows are kept and lose the same lines.  Columns named
    n_lines or n_dropped are replaced; an empty table gives none.
    """
    docs = without(docs, ["n_lines", "n_dropped"])
    k1, k2, at = fresh(docs, "k1", "k2", "at")
    h1, h2 = row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    base = docs.withColumns({text: F.coalesce(F.col(f"`{text}`"), F.lit("")), k1: h1, k2: h2})
    line = F.btrim(F.col("line"), F.lit(SPACE))
    keys = (base.select(F.col(f"`{doc_id}`").alias("id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"),
                        F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"))
            .filter(F.char_length("line") >= min_chars)
            .filter(F.char_length(line) >= min_chars)
            .withColumn("key", ascii_lower(line))
            .select("id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit("second"), F.col("key")).alias("h2")))
    shared = materialize(
        keys.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "shared_lines")
    lost = (join_by_size(keys, shared, ["h1", "h2"])
            .filter(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("pos").alias(at)))
    lost = materialize(lost, "lost_lines")
    kept = F.pandas_udf(_without_lines, "string")
    out = join_by_size(base, lost, [k1, k2], "left")
    n_lines = F.size(F.split(F.col(f"`{text}`"), "\n"))
    return out.select(
        *[F.coalesce(kept(F.when(F.col(at).isNotNull(), F.col(f"`{text}`")), F.col(at)), F.col(f"`{text}`")).alias(c)
          if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long").alias("n_dropped"))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of ``drop_shared_lines``."""
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS lost
  FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
