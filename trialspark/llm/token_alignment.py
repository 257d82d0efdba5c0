"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizers cut the same bytes, a space and the text.  Per Arrow batch
the tokens of its documents are laid out in two frames (document, start,
token), and ``pandas.merge_asof``, keyed by document, finds for each token
start the covering token of the other side: the last one that starts no
later.  The two directions together are all overlapping pairs.  A token whose
covering token starts at the same byte begins a *group*: there both sides had
just ended, so the equal ends cut both token sequences into the same groups.

Corpus-wide counts (``link_digest``): each document's distinct linked id pairs
are written once with how often they occur in it; the documents of each pair
are counted by a partially aggregated groupBy, and the counts go back to the
written pairs, broadcast only while their number is under a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.llm.common import fresh, without
from trialspark.session import materialize

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
CHUNK_BYTES = 1 << 19            # text tokenized at a time (a longer document is a chunk of its own)
MAX_BROADCAST_PAIRS = 2_000_000  # pair counts (24 bytes each) that may be broadcast; beyond it a merge join


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's bytes: a path with a scheme is read by Spark, any other from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


#: How a byte-level vocabulary's texts are cut before the merges (fixed by the format).
_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts the rank form does not take: characters whose class depends on the Unicode version, and very long runs.
_SLOW = re.compile(r"[^\x00-\u024f]|\s{1000}|\S{1000}")


def _bytes_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these stand for themselves
    out = {chr(b): b for b in printable}
    for b in sorted(set(range(256)) - set(printable)):  # the others are written from U+0100 on
        out[chr(256 + len(out) - len(printable))] = b
    return out


class ByteBpe:
    """Byte-level BPE (a ``tokenizers`` JSON file); special tokens' strings are ordinary text.

    Where the file's merges are in the order of the ids they make, a token's
    id is also its rank, and ordinary texts are encoded from the same
    vocabulary by ``tiktoken``, which is faster and gives the same ids.
    """

    def __init__(self, data: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(data.decode())
        self._tok.encode_special_tokens = True
        byte_of = _bytes_of()
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self._ranks = self._by_rank(json.loads(data))

    def _by_rank(self, spec: dict):
        """The rank form, or None if the file's merges or cutting differ from it."""
        import tiktoken

        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        plain = (model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges")
                 and not model.get("dropout") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut.get("add_prefix_space") and made == sorted(made))
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {self.pieces[i]: i for i in model["vocab"].values() if i not in special}
        if not plain or any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("ranks", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self._ranks is not None and not _SLOW.search(t):
                out.append(self._ranks.encode_to_numpy(" " + t, disallowed_special=()))
            else:
                out.append(np.array(self._tok.encode(" " + t, add_special_tokens=False).ids, np.uint32))
        return out


class Pieces:
    """A ``sentencepiece`` model, which puts the space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x")
                       else p.replace("▁", " ").encode()
                       for p in map(self._sp.id_to_piece, range(self._sp.get_piece_size()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._sp.encode(texts, num_threads=1)]


@dataclass
class Side:
    """One side's tokens of a chunk of documents, in order."""
    ids: np.ndarray    # token ids
    doc: np.ndarray    # document's place in the chunk
    start: np.ndarray  # first byte, counted through the chunk's documents
    n: np.ndarray      # tokens per document
    cover: np.ndarray = None  # the other side's covering token of each token start
    group: np.ndarray = None  # group of each token, counted through the chunk


def _side(ids: list[np.ndarray], size: np.ndarray) -> Side:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
    ends = np.cumsum(size[flat])
    return Side(flat, np.repeat(np.arange(len(ids)), n), np.concatenate(([0], ends[:-1])) if len(flat) else ends, n)


def align(a: Side, b: Side) -> None:
    """Fill ``cover`` and ``group`` of both sides by one ``merge_asof`` in each direction."""
    left = pd.DataFrame({"at": a.start, "doc": a.doc, "token": np.arange(len(a.ids))})
    right = pd.DataFrame({"at": b.start, "doc": b.doc, "token": np.arange(len(b.ids))})
    for one, other, x, y in ((left, right, a, b), (right, left, b, a)):
        x.cover = pd.merge_asof(one, other, on="at", by="doc", suffixes=("", "_covering"))["token_covering"].to_numpy()
        x.group = np.cumsum(y.start[x.cover] == x.start) - 1  # both sides start here: the ones before ended together


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a byte: both directions together, each pair once, in order."""
    n = max(len(b.ids), 1)
    both = np.unique(np.concatenate((np.arange(len(a.ids)) * n + a.cover, b.cover * n + np.arange(len(b.ids)))))
    return both // n, both % n


def _first(group: np.ndarray) -> np.ndarray:
    """Each group's first token, and one beyond the last."""
    return np.concatenate((np.zeros(min(len(group), 1), np.int64), np.flatnonzero(np.diff(group)) + 1, [len(group)]))


def linked_pairs(a: Side, b: Side, n_ids_b: int, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document * space + id of a * n_ids_b + id of b) and how many links each is.

    A link is a pair of occurrences in one group.  Groups with several tokens
    on both sides are multiplied out over distinct ids, not over occurrences.
    """
    if not len(a.ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a0, b0 = _first(a.group), _first(b.group)
    na, nb = np.diff(a0), np.diff(b0)
    one_b = nb[a.group] == 1
    one_a = (na[b.group] == 1) & (nb[b.group] > 1)
    ia = np.concatenate((np.flatnonzero(one_b), a0[b.group[one_a]]))
    ib = np.concatenate((b0[a.group[one_b]], np.flatnonzero(one_a)))
    key, times = np.unique(a.doc[ia] * space + a.ids[ia] * n_ids_b + b.ids[ib], return_counts=True)
    many = (na > 1) & (nb > 1)
    if many.any():
        parts = [pd.DataFrame({"group": s.group[m], "doc": s.doc[m], "id": s.ids[m]})
                 .groupby(["group", "doc", "id"], sort=False).size().reset_index(name="times")
                 for s in (a, b) for m in [many[s.group]]]
        wide = parts[0].merge(parts[1].drop(columns="doc"), on="group", suffixes=("_a", "_b"))
        more = (wide["doc"] * space + wide["id_a"] * n_ids_b + wide["id_b"]).to_numpy()
        key, at = np.unique(np.concatenate((key, more)), return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, at, np.concatenate((times, (wide["times_a"] * wide["times_b"]).to_numpy())))
        times = sums
    return key, times


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1, zero bytes before them, and room for a mark."""
    width, rest = len(str(n)), np.arange(n)
    cells = np.zeros((n, width + 1), np.uint8)
    for k in range(width - 1, -1, -1):
        shown = (rest > 0) | (k == width - 1)
        cells[shown, k] = rest[shown] % 10 + 48
        rest = rest // 10
    return cells


def group_texts(a: Side, b: Side) -> list[bytes]:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3`` (decimal ids, in order)."""
    docs = len(a.n)
    if not len(a.ids):
        return [b""] * docs
    a0, b0 = _first(a.group), _first(b.group)
    total = len(a.ids) + len(b.ids)
    ids, sep = np.empty(total, np.int64), np.empty(total, np.uint8)
    at_a, at_b = np.arange(len(a.ids)) + b0[a.group], np.arange(len(b.ids)) + a0[b.group + 1]
    ids[at_a], ids[at_b] = a.ids, b.ids
    sep[:] = ord(",")
    sep[at_a[a0[1:] - 1]], sep[at_b[b0[1:] - 1]] = ord("|"), ord(";")
    last = np.cumsum(a.n + b.n)
    sep[last[a.n > 0] - 1] = 0  # no mark after a document's last token
    cells = _digits(int(ids.max()) + 1)[ids]
    cells[:, -1] = sep
    keep = cells > 0
    flat = cells[keep].tobytes()
    ends = np.concatenate(([0], np.cumsum(keep.sum(1))))[np.concatenate(([0], last))]
    return [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]


def _same_bytes(ids: np.ndarray, pieces: list[bytes], want: bytes) -> bool:
    return b"".join([pieces[i] for i in ids.tolist()]) == want


class Aligner:
    """Both tokenizers and the alignment of chunks of texts."""

    def __init__(self, byte_bpe: bytes, piece_model: bytes):
        self.a, self.b = ByteBpe(byte_bpe), Pieces(piece_model)
        self.size_a, self.size_b = (np.array([len(p) for p in t.pieces], np.int64) for t in (self.a, self.b))

    def chunk(self, texts: list[str | None]) -> tuple[Side, Side]:
        """Aligned sides; null or empty texts, and those a tokenizer does not give back, have no tokens."""
        full = [k for k, t in enumerate(texts) if t]
        given = [texts[k] for k in full]
        none = np.empty(0, np.uint32)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        for k, x, y in zip(full, self.a.encode(given), self.b.encode(given)):
            want = (" " + texts[k]).encode()
            if _same_bytes(x, self.a.pieces, want) and _same_bytes(y, self.b.pieces, want):
                ids_a[k], ids_b[k] = x, y
        a, b = _side(ids_a, self.size_a), _side(ids_b, self.size_b)
        align(a, b)
        return a, b


def _aligner(vocab: tuple[bytes, bytes]) -> Aligner:
    """The process's aligner of these vocabularies.

    This module travels with every task, so what outlives a task hangs on a
    library that the process imports once.
    """
    import sentencepiece

    held = sentencepiece.__dict__.setdefault("_aligners", {})
    key = tuple(hashlib.sha256(v).digest() for v in vocab)
    if key not in held:
        held[key] = Aligner(*vocab)
    return held[key]


def _chunks(texts: list[str | None], chunk_bytes: int) -> Iterator[slice]:
    begin = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > begin and size + n > chunk_bytes:
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def _lists(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values)


def _vocabularies(spark: SparkSession, folder: str) -> tuple[bytes, bytes]:
    return read_file(spark, f"{folder}/{BYTE_BPE}"), read_file(spark, f"{folder}/{PIECES}")


def align_documents(docs: DataFrame, text: str = "text", folder: str = TOKENIZERS,
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``groups`` (start, end, a, b: byte range and both sides' ids) and ``overlaps`` (a, b).

    ``overlaps`` holds the places (from 0) of the tokens that share a byte.
    Null and empty texts, and texts whose tokens do not join to the space and
    the text again, have no tokens: two empty arrays.  A long text is one row
    and has to fit into memory with its tokens.  Rows keep their number and
    order; repeated rows get equal results.  Columns named groups or overlaps
    are replaced; an empty table gives none.
    """
    docs = without(docs, ["groups", "overlaps"])
    vocab = _vocabularies(docs.sparkSession, folder)
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))
    schema = T.StructType([*docs.schema.fields,
                           T.StructField("groups", T.ArrayType(T.StructType(
                               [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                T.StructField("a", T.ArrayType(T.IntegerType())),
                                T.StructField("b", T.ArrayType(T.IntegerType()))]))),
                           T.StructField("overlaps", T.ArrayType(T.StructType(
                               [T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocab)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for part in _chunks(texts, chunk_bytes):
                a, b = aligner.chunk(texts[part])
                a0, b0 = _first(a.group), _first(b.group)
                doc = a.doc[a0[:-1]]
                per_doc = np.bincount(doc, minlength=len(a.n))
                base = np.zeros(len(a.n), np.int64)
                firsts = np.concatenate(([0], np.cumsum(a.n)[:-1]))[a.n > 0]
                base[a.n > 0] = a.start[firsts]
                ends = np.concatenate((a.start, [int(a.start[-1] + aligner.size_a[a.ids[-1]])]))[a0[1:]] if len(doc) else a0[1:]
                groups = pa.StructArray.from_arrays(
                    [pa.array(a.start[a0[:-1]] - base[doc]), pa.array(ends - base[doc]),
                     _lists(pa.array(a.ids, pa.int32()), np.diff(a0)),
                     _lists(pa.array(b.ids, pa.int32()), np.diff(b0))], ["start", "end", "a", "b"])
                ia, ib = overlaps(a, b)
                first_a, first_b = (np.concatenate(([0], np.cumsum(s.n)[:-1])) for s in (a, b))
                pairs = pa.StructArray.from_arrays(
                    [pa.array(ia - first_a[a.doc[ia]], pa.int32()), pa.array(ib - first_b[b.doc[ib]], pa.int32())],
                    ["a", "b"])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, _lists(groups, per_doc),
                     _lists(pairs, np.bincount(a.doc[ia], minlength=len(a.n)))], schema.names)

    return docs.mapInArrow(spans, schema)


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS,
                     chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Per row its id, a row number, token counts, groups digest and distinct linked pairs; and B's vocabulary size.

    ``pair`` holds id of A * size + id of B, ``times`` the links of that pair.  The result is written (an action).
    """
    spark = docs.sparkSession
    vocab = _vocabularies(spark, folder)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("row", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pair", T.ArrayType(T.LongType())),
                           T.StructField("times", T.ArrayType(T.LongType()))])
    n_b = len(Pieces(vocab[1]).pieces)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(vocab)
        space = len(aligner.a.pieces) * n_b
        row = TaskContext.get().partitionId() << 33  # fixed with the written rows
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _chunks(texts, chunk_bytes):
                a, b = aligner.chunk(texts[part])
                k = len(a.n)
                key, times = linked_pairs(a, b, n_b, space)
                n_groups = np.bincount(a.doc[a.start == b.start[a.cover]], minlength=k) if len(a.ids) else a.n
                links = np.zeros(k, np.int64)
                np.add.at(links, key // space, times)
                per_doc = np.bincount(key // space, minlength=k)
                sha = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, k), pa.array(np.arange(row, row + k)), pa.array(a.n),
                     pa.array(b.n), pa.array(n_groups.astype(np.int64)), pa.array(links), pa.array(sha, pa.string()),
                     _lists(pa.array(key % space), per_doc), _lists(pa.array(times), per_doc)], schema.names)
                row += k

    found = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialize(found.mapInArrow(digests, schema), "aligned_documents"), n_b


def pair_counts(linked: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold each pair linked; best if no pair of its A id has more.  Written."""
    counts = linked.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.expr(f"pair div {n_b}")))  # at most one row per B id
    return materialize(counts.select("pair", "n_docs", (F.col("n_docs") == most).alias("best")), "pair_counts")


def link_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS,
                max_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    Null and empty texts, and texts whose tokens do not join to the space and
    the text again, have zeros and an empty digest.  Every row is a document
    of its own in the counts, also where ids or whole rows repeat; equal
    counts are all best.  Long texts are aligned whole.  Only the two named
    columns are read, so others may have any name; an empty table gives none.
    """
    linked, n_b = linked_documents(docs, doc_id, text, folder)
    counts = pair_counts(linked, n_b)
    links = linked.select("row", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("row", "p.pair", "p.times")
    small = counts.count() <= max_pairs
    sums = (links.join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")))
    name = fresh(linked.drop("doc"), doc_id)[0]
    return linked.join(sums, "row", "left").select(
        F.col("doc").alias(name), "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
